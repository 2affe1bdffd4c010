"""Settings of a synchronisation job. Times are seconds."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the data model.
TABLE_ROOT = "warehouse/sales/"
TABLE_FQN = "warehouse.sales"
TENANT_ID = "tenant-1"
CREATED, DELETED = "OBJECT_CREATED", "OBJECT_DELETED"
ADD_CANDIDATE, DROP_CANDIDATE = "ADD_CANDIDATE", "DROP_CANDIDATE"
DATA_SUFFIXES = (".parquet", ".orc", ".avro", ".csv")
SKIPPED_SUFFIXES = ("_SUCCESS", ".crc", ".tmp")
IGNORED_PREFIXES = ("_SUCCESS", ".crc", "_temporary")


@dataclass(frozen=True)
class SyncConfig:
    """Quiet window, grace, cap of a buffer's life (5 windows if none is given), proofs and retries."""

    window: float = 3600.0
    grace: float = 10.0
    cap: float | None = None
    enable_drop: bool = True
    proofs: int = 3
    max_retries: int = 5
    max_backoff: float = 60.0

    @property
    def window_us(self) -> int:
        return round(self.window * 1_000_000)

    @property
    def grace_us(self) -> int:
        return round(self.grace * 1_000_000)

    @property
    def cap_us(self) -> int:
        return round((5 * self.window if self.cap is None else self.cap) * 1_000_000)
