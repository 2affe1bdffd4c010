"""Retries as state: what waits for a retry, keyed, with one timer for the next attempt that is due.

Outcomes of commits come in as a stream, those of retries too. A failure waits, for a time drawn from key and attempt, and comes out
as an attempt that is due; what has failed `max_retries` times more than once, and errors, come out as dead letters at once; a
success or a no-op ends whatever its key waits for. State is a list for each key, of the attempts that wait; the timer is that of the
earliest, and an attempt costs nothing before it is due. In processing time the clock fires timers with no new data; in event time the column
`clock` is the clock, which replays drive. Due times are told in the outcomes' own time (failed_s, seconds), whatever the clock.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lakesync.config import SyncConfig
from lakesync.operators.retries import backoff_s

KEY = ["tenant_id", "table_fqn", "partition_key"]
#: attempt: applies that have failed, this one included.
OUTCOME = "tenant_id string, table_fqn string, partition_key string, partition_prefix string, kind string, proof_keys array<string>, status string, reason string, attempt int, failed_s double, clock timestamp"
DUE = "tenant_id string, table_fqn string, partition_key string, partition_prefix string, kind string, proof_keys array<string>, reason string, attempt int, wait_s double, due_s double, dead boolean"
_WAITS = "partition_prefix string, kind string, proof_keys array<string>, reason string, attempt int, wait_s double, due_s double, fires_ms long"
_FIELDS = ["partition_prefix", "kind", "proof_keys", "reason", "attempt", "wait_s", "due_s", "fires_ms"]


class RetryQueue(StatefulProcessor):
    def __init__(self, max_retries: int, event_time: bool):
        self.max_retries, self.event_time = max_retries, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITS)

    def _held(self) -> list[dict]:
        return [dict(zip(_FIELDS, row)) for row in self.waiting.get()] if self.waiting.exists() else []

    def _keep(self, waits: list[dict]) -> None:
        """State and its one timer."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if waits:
            self.waiting.put([tuple(w[f] for f in _FIELDS) for w in waits])
            self.handle.registerTimer(min(w["fires_ms"] for w in waits))
        elif self.waiting.exists():
            self.waiting.clear()

    @staticmethod
    def _row(key: tuple, w: dict, dead: bool) -> dict:
        return dict(zip(KEY, key)) | {f: w[f] for f in _FIELDS if f != "fires_ms"} | {"dead": dead}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waits, out = self._held(), []
        for r in pd.concat(list(rows)).sort_values(["failed_s", "attempt"]).to_dict("records"):
            now_ms = int(r["clock"].timestamp() * 1000) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            wait = {f: r.get(f) for f in _FIELDS} | {
                "proof_keys": list(r["proof_keys"]) if r["proof_keys"] is not None else [], "attempt": int(r["attempt"]), "wait_s": float(r["wait_s"]), "due_s": float(r["failed_s"] + r["wait_s"]), "fires_ms": now_ms + int(r["wait_s"] * 1000) + 1,
            }
            if r["status"] == "RETRY" and r["attempt"] <= self.max_retries:
                waits.append(wait)
            elif r["status"] in ("RETRY", "ERROR"):
                out.append(self._row(key, wait, True))
            else:
                waits = []
        self._keep(waits)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        waits = self._held()
        due = [w for w in waits if w["fires_ms"] <= now]
        self._keep([w for w in waits if w["fires_ms"] > now])
        if due:
            yield pd.DataFrame([self._row(key, w, False) for w in due])

    def close(self) -> None:
        pass


def due_attempts(outcomes: DataFrame, config: SyncConfig, event_time: bool = False) -> DataFrame:
    """The stream of attempts that are due, and of dead letters (dead), of a stream of outcomes. attempt is the number of the retry, from 1;
    for a dead letter the retries that were made."""
    rows = outcomes.withColumn("wait_s", F.when(F.col("attempt") > 0, backoff_s(F.col("partition_key"), F.col("attempt"), config)).otherwise(0.0))
    if event_time:
        rows = rows.withWatermark("clock", "0 seconds")
    return rows.groupBy(*KEY).transformWithStateInPandas(RetryQueue(config.max_retries, event_time), outputStructType=DUE, outputMode="Append", timeMode="EventTime" if event_time else "ProcessingTime")
