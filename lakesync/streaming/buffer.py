"""The buffer as a stateful operator: one open session per key, flushed by a timer.

State is the session's summary, not its intents: counts, first and last time, the first proofs. Rows of a batch are put in
order of arrival and split where a flush would have come between them, so replay in one batch or many gives the same
sessions. In event time the timer fires when the watermark passes flush + grace; in processing time when the clock does, with
no new data needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lakesync.config import ADD_CANDIDATE, DROP_CANDIDATE, SyncConfig

KEY = ["tenant_id", "table_fqn", "partition_key"]
SESSION = (
    "tenant_id string, table_fqn string, partition_key string, sid long, partition_prefix string, kind string, proof_keys array<string>, n long, last_kind string, "
    "first_us long, last_us long, flush_us long"
)
_STATE = "sid long, prefix string, n long, n_add long, n_drop long, proofs array<string>, last_kind string, first_us long, last_us long"
_FIELDS = ["sid", "prefix", "n", "n_add", "n_drop", "proofs", "last_kind", "first_us", "last_us"]


class SessionBuffer(StatefulProcessor):
    def __init__(self, config: SyncConfig, event_time: bool = True):
        self.window, self.cap, self.grace = config.window_us, config.cap_us, config.grace_us
        self.proofs, self.event_time = config.proofs, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _STATE)
        self.count = handle.getValueState("count", "sid long")

    def _flush_us(self, s: dict) -> int:
        return min(s["last_us"] + self.window, s["first_us"] + self.cap)

    def _rows(self, key: tuple, s: dict) -> list[dict]:
        """The session as a row; none if its intents neither add nor drop."""
        if not s["n_add"] + s["n_drop"]:
            return []
        return [dict(zip(KEY, key)) | {
            "sid": s["sid"], "partition_prefix": s["prefix"], "kind": "ADD" if s["n_add"] else "DROP", "proof_keys": s["proofs"], "n": s["n"],
            "last_kind": s["last_kind"], "first_us": s["first_us"], "last_us": s["last_us"], "flush_us": self._flush_us(s),
        }]

    def _timer(self, s: dict) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((self._flush_us(s) + self.grace) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values(["t_us", "seq"])
        state = dict(zip(_FIELDS, self.open.get())) if self.open.exists() else None
        sid = self.count.get()[0] if self.count.exists() else 0
        closed = []
        for t, kind, prefix, proof in zip(data["t_us"].tolist(), data["kind"].tolist(), data["partition_prefix"].tolist(), data["proof"].tolist()):
            if state is not None and t > self._flush_us(state) + self.grace:
                closed += self._rows(key, state)
                state = None
            if state is None:
                sid += 1
                state = {"sid": sid, "prefix": prefix, "n": 0, "n_add": 0, "n_drop": 0, "proofs": [], "last_kind": kind, "first_us": t, "last_us": t}
            adds = kind == ADD_CANDIDATE
            proofs = [*state["proofs"], proof] if adds and len(state["proofs"]) < self.proofs else list(state["proofs"])
            state |= {"n": state["n"] + 1, "n_add": state["n_add"] + adds, "n_drop": state["n_drop"] + (kind == DROP_CANDIDATE), "proofs": proofs, "last_kind": kind, "last_us": t}
        self.open.update(tuple(state[f] for f in _FIELDS))
        self.count.update((sid,))
        self._timer(state)
        if closed:
            yield pd.DataFrame(closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            state = dict(zip(_FIELDS, self.open.get()))
            now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            if (self._flush_us(state) + self.grace) // 1000 < now:
                self.open.clear()
                if rows := self._rows(key, state):
                    yield pd.DataFrame(rows)

    def close(self) -> None:
        pass


def flushed_sessions(intents: DataFrame, config: SyncConfig, event_time: bool = True, delay: str = "0 seconds") -> DataFrame:
    """The stream of sessions that have been flushed. In event time intents carry t_us as their time; nothing is late, as time is that of arrival."""
    timed = intents.withColumn("arrival", F.timestamp_micros("t_us"))
    if event_time:
        timed = timed.withWatermark("arrival", delay)
    return timed.groupBy(*KEY).transformWithStateInPandas(
        SessionBuffer(config, event_time), outputStructType=SESSION, outputMode="Append", timeMode="EventTime" if event_time else "ProcessingTime"
    )


def open_buffers(spark: SparkSession, checkpoint: str, config: SyncConfig, now_us: int) -> DataFrame:
    """Open buffers at a moment, from the state in a query's checkpoint: count, seconds to the flush, age, kind of the last intent."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load()
    rows = state.select("key.*", "value.*")
    flush = F.least(F.col("last_us") + config.window_us, F.col("first_us") + config.cap_us)
    still = rows.withColumn("flush_us", flush).where((F.col("flush_us") > now_us - config.grace_us) & (F.col("n_add") + F.col("n_drop") > 0))
    seconds = lambda us: us / F.lit(1e6)
    return still.select(
        *KEY, F.col("n").alias("count"), seconds(F.greatest(F.col("flush_us") - now_us, F.lit(0))).alias("flush_in"), seconds(F.lit(now_us) - F.col("first_us")).alias("age_s"), F.col("last_kind").alias("kind")
    )
