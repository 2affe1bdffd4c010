"""Latency of commits as state: when a partition was first seen, whoever saw it, and how long after that each of its changes was applied.

Arrivals and applied outcomes come in as one stream. State is one time for each partition and the last outcome counted for each tenant, so a
repeated batch of outcomes counts once. With a time to live, both are forgotten that long after the partition's last arrival or outcome.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: An arrival has no place; an outcome has its place among those of its key, which grows, and the times of its session's start and of its commit.
NEWS = "partition_key string, tenant_id string, table_fqn string, kind string, t_us long, place long, first_us long"
LATENCY = "partition_key string, tenant_id string, table_fqn string, kind string, sid long, latency_s double, session_s double"
_COLUMNS = ["partition_key", "tenant_id", "table_fqn", "kind", "t_us", "place", "first_us"]


class FirstSeen(StatefulProcessor):
    def __init__(self, ttl_s: float | None = None):
        self.ttl_ms = None if ttl_s is None else round(ttl_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "t_us long", self.ttl_ms)
        self.counted = handle.getMapState("counted", "tenant_id string, table_fqn string", "place long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, outcomes = self.seen.get()[0] if self.seen.exists() else None, []
        for part in rows:  # arrivals are folded a chunk at a time, only outcomes are held
            came = part["place"].isna()
            times = part.loc[came, "t_us"].astype("int64")
            if len(times):
                first = int(times.min()) if first is None else min(first, int(times.min()))
            if not came.all():
                outcomes.append(part[~came])
        if first is None:
            return  # an outcome of a partition that was never seen, or whose state has been forgotten
        self.seen.update((first,))
        if not outcomes:
            return
        new = []
        for own, mine in pd.concat(outcomes).groupby(["tenant_id", "table_fqn"], dropna=False):
            name = tuple(None if pd.isna(x) else x for x in own)
            last = self.counted.getValue(name)[0] if self.counted.containsKey(name) else None
            mine = mine.drop_duplicates("place")
            fresh = mine if last is None else mine[mine["place"] > last]
            self.counted.updateValue(name, (int(mine["place"].max()) if last is None else max(last, int(mine["place"].max())),))
            new.append(fresh)
        fresh = pd.concat(new)
        if len(fresh):
            at = fresh["t_us"].astype("int64")
            yield pd.DataFrame({
                "partition_key": key[0], "tenant_id": fresh["tenant_id"], "table_fqn": fresh["table_fqn"], "kind": fresh["kind"], "sid": fresh["place"].astype("int64"),
                "latency_s": (at - first) / 1e6, "session_s": (at - fresh["first_us"]) / 1e6,
            })

    def close(self) -> None:
        pass


def arrivals(intents: DataFrame) -> DataFrame:
    none = F.lit(None).cast("long")
    return intents.select(*_COLUMNS[:5], none.alias("place"), none.alias("first_us"))


def outcomes(applied: DataFrame, at_us: str, place: str, first_us: str | None = None) -> DataFrame:
    """Applied results as news: at_us is the time of the commit, place a number that grows from one commit of a key to the next."""
    first = F.col(first_us) if first_us else F.lit(None).cast("long")
    return applied.where(F.col("status") == "APPLIED").select(*_COLUMNS[:4], F.col(at_us).cast("long").alias("t_us"), F.col(place).cast("long").alias("place"), first.alias("first_us"))


def latencies(news: DataFrame, ttl_s: float | None = None) -> DataFrame:
    """The stream of latencies of a stream of news; session_s is null where an outcome names no start."""
    return news.groupBy("partition_key").transformWithStateInPandas(FirstSeen(ttl_s), outputStructType=LATENCY, outputMode="Append", timeMode="None" if ttl_s is None else "ProcessingTime")
