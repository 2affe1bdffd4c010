"""Replay of a whole history: every session's commit, against storage and catalog as they were at its flush."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesync.config import ADD_CANDIDATE, SyncConfig
from lakesync.operators.sessions import KEY, effective_intents


def live_changes(assigned: DataFrame) -> DataFrame:
    """assigned with delta: +1 where an event makes its object live, -1 where it ends it, 0 where nothing changes."""
    live = (F.col("kind") == ADD_CANDIDATE).cast("int")
    before = F.lag(live, 1, 0).over(Window.partitionBy("tenant_id", "object_key").orderBy("t_us", "seq"))
    return assigned.withColumn("delta", live - before)


def replay(assigned: DataFrame, config: SyncConfig) -> DataFrame:
    """Each session with status and reason of its first apply.

    The number of live objects at a flush is the running sum of the sessions' changes. Before a session the catalog holds
    the key exactly if storage did at the session before (an ADD leaves it so, and a DROP-only session that finds storage
    non-empty found it so before), so no fold over sessions is needed.
    """
    changes = live_changes(assigned).groupBy(*KEY, "sid").agg(F.sum("delta").alias("change"))
    in_order = Window.partitionBy(*KEY).orderBy("sid")
    rows = effective_intents(assigned, config).join(changes, [*KEY, "sid"]).withColumn("non_empty", F.sum("change").over(in_order) > 0)
    rows = rows.withColumn("in_catalog", F.lag("non_empty", 1, False).over(in_order))
    there, full = F.col("in_catalog"), F.col("non_empty")
    add = F.when(there & full, F.struct(F.lit("NOOP").alias("s"), F.lit("already_exists_verified").alias("r"))).when(there, F.struct(F.lit("RETRY").alias("s"), F.lit("stale_catalog_entry_cleared").alias("r")))
    add = add.when(full, F.struct(F.lit("APPLIED").alias("s"), F.lit(None).cast("string").alias("r"))).otherwise(F.struct(F.lit("RETRY").alias("s"), F.lit("not_visible_yet").alias("r")))
    drop = F.when(~there, F.struct(F.lit("NOOP").alias("s"), F.lit("not_found").alias("r"))).when(full, F.struct(F.lit("NOOP").alias("s"), F.lit("still_non_empty").alias("r")))
    drop = drop.otherwise(F.struct(F.lit("APPLIED").alias("s"), F.lit(None).cast("string").alias("r")))
    return rows.withColumn("result", F.when(F.col("kind") == "ADD", add).otherwise(drop)).select("*", F.col("result.s").alias("status"), F.col("result.r").alias("reason")).drop("result", "change")


def latencies(replayed: DataFrame, intents: DataFrame, config: SyncConfig) -> DataFrame:
    """Applied sessions with latency_s: from the partition's first event ever, of any tenant, to the flush; session_s: from the session's own first."""
    first_seen = intents.groupBy("partition_key").agg(F.min("t_us").alias("seen_us"))
    done = replayed.where(F.col("status") == "APPLIED").join(first_seen, "partition_key")
    at = F.col("flush_us") + config.grace_us
    return done.select(*KEY, "sid", "kind", ((at - F.col("seen_us")) / F.lit(1e6)).alias("latency_s"), ((at - F.col("first_us")) / F.lit(1e6)).alias("session_s"))
