"""Retries with full-jitter backoff, and what ends in the dead-letter table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesync.config import SyncConfig
from lakesync.functions.hashing import md5_unit
from lakesync.operators import commit
from lakesync.operators.inventory import visible
from lakesync.scratch import store

KEY = ["tenant_id", "table_fqn", "partition_key"]


def backoff_s(key: Column, attempt: Column, config: SyncConfig) -> Column:
    """Between 0 and min(2 ^ attempt, max_backoff) seconds; the draw is a hash of key and attempt, the same on any run."""
    return md5_unit(F.concat_ws("#", key, attempt.cast("string"))) * F.least(F.pow(F.lit(2.0), attempt), F.lit(config.max_backoff))


def schedule(first_results: DataFrame, config: SyncConfig) -> DataFrame:
    """The retries of results with status RETRY: attempt 1 to needed (column visible_at: the apply, counted from 0, that succeeds) or max_retries.

    attempt, wait_s, at_s (seconds after the first apply), status: APPLIED, RETRY, or DLQ with the last failure.
    """
    due = first_results.where(F.col("status") == "RETRY")
    each = due.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.least(F.col("visible_at"), F.lit(config.max_retries)))))
    waits = each.withColumn("wait_s", backoff_s(F.col("partition_key"), F.col("attempt"), config))
    up_to = F.aggregate(F.sequence(F.lit(1), F.col("attempt")), F.lit(0.0), lambda a, i: a + backoff_s(F.col("partition_key"), i, config))
    status = F.when(F.col("attempt") == F.col("visible_at"), "APPLIED").when(F.col("attempt") == config.max_retries, "DLQ").otherwise("RETRY")
    return waits.withColumn("at_s", up_to).withColumn("status", status)


def dead_letters(results: DataFrame, attempts: DataFrame) -> DataFrame:
    """What the dead-letter table gets: errors of the first apply, and retries that ran out."""
    errors = results.where(F.col("status") == "ERROR").select(*KEY, "kind", "reason", F.lit(0).alias("attempts"))
    spent = attempts.where(F.col("status") == "DLQ").select(*KEY, "kind", "reason", F.col("attempt").alias("attempts"))
    return errors.unionByName(spent)


def attempts_until_settled(effective: DataFrame, catalog: DataFrame, inventory: DataFrame, config: SyncConfig, miss_rate: float) -> DataFrame:
    """Each effective intent applied up to 1 + max_retries times, while objects come into sight: attempt a sees what showed by a.

    Key, kind, status (DLQ for what never settled), reason, attempts made, heads and lists of all attempts. A round takes what is
    left to be retried; what an object's first sight is depends on the object and the attempt alone.
    """
    left, settled = effective, None
    for attempt in range(1, config.max_retries + 2):
        seen = inventory.where(visible(F.col("object_key"), F.lit(attempt), miss_rate))
        results = store(commit.apply(left, catalog, seen, config.enable_drop).withColumn("attempts", F.lit(attempt)), "attempt")
        last = attempt == config.max_retries + 1
        status = F.when(F.col("status") == "RETRY", "DLQ").otherwise(F.col("status")) if last else F.col("status")
        mine = results.where((F.col("status") != "RETRY") | F.lit(last)).withColumn("status", status)
        rows = mine.select(*KEY, "kind", "status", "reason", "attempts", "heads", "lists")
        spent = results.where((F.col("status") == "RETRY") & F.lit(not last)).select(*KEY, "kind", F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("reason"), "attempts", "heads", "lists")
        settled = rows.unionByName(spent) if settled is None else settled.unionByName(rows).unionByName(spent)
        left = results.where(F.col("status") == "RETRY").select(*effective.columns)
        catalog = store(commit.catalog_after(catalog, results), "catalog")
    return settled.groupBy(*KEY, "kind").agg(
        F.max("status").alias("status"), F.max("reason").alias("reason"), F.max("attempts").alias("attempts"), F.sum("heads").alias("heads"), F.sum("lists").alias("lists")
    )


def due(queue: DataFrame, now_s: float) -> DataFrame:
    """Entries of a retry table (retry_at_s) that are to be applied again."""
    return queue.where(F.col("retry_at_s") <= now_s)


def requeue(results: DataFrame, config: SyncConfig, now_s: float) -> tuple[DataFrame, DataFrame]:
    """Of results with `attempt` (applies that have failed before): the entries to queue again, and the dead letters. No-ops are resolved."""
    failed = results.where(F.col("status") == "RETRY").withColumn("attempt", F.col("attempt") + 1)
    again = failed.where(F.col("attempt") <= config.max_retries)
    again = again.withColumn("retry_at_s", F.lit(now_s) + backoff_s(F.col("partition_key"), F.col("attempt"), config))
    dead = failed.where(F.col("attempt") > config.max_retries).unionByName(results.where(F.col("status") == "ERROR").withColumn("attempt", F.col("attempt")))
    return again, dead
