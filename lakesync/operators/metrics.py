"""Counts, costs and latencies of a run, and the cost model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakesync.config import SyncConfig
from lakesync.functions.quantiles import summary
from lakesync.operators import commit, intents, inventory, sessions
from lakesync.scratch import store
from lakesync.sources import generator

DOLLARS_PER_1000 = 0.005


def daily_cost(requests: Column) -> Column:
    return requests / 1000 * DOLLARS_PER_1000


def reduction(requests: Column, scan: int | Column = generator.SCAN_REQUESTS) -> Column:
    return (F.lit(scan) if isinstance(scan, int) else scan) / F.greatest(requests, F.lit(1))


def verdict_counts(envelopes: DataFrame) -> DataFrame:
    return intents.with_verdict(envelopes).groupBy("verdict").agg(F.count("*").alias("n"))


def filter_accounting(envelopes: DataFrame) -> DataFrame:
    """received = filtered + buffered."""
    kept = F.count_if(F.col("verdict") == "kept")
    return intents.with_verdict(envelopes).agg(F.count("*").alias("received"), (F.count("*") - kept).alias("filtered"), kept.alias("buffered"))


def _no_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "tenant_id string, table_fqn string, partition_key string, location string")


def coalescing(partitions: DataFrame, fractions: list[float], miss_rate: float = 0.0, duplicates: float = 0.10) -> DataFrame:
    """For each share of partitions (i, partition_key) that changes: events, what coalescing leaves, commits, requests and their cost.

    With a miss rate, proofs and listings see an object only with a chance (first attempts count).
    """
    config, out, spark = SyncConfig(window=0, grace=0), None, partitions.sparkSession
    partitions = store(partitions, "space")
    total, scan = partitions.count(), generator.scan_requests(partitions)
    for f in fractions:
        events = store(generator.generate_events(partitions, f, duplicates=duplicates), "events")
        own = intents.candidate_intents(events)
        stored = inventory.live_inventory(events.select("tenant_id", "object_key", "op", "t_us", "seq"))
        if miss_rate:
            stored = stored.where(inventory.visible(F.col("object_key"), F.lit(1), miss_rate))
        results = commit.apply(sessions.reconcile(own, config), _no_catalog(spark), stored)
        row = results.agg(F.sum("n").alias("raw_events"), F.count_if(F.col("status") == "APPLIED").alias("committed"), F.sum(F.col("heads") + F.col("lists")).alias("requests"))
        row = row.select(F.lit(f).alias("f"), F.lit(min(generator.changed_count(f, total), total)).cast("long").alias("delta_p"), "*")
        out = row if out is None else out.unionByName(row)
    return out.select(
        "f", "delta_p", "raw_events", (F.col("raw_events") - F.col("committed")).alias("coalesced"), "committed", "requests",
        (F.col("requests") / F.greatest(F.col("committed"), F.lit(1))).alias("alpha_eff"), reduction(F.col("requests"), scan).alias("reduction"), daily_cost(F.col("requests")).alias("daily_cost"),
    )


def convergence(partitions: DataFrame, windows: list[float], fraction: float = 0.01, grace: float = 1.0) -> DataFrame:
    """Median, p95 and p99 of the latency from a partition's first event to its commit, by window.

    All events arrive at one moment; they go through sessions, verification and commit, and a buffer is flushed a millisecond after its grace.
    """
    spark = partitions.sparkSession
    events = store(generator.generate_events(partitions, fraction), "events").withColumn("t_us", F.lit(generator.BASE_US))
    own, live, rows = intents.candidate_intents(events), store(inventory.live_inventory(events), "live"), []
    for w in windows:
        config = SyncConfig(window=w, grace=grace)
        flushed = sessions.effective_intents(sessions.assign_sessions(own, config), config)
        done = commit.apply(flushed, _no_catalog(spark), live).where(F.col("status") == "APPLIED")
        lat = store(done.select(((F.col("flush_us") + config.grace_us + 1_000 - F.col("first_us")) / F.lit(1e6)).alias("latency_s")), "latencies")
        n, middle, got = summary(lat, "latency_s", {"p95": 0.95, "p99": 0.99})
        rows.append((float(w), n, middle, got["p95"], got["p99"]))
    return spark.createDataFrame(rows, "window_s double, commits long, median double, p95 double, p99 double")


def drop_sweep(space: DataFrame, fractions: list[float], changed: float = 0.01) -> DataFrame:
    """First all changed partitions are added, then a share of them is deleted: drops, their LIST requests, requests per drop."""
    config, out, spark = SyncConfig(window=0, grace=0), None, space.sparkSession
    partitions = store(generator.changed_partitions(space, changed), "partitions")
    added = store(generator.generate_events(partitions, 1.0), "events")
    catalog = store(commit.catalog_after(_no_catalog(spark), commit.apply(sessions.reconcile(intents.candidate_intents(added), config), _no_catalog(spark), inventory.live_inventory(added))), "catalog")
    for f in fractions:
        deleted = store(generator.generate_delete_events(partitions, f), "deletions")
        # deletions come after all additions
        later = added.unionByName(deleted.withColumn("t_us", F.col("t_us") + 3_600_000_000))
        results = commit.apply(sessions.reconcile(intents.candidate_intents(deleted), config), catalog, inventory.live_inventory(later))
        row = results.agg(F.sum("n").alias("drop_events"), F.count_if(F.col("status") == "APPLIED").alias("dropped"), F.sum("lists").alias("lists")).select(F.lit(f).alias("f"), "*")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("alpha_drop", F.col("lists") / F.greatest(F.col("dropped"), F.lit(1))).withColumn("daily_cost", daily_cost(F.col("lists")))


def report(result: DataFrame, folder: str, name: str) -> str:
    """Print a small result and keep it as a CSV file under a name with the time in it; returns the path."""
    stamp = result.sparkSession.sql("SELECT date_format(current_timestamp(), 'yyyyMMdd-HHmmss') AS t").first().t
    result.show(200, truncate=False)
    result.coalesce(1).write.option("header", True).csv(path := f"{folder.rstrip('/')}/{name}-{stamp}")
    return path


def request_cost(results: DataFrame) -> DataFrame:
    """Totals of a run: intents, what was committed and coalesced, requests per commit, reduction against a scan, cost."""
    requests = F.sum("heads") + F.sum("lists")
    row = results.agg(F.sum("n").alias("buffered"), F.count_if(F.col("status") == "APPLIED").alias("committed"), F.sum("heads").alias("heads"), F.sum("lists").alias("lists"), requests.alias("requests"))
    return row.select(
        "buffered", "committed", (F.col("buffered") - F.col("committed")).alias("coalesced"), "heads", "lists",
        (F.col("requests") / F.greatest(F.col("committed"), F.lit(1))).alias("alpha_eff"), reduction(F.col("requests")).alias("reduction"), daily_cost(F.col("requests")).alias("daily_cost"),
    )


def outcome_counters() -> list[Column]:
    """Counters of a commit's results, for `observe`: they are filled in while the results are written or streamed, without a pass of their own."""
    of = lambda status: F.count_if(F.col("status") == status)
    named = [of(status).alias(status.lower()) for status in ("APPLIED", "NOOP", "RETRY", "ERROR")]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return [F.count(F.lit(1)).alias("results"), *named, total("heads"), total("lists")]


def observed(results: DataFrame) -> tuple[DataFrame, Observation]:
    """results, and an observation whose `get` holds their counters once the first action over all of them has ended."""
    seen = Observation()
    return results.observe(seen, *outcome_counters()), seen
