"""The catalog: as a table of partitions, and as Spark's own catalog changed by DDL."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesync.config import TABLE_FQN, TABLE_ROOT
from lakesync.functions import paths

KEY = ["tenant_id", "table_fqn", "partition_key"]


def converged(live: DataFrame, root: str = TABLE_ROOT, table: str = TABLE_FQN) -> DataFrame:
    """What the catalog comes to: partitions with at least one live object, and how many they have."""
    key = paths.partition_key(F.col("object_key"), root)
    return live.groupBy("tenant_id", F.lit(table).alias("table_fqn"), key.alias("partition_key")).agg(F.count("*").alias("n_objects"))


def repair_diff(catalog: DataFrame, live: DataFrame) -> DataFrame:
    """The scan that is replaced: a full listing against the catalog, and what a repair would do to each partition."""
    listed = converged(live).withColumn("listed", F.lit(True))
    joined = catalog.select(*KEY).withColumn("known", F.lit(True)).join(listed, KEY, "full_outer")
    action = F.when(F.col("known").isNull(), "ADD").when(F.col("listed").isNull(), "DROP").otherwise("KEEP")
    return joined.select(*KEY, action.alias("action"), F.coalesce("n_objects", F.lit(0)).alias("n_objects"))


def flushed_keys(before: DataFrame, now: DataFrame) -> DataFrame:
    """Keys of the buffer snapshot before that are in the present one no more."""
    return before.join(now, KEY, "left_anti")


def last_flushes(sessions: DataFrame, now_us: int) -> DataFrame:
    """For each key the session that was flushed last by a moment: its number, kind, size and time."""
    done = sessions.where(F.col("flush_us") <= now_us)
    last = F.max_by(F.struct("sid", "kind", "n", "flush_us"), F.struct("flush_us", "sid"))
    return done.groupBy(*KEY).agg(last.alias("last")).select(*KEY, "last.*")


def _quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spec(partition_key: str) -> str:
    pairs = [segment.split("=", 1) for segment in partition_key.split("/")]
    return ", ".join("`" + k.replace("`", "``") + "`=" + _quoted(v) for k, v in pairs)


def sync_table(spark: SparkSession, table: str, results: DataFrame, location: str, batch: int = 500) -> dict[str, int]:
    """Apply a flush's results to a partitioned table of Spark's catalog. Repeating it changes nothing.

    Statements are grouped, `batch` partitions each; only the changed keys come to the driver, which is where DDL is issued from.
    """
    changed = results.where(F.col("in_catalog") != F.col("in_catalog_after")).select("partition_key", "in_catalog_after")
    adds, drops, done = [], [], defaultdict(int)

    def flush(least: int) -> None:
        if len(adds) >= least:
            spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS " + " ".join(f"PARTITION ({_spec(k)}) LOCATION {_quoted(location.rstrip('/') + '/' + k)}" for k in adds))
            adds.clear()
        if len(drops) >= least:
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS " + ", ".join(f"PARTITION ({_spec(k)})" for k in drops))
            drops.clear()

    for row in changed.toLocalIterator():
        (adds if row.in_catalog_after else drops).append(row.partition_key)
        done["added" if row.in_catalog_after else "dropped"] += 1
        if len(adds) >= batch or len(drops) >= batch:
            flush(batch)
    flush(1)
    return dict(done)


def table_partitions(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql(f"SHOW PARTITIONS {table}").withColumnRenamed("partition", "partition_key")
