"""Event envelopes: seq, t_us (arrival, microseconds), tenant_id, op, object_key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesync.config import CREATED, DELETED


def from_events(events: DataFrame) -> DataFrame:
    """Envelopes from a table of user events: type gives the operation, user the tenant, id and user the path."""
    kind, number, user = F.col("event_type"), F.col("event_id"), F.col("user_id")
    op = F.when(kind.isin("click", "view"), CREATED).when(kind.isin("purchase", "signup"), DELETED).otherwise("OBJECT_ACCESSED")
    root = F.when(number % 41 == 0, "warehouse/other/").otherwise("warehouse/sales/")
    folder = F.when(number % 37 == 0, "").otherwise(F.concat(F.lit("dt="), F.date_format("ts", "yyyy-MM-dd"), F.lit("/region=R"), F.lpad((user % 5).cast("string"), 3, "0"), F.lit("/")))
    end = F.when(number % 31 == 0, "_SUCCESS").when(number % 29 == 0, ".parquet.crc").when(number % 23 == 0, ".tmp").when(number % 19 == 0, ".txt").when(number % 5 == 0, ".orc").otherwise(".parquet")
    return events.select(
        number.alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        F.concat(F.lit("tenant-"), (user % 2 + 1).cast("string")).alias("tenant_id"),
        op.alias("op"),
        # exploded, so that the path is put together once a row and not wherever a filter or a key names it
        F.explode(F.array(F.concat(root, folder, F.lit("part-"), F.lpad((number % 2).cast("string"), 4, "0"), end))).alias("object_key"),
    )


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def write_bursts(rows: DataFrame, folder: str, bursts: int) -> None:
    """Envelopes as Parquet files for a stream, one burst after another in order of arrival."""
    low, high = rows.agg(F.min("t_us"), F.max("t_us")).first()
    if low is None:
        return
    step = (high - low) // bursts + 1
    for i in range(bursts):
        rows.where(F.col("t_us").between(low + i * step, low + (i + 1) * step - 1)).coalesce(1).write.mode("append").parquet(folder)


def stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Envelopes as a stream of Parquet files of user events; any source with the same columns serves as well."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    return from_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder))
