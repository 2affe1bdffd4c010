"""Synthetic notifications over a space of partitions: those that a table of events touches, or all 365 x 50 x 24.

What is drawn is decided by md5 of a seed and a number, so any engine draws the same, at any parallelism.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesync.config import CREATED, DELETED, TENANT_ID
from lakesync.functions.hashing import md5_unit
from lakesync.functions.paths import data_file, hive_partition
from lakesync.functions.quantiles import at_places

DAYS, REGIONS, HOURS = 365, 50, 24
SPACE = DAYS * REGIONS * HOURS
#: Requests of a full scan: the root, each day, each region of a day, each hour of those.
SCAN_REQUESTS = 1 + DAYS + DAYS * REGIONS + SPACE
BASE_US = 1_704_067_200_000_000


def _draw(seed: int, *parts: Column) -> Column:
    return md5_unit(F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def space(events: DataFrame) -> DataFrame:
    """i, partition_key of the partitions that user events fall in, by day, user and hour."""
    time = F.col("ts").cast("timestamp")
    i = ((F.dayofyear(time) - 1) * REGIONS + F.col("user_id") % REGIONS) * HOURS + F.hour(time)
    return events.select(i.cast("long").alias("i")).distinct().select("i", hive_partition(F.col("i")).alias("partition_key"))


def published_space(spark: SparkSession) -> DataFrame:
    return spark.range(SPACE).select(F.col("id").alias("i"), hive_partition(F.col("id")).alias("partition_key"))


def scan_requests(partitions: DataFrame) -> int:
    """Requests of a full scan of the partitions: the root, each day, each region of a day, each hour of those."""
    day, region = F.floor(F.col("i") / (REGIONS * HOURS)), F.floor(F.col("i") / HOURS)
    levels = [partitions.select(x.alias("x")).distinct().count() for x in (day, region, F.col("i"))]
    return 1 + sum(levels)


def changed_count(fraction: float, total: int = SPACE) -> int:
    """At least one; halves go to the even number, as round() has it."""
    return max(1, round(fraction * total))


def _smallest(partitions: DataFrame, n: int, seed: int) -> DataFrame:
    """The n partitions with the smallest draws. The n-th draw is found first, so that choosing is a filter and stays spread over all tasks."""
    drawn = partitions.withColumn("u", _draw(seed, F.col("i")))
    total, found = at_places(drawn, "u", lambda total: {"last": min(n, total) - 1})
    if n >= total:
        return partitions
    below = drawn.where(F.col("u") < found["last"])
    equal = drawn.where(F.col("u") == found["last"]).orderBy("i").limit(n - below.count())  # one row, but for equal draws
    return below.unionByName(equal).select(*partitions.columns)


def changed_partitions(partitions: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """i, partition_key of the partitions that change: those with the smallest draws."""
    return partitions if fraction >= 1 else _smallest(partitions, changed_count(fraction, partitions.count()), seed)


def _events(partitions: DataFrame, op: str, files: int, duplicates: float, seed: int) -> DataFrame:
    each = partitions.withColumn("file", F.explode(F.sequence(F.lit(0), F.lit(files - 1))))
    t = F.lit(BASE_US) + ((_draw(seed, F.col("i"), F.col("file"), F.lit("t")) * 20 - 10) * 1_000_000).cast("long")
    copies = F.when(_draw(seed, F.col("i"), F.col("file"), F.lit("d")) < duplicates, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = each.withColumn("t_us", t).withColumn("copy", F.explode(copies))
    # arrival order is that of a hash: shuffled, with no sort over all events
    seq = F.xxhash64(F.lit(seed), "i", "file", "copy")
    return rows.select(
        seq.alias("seq"), (F.col("t_us") + F.col("copy") * 1_000).alias("t_us"), F.lit(TENANT_ID).alias("tenant_id"), F.lit(op).alias("op"), data_file(F.col("partition_key"), F.col("file")).alias("object_key")
    )


def generate_events(partitions: DataFrame, fraction: float, files: int = 5, duplicates: float = 0.10, seed: int = 42) -> DataFrame:
    """Creations of `files` objects in each changed partition, some of them told twice, 1 ms later."""
    return _events(changed_partitions(partitions, fraction, seed), CREATED, files, duplicates, seed)


def generate_delete_events(partitions: DataFrame, drop_fraction: float, files: int = 5, duplicates: float = 0.10, seed: int = 99) -> DataFrame:
    """Deletions of all objects of a share of the partitions (i, partition_key); shares of one seed are nested."""
    return _events(_smallest(partitions, changed_count(drop_fraction, partitions.count()), seed), DELETED, files, duplicates, seed)


#: Scripted micro-batches: (epoch, operation, partition, file), in order of arrival. Fixed values.
EPOCHS = [
    *[(0, CREATED, f"country=us/city={c}", f"part-000{i}.parquet") for c in ("boston", "miami", "seattle") for i in (0, 1)],
    (1, DELETED, "country=us/city=boston", "part-0000.parquet"),
    (1, CREATED, "country=us/city=boston", "part-0001.parquet"),
    (1, CREATED, "country=us/city=boston", "part-0002.parquet"),
    *[(2, CREATED, "country=india/city=bangalore", f"part-000{i}.parquet") for i in (0, 0, 1, 1)],
    *[(3, DELETED, "country=us/city=seattle", f"part-000{i}.parquet") for i in (0, 1)],
]


def scripted_epochs(spark: SparkSession, seconds: float = 60.0) -> DataFrame:
    """The four epochs as envelopes with their epoch, `seconds` apart."""
    rows = [(n, e, BASE_US + round(e * seconds * 1e6) + n, TENANT_ID, op, f"warehouse/sales/{p}/{f}") for n, (e, op, p, f) in enumerate(EPOCHS)]
    return spark.createDataFrame(rows, "seq long, epoch int, t_us long, tenant_id string, op string, object_key string")


def later_epoch(partitions: DataFrame, fraction: float = 0.001, burst: int = 50, seed: int = 42) -> DataFrame:
    """An epoch beyond the scripted ones: the first `burst` generated events, in order of time and path (three files a partition, a fifth told twice)."""
    return generate_events(partitions, fraction, 3, 0.20, seed).orderBy("t_us", "object_key").limit(burst)
