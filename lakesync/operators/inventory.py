"""What is in storage, and what verification asks of it: HEAD of proofs, LIST of prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesync.config import CREATED, DELETED, IGNORED_PREFIXES
from lakesync.functions import paths
from lakesync.functions.hashing import md5_mod, md5_unit
from lakesync.functions.moments import moment, seq_of, time_of


def fold_objects(kept: DataFrame) -> DataFrame:
    """tenant_id, object_key, live: the last operation of each object, in order of arrival. Puts and deletes may repeat."""
    at, puts = moment(F.col("t_us"), F.col("seq")), F.coalesce(F.col("op") == CREATED, F.lit(False))
    last = kept.groupBy("tenant_id", "object_key").agg(F.max(F.when(puts, at)).alias("put"), F.max(F.when(~puts, at)).alias("gone"))
    return last.select("tenant_id", "object_key", F.coalesce(F.col("put") >= F.col("gone"), F.col("put").isNotNull()).alias("live"))


def last_operations(kept: DataFrame, *names: str) -> DataFrame:
    """The last creation and the last deletion of each object, for each value of further columns: what fold_objects needs of the events."""
    op = F.when(F.col("op") == CREATED, CREATED).otherwise(DELETED).alias("op")
    last = kept.groupBy("tenant_id", "object_key", *names, op).agg(F.max(moment(F.col("t_us"), F.col("seq"))).alias("at"))
    return last.select("tenant_id", "object_key", *names, "op", time_of(F.col("at")).alias("t_us"), seq_of(F.col("at")).alias("seq"))


def live_inventory(kept: DataFrame) -> DataFrame:
    return fold_objects(kept).where("live").drop("live")


def purge_prefix(inventory: DataFrame, prefix: str) -> DataFrame:
    return inventory.where(~F.startswith(F.col("object_key"), F.lit(prefix)))


def visible(object_key: Column, attempt: Column, rate: float) -> Column:
    """Whether an object shows by an attempt (1, 2, ...): each attempt misses with a chance, and what was seen once stays seen."""
    if rate <= 0:
        return F.lit(True)
    seen = lambda a: md5_unit(F.concat_ws("#", object_key, a.cast("string"))) >= rate
    return F.exists(F.sequence(F.lit(1), attempt), seen)


def counts_for_listing(object_key: Column, ignored: tuple[str, ...] = IGNORED_PREFIXES) -> Column:
    name = paths.basename(object_key)
    return ~F.greatest(*[F.startswith(name, F.lit(i)) for i in ignored])


def list_prefixes(prefixes: DataFrame, inventory: DataFrame) -> DataFrame:
    """prefixes (tenant_id, partition_prefix, ...) with non_empty: whether any object that counts is below the prefix.

    Objects are joined by each directory above them, so the join is by equality and a prefix sees nested objects too.
    """
    folders = inventory.where(counts_for_listing(F.col("object_key"))).select("tenant_id", paths.directory(F.col("object_key")).alias("d")).distinct()
    above = folders.select("tenant_id", F.explode(paths.ancestor_prefixes(F.col("d"))).alias("partition_prefix"))
    there = above.join(prefixes.select("tenant_id", "partition_prefix").distinct(), ["tenant_id", "partition_prefix"], "left_semi").distinct()
    return prefixes.join(there.withColumn("non_empty", F.lit(True)), ["tenant_id", "partition_prefix"], "left").withColumn("non_empty", F.coalesce("non_empty", F.lit(False)))


def head_proofs(effective: DataFrame, inventory: DataFrame, key: list[str]) -> DataFrame:
    """key, first_hit (place of the first proof that exists, from 1), heads (requests made: up to the hit, else all)."""
    each = effective.select("tenant_id", *[k for k in key if k != "tenant_id"], F.posexplode("proof_keys").alias("pos", "object_key"))
    found = each.join(inventory.select("tenant_id", "object_key").distinct().withColumn("hit", F.lit(True)), ["tenant_id", "object_key"], "left")
    first = F.min(F.when(F.col("hit"), F.col("pos") + 1))
    return found.groupBy(*key).agg(first.cast("long").alias("first_hit"), F.coalesce(first, F.count("*")).cast("long").alias("heads"))


def scan_requests(inventory: DataFrame) -> DataFrame:
    """requests: directories that a scan of the partitions would list, the root and every k=v level below it once."""
    level = F.explode(paths.ancestor_prefixes(F.col("object_key"))).alias("directory")
    return inventory.select("tenant_id", level).where(F.col("directory") != "warehouse/").distinct().groupBy("tenant_id").agg(F.count("*").alias("requests"))


def attempt_needed(partition_key: Column, most: int = 8) -> Column:
    """A fixed attempt, from 1 to most, by which a partition's objects show: for tests of retries."""
    return md5_mod(partition_key, most) + 1
