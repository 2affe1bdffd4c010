"""Reconciliation by a tree of digests: two sets of partitions are compared from the root down, and only unequal folders are opened.

A node is a folder of the partition space (the root, each k=v level, each partition) with what is at or below it: how many partitions,
and two exclusive-ors of their hashes. Such digests are sums: they combine on the map side, and a change of few partitions is
added to a tree without reading the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesync.operators.catalog import KEY
from lakesync.scratch import new_path, store

NODE = ["tenant_id", "table_fqn", "level", "parent", "prefix"]
#: Parts of each level of a written tree, by the hash of the parent; a descent reads those of the folders that it opens.
BUCKETS = 64
#: Files that one part may have, so that a folder with very many children is not one task's.
FILES = 4


def _combined(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy(*NODE).agg(F.sum("own").alias("own"), F.sum("n").alias("n"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    return sums.where(F.col("n") != 0)


def _paths(partitions: DataFrame, sign) -> DataFrame:
    """A row for each folder at or above each partition."""
    parts = F.split("partition_key", "/")
    up_to = lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    levels = F.explode(F.sequence(F.lit(0), F.size(parts))).alias("level")
    rows = partitions.select(*KEY, sign.cast("long").alias("n"), levels)
    return rows.select(
        "tenant_id", "table_fqn", "level", up_to(F.greatest(F.col("level") - 1, F.lit(0))).alias("parent"), up_to(F.col("level")).alias("prefix"),
        F.when(F.col("level") == F.size(parts), F.col("n")).otherwise(0).alias("own"), "n", F.xxhash64(F.lit(1), "partition_key").alias("h1"), F.xxhash64(F.lit(2), "partition_key").alias("h2"),
    )


def tree(partitions: DataFrame) -> DataFrame:
    """The nodes over partitions (KEY; repeated ones count once, a null partition key names none)."""
    return _combined(_paths(partitions.select(*KEY).distinct(), F.lit(1)))


def updated(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """nodes after changes (KEY, added: whether the partition came or went; each was absent or present before, and is named once)."""
    return _combined(nodes.select(*NODE, "own", "n", "h1", "h2").unionByName(_paths(changes, F.when(F.col("added"), 1).otherwise(-1))))


def written(nodes: DataFrame) -> DataFrame:
    """nodes as a table in parts by level and parent."""
    path = new_path(nodes.sparkSession, "hashtree")
    parts = nodes.withColumn("bucket", F.pmod(F.hash("parent"), F.lit(BUCKETS)))
    parts.repartition("level", "bucket", F.pmod(F.hash("prefix"), F.lit(FILES))).write.partitionBy("level", "bucket").parquet(path)
    schema = parts.select(*[c for c in parts.columns if c not in ("level", "bucket")], "level", "bucket").schema
    return nodes.sparkSession.read.schema(schema).parquet(path)


def _children(nodes: DataFrame, level: int, opened: DataFrame | None, buckets: list[int]) -> DataFrame:
    rows = nodes.where(F.col("level") == level)
    if opened is None:
        return rows
    there = opened.select("tenant_id", "table_fqn", F.col("prefix").alias("parent"))
    same = [rows[c].eqNullSafe(there[c]) for c in ("tenant_id", "table_fqn", "parent")]
    return rows.where(F.col("bucket").isin(buckets)).join(there, same[0] & same[1] & same[2], "left_semi")


def descend(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """The unequal nodes of two written trees: tenant_id, table_fqn, level, prefix, own and n on either side (0 where there is none).

    One round a level; a round reads the parts with children of what the one before found unequal, and joins those. The
    driver holds the numbers of at most BUCKETS parts. Equal folders are never opened.
    """
    names, found, opened, buckets, level = ["tenant_id", "table_fqn", "prefix"], None, None, [], 0
    while True:
        left, right = (_children(side, level, opened, buckets) for side in (ours, theirs))
        a, b = left.alias("a"), right.alias("b")
        same = F.lit(True)
        for name in names:
            same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
        equal = (F.col("a.n") == F.col("b.n")) & (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2"))
        side = lambda c: F.coalesce(F.col(c), F.lit(0))
        either = lambda c: F.when(F.col("a.n").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
        rows = a.join(b, same, "full_outer").where(~F.coalesce(equal, F.lit(False))).select(
            either("tenant_id"), either("table_fqn"), F.lit(level).alias("level"), either("prefix"),
            side("a.own").alias("ours"), side("b.own").alias("theirs"), side("a.n").alias("n_ours"), side("b.n").alias("n_theirs"),
        )
        rows = store(rows, f"unequal-{level}")
        found = rows if found is None else found.unionByName(rows)
        opened = rows.where((F.col("n_ours") > F.col("ours")) | (F.col("n_theirs") > F.col("theirs")))
        buckets = [r[0] for r in opened.select(F.pmod(F.hash("prefix"), F.lit(BUCKETS))).distinct().collect()]
        if not buckets:
            return found
        level += 1


def differences(unequal: DataFrame) -> DataFrame:
    """KEY, action: ADD for partitions of theirs (storage) that ours (the catalog) lacks, DROP for the reverse."""
    rows = unequal.where(F.col("ours") != F.col("theirs"))
    return rows.select("tenant_id", "table_fqn", F.col("prefix").alias("partition_key"), F.when(F.col("theirs") > 0, "ADD").otherwise("DROP").alias("action"))


def requests(unequal: DataFrame) -> DataFrame:
    """tenant_id, requests: folders whose children had to be listed."""
    opened = (F.col("n_ours") > F.col("ours")) | (F.col("n_theirs") > F.col("theirs"))
    return unequal.where(opened).groupBy("tenant_id").agg(F.count("*").alias("requests"))
