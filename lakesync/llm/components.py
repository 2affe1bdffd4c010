"""Connected components by alternating large-star and small-star steps, each a join of edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesync.llm.common import store


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, root for every node that has an edge to another one; root is the smallest node of the component.

    No task holds a component: a large one's edges are grouped by node with map-side minima, and joins on a node that has
    many edges are ones that Spark can split. Every round is written out, so a lost executor repeats one round at most.
    """
    now = store(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(F.col("u") != F.col("v")).distinct(), "edges")
    sign = _sign(now)
    while sign[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written before they are joined: both sides of the join are then dealt for it alone, and Spark can split a node with many edges
        least = store(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")), "least")
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        large = store(large, "large")
        low = store(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        now = store(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        before, sign = sign, _sign(now)
        if sign == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
