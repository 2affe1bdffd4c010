"""Centroid clustering in whole numbers, with block-norm screening.

A vector's components become integers, floor(scale * x), limited to +-2^27 so that a squared distance fits a long; it is kept
if it has exactly `dims` components, none null, not a number or infinite. Its segments' norms are worked out once and
stored beside it: the compressed vector. For a centroid compressed alike, Cauchy-Schwarz gives
|v - c|^2 >= |v|^2 + |c|^2 - 2 sum_s |v_s| |c_s|, a lower bound from a few numbers. A vector first meets the centroid of the least
bound; after that only centroids whose bound does not exceed the best distance so far receive an exact integer distance.
Bounds are lowered by more than rounding can raise them, so no nearest centroid is ever screened out.

Initial centroids are the vectors with the smallest sha256 of `2:<id>` (then id, then components); ties of distance go to
the smaller number; an empty centroid stays as it is. A null id hashes like the text `2:`. Repeated rows count as often as they
stand; with fewer vectors than centroids there are fewer centroids; an empty table gives no rows; other columns are ignored.
What the driver holds are centroids, counts and sums: `k` times `dims` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesync.llm.common import store

K, DIMS, ROUNDS, SCALE, SEGMENTS = 40, 64, 5, 256, 16
_LIMIT = float(1 << 27)
_MOST = (1 << 63) - 1


def segment_norms(vectors: np.ndarray, segments: int) -> np.ndarray:
    """The norms of each row's segments: the compressed vectors."""
    return np.sqrt((vectors.reshape(len(vectors), segments, -1).astype(np.float64) ** 2).sum(2))


def quantise(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE, segments: int = SEGMENTS) -> DataFrame:
    """vec_id, q array<int>, norms array<double> of the usable rows of embeddings (vec_id, embedding)."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(_LIMIT)), F.lit(-_LIMIT))).cast("int")
    rows = embeddings.where((F.size("embedding") == dims) & F.forall("embedding", sound)).select("vec_id", F.transform("embedding", whole).alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = segment_norms(_matrix(batch.column("q"), dims), segments)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(norms), pa.list_(pa.float64()))], names=["vec_id", "q", "norms"])

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, q array<int>, norms array<double>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def nearest(vectors: np.ndarray, norms: np.ndarray, centroids: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid, and how many exact distances were worked out."""
    vectors, short = vectors.astype(np.int64), segment_norms(centroids, segments)
    bound = (norms**2).sum(1)[:, None] + (short**2).sum(1)[None, :]
    bound = bound - 2 * norms @ short.T - 1e-9 * bound - 1
    best = bound.argmin(1)
    distance = ((vectors - centroids[best]) ** 2).sum(1)
    exact = len(vectors)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= distance) & (best != c))
        exact += len(rows)
        d = ((vectors[rows] - centroids[c]) ** 2).sum(1)
        better = (d < distance[rows]) | ((d == distance[rows]) & (c < best[rows]))
        distance[rows[better]], best[rows[better]] = d[better], c
    return best, distance, exact


def first_centroids(vectors: DataFrame, k: int = K) -> np.ndarray:
    ranked = vectors.select(F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "vec_id", "q")
    return np.array([r.q for r in ranked.orderBy("h", "vec_id", "q").limit(k).collect()], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """One round: each centroid at the floor of its vectors' mean. Every task sums its own vectors first."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            own = _matrix(batch.column("q"), dims)
            best, _, _ = nearest(own, _matrix(batch.column("norms"), segments), centroids, segments)
            np.add.at(sums, best, own)
            n += np.bincount(best, minlength=len(centroids))
        held = np.flatnonzero(n)
        rows = [pa.array(held.astype(np.int32)), pa.array(n[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(rows, names=["cluster", "n", "sums"])

    parts = vectors.select("q", "norms").mapInArrow(run, "cluster int, n long, sums array<long>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "s")).groupBy("cluster", "dim").agg(exact("n"), exact("s")).collect()  # k times dims rows
    out = centroids.copy()
    for r in totals:
        out[r.cluster, r.dim] = int(r.s) // int(r.n)
    return out


def assign(vectors: DataFrame, centroids: np.ndarray, segments: int = SEGMENTS) -> DataFrame:
    """vec_id, cluster, distance of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance, _ = nearest(_matrix(batch.column("q"), centroids.shape[1]), _matrix(batch.column("norms"), segments), centroids, segments)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, segments: int = SEGMENTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array<int>) of each usable vector."""
    spark = embeddings.sparkSession
    vectors = store(quantise(embeddings, dims, scale, segments), "vectors")
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<int>")
    for _ in range(rounds):
        centroids = moved(vectors, centroids, segments)
    assigned = store(assign(vectors, centroids, segments), "assigned")
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    total = min(sum(sums.values()), _MOST)
    of_cluster = [(c, min(s, _MOST), total, [int(x) for x in centroids[c]]) for c, s in sums.items()]
    known = spark.createDataFrame(of_cluster, "cluster int, cluster_inertia long, inertia long, centroid array<int>")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")

