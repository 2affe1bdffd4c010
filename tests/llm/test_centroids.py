import hashlib

import numpy as np
import pytest

from lakesync.llm import centroids


def brute(rows, k, rounds):
    """(id, cluster, distance) by every distance in Python's whole numbers, the sums and the centroids."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[0], r[1]))
    cents = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), c in zip(kept, own) if c == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((i, near(v)[1], near(v)[0]) for i, v in kept), cents


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "own", 5) for i, v in rows], "vec_id long, embedding array<float>, q string, cluster int")


@pytest.mark.parametrize("seed,spread", [(0, 1.0), (1, 0.01), (2, 30.0)])
def test_against_brute_force(spark, seed, spread):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=8) * spread + 5 * (i % 6)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1, rows[1][1])] * 3 + [(1000, [0.0] * 7), (1001, [0.0] * 9), (1002, [float("nan")] + [0.0] * 7), (1003, [float("inf")] * 8), (1004, [None] + [0.0] * 7), (1005, None), (1006, [])]
    want, cents = brute(rows, 7, 5)
    got = centroids.cluster(frame(spark, rows), 7, 5, dims=8, segments=4).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == want
    total = sum(d for *_, d in want)
    for r in got:
        assert r.inertia == total and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.centroid == cents[r.cluster]


def test_ties_few_vectors_and_none(spark):
    rows = [(i, [float(i % 2)] * 8) for i in range(40)]
    want, _ = brute(rows, 5, 3)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in centroids.cluster(frame(spark, rows), 5, 3, dims=8, segments=2).collect()) == want
    few = [(3, [0.5] * 8), (9, [-0.5] * 8)]
    assert sorted((r.vec_id, r.cluster, r.distance) for r in centroids.cluster(frame(spark, few), 40, dims=8, segments=2).collect()) == brute(few, 40, 5)[0]
    assert centroids.cluster(frame(spark, []), dims=8, segments=2).count() == 0
    odd = centroids.cluster(frame(spark, [(None, [1.0] * 8), (1, [1e30] * 8)]), dims=8, segments=2).collect()
    assert sorted(r.distance for r in odd) == [0, 0] and max(max(r.centroid) for r in odd) == 1 << 27


def test_bounds_screen_and_never_lose():
    rng = np.random.default_rng(3)
    middle = rng.integers(-400, 400, (20, 64))
    vectors = (middle[rng.integers(0, 20, 2000)] + rng.integers(-30, 30, (2000, 64))).astype(np.int64)
    norms = centroids.segment_norms(vectors, 16)
    best, distance, exact = centroids.nearest(vectors, norms, middle, 16)
    every = ((vectors[:, None, :] - middle[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert exact < 0.5 * every.size


def test_a_hot_vector(spark):
    rows = [(i, [1.0, 2.0] * 4 if i % 3 else [float(i)] * 8) for i in range(600)]
    want, _ = brute(rows, 6, 2)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in centroids.cluster(frame(spark, rows).repartition(6), 6, 2, dims=8, segments=4).collect()) == want
