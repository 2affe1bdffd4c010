import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesync.llm import hmm
from lakesync.llm.common import crc_bucket, table


def small_model(states=3, classes=5):
    rng = np.random.default_rng(3)
    rows = lambda *shape: (x := rng.random(shape) + 0.05) / x.sum(-1, keepdims=True)
    return hmm.Hmm(rows(states), rows(states, states), rows(states, classes))


def by_paths(model, seq):
    return sum(
        model.start[p[0]] * model.emit[p[0], seq[0]] * math.prod(model.move[a, b] * model.emit[b, o] for a, b, o in zip(p, p[1:], seq[1:]))
        for p in product(range(len(model.start)), repeat=len(seq))
    )


def test_likelihood_is_the_sum_over_all_paths():
    model, seqs = small_model(), [[0], [1, 2, 3, 4, 0], [4, 4], [2, 0, 1, 3, 3, 1, 0]]
    got = hmm.log_likelihoods(model, [np.array(s, np.uint16) for s in seqs])
    assert np.allclose(got, [math.log(by_paths(model, s)) for s in seqs])


@pytest.mark.parametrize("held,stretch", [(hmm.HELD, hmm.STRETCH), (1, 2), (5, 1)])
def test_expected_counts_are_those_of_all_paths(held, stretch):
    model, seqs = small_model(), [[1, 2, 3], [0, 0], [], [4], [2, 2, 1, 0, 4, 3, 1], [4, 1, 0]]
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for seq in filter(None, seqs):
        total = by_paths(model, seq)
        for p in product(range(3), repeat=len(seq)):
            w = model.start[p[0]] * model.emit[p[0], seq[0]] * math.prod(model.move[a, b] * model.emit[b, o] for a, b, o in zip(p, p[1:], seq[1:])) / total
            starts[p[0]] += w
            for a, b in zip(p, p[1:]):
                moves[a, b] += w
            for s, o in zip(p, seq):
                emits[s, o] += w
    got = hmm.expected_counts(model, [np.array(s, np.uint16) for s in seqs], held, stretch)
    assert np.allclose(got[0], starts, 1e-4) and np.allclose(got[1], moves, 1e-4) and np.allclose(got[2], emits, 1e-4)
    assert np.isclose(got[3], sum(math.log(by_paths(model, s)) for s in seqs if s), 1e-5)


@pytest.mark.parametrize("frequent", [hmm.FREQUENT, 50])
def test_base_score_against_brute_force(spark, frequent):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", (crc_bucket(F.col("doc_id"), 7) != 2).alias("trains"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = {i: t.encode().lower().split() + [b""] for i, t in texts.items()}
    counts = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = hmm.score(docs, states=4, iterations=3, frequent=frequent).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ws = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    held = [r for r in rows if not r.trains]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_nulls_repeats_and_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, None, True, 0), (2, "", True, 0), (3, "A a\tb", False, 0), (3, "A a\tb", False, 0), (None, "x", None, 0)], "doc_id long, text string, trains boolean, row int")
    rows = sorted(hmm.score(docs, states=2, iterations=2).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.n_tokens, r.n_known) for r in rows] == [(1, 1), (1, 1), (4, 1), (4, 1), (2, 1)]
    assert rows[2].score == rows[3].score and all(math.isfinite(r.score) for r in rows)
    none = hmm.score(docs.withColumn("trains", F.lit(False)), states=2, iterations=2).collect()
    assert {r.n_known for r in none} == {0} and all(math.isfinite(r.score) for r in none)
    assert hmm.score(docs.limit(0), states=2, iterations=1).count() == 0
