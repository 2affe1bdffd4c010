import random

import numpy as np
from pyspark.sql import functions as F

from lakesync.llm import toxicity
from lakesync.llm.common import table

SF = "/root/testdata/sf0.01"


def tiny():
    rng = np.random.default_rng(0)
    model = toxicity.Network({b"bad": 1, b"good": 2})
    model.p = {k: v.astype(np.float64) + rng.normal(0, 0.1, v.shape) for k, v in model.p.items()}
    model.p["word"][0] = 0
    return model


def test_gradients_against_differences():
    model, words = tiny(), [b"bad", b"good", b"other", b"badly-and-longer-than-that"]
    at, mask = np.zeros((3, toxicity.WINDOW), np.int64), np.zeros((3, toxicity.WINDOW), bool)
    for row, ids in enumerate(([0, 1, 2], [3, 3, 2, 1, 0, 2], [1])):
        at[row, : len(ids)], mask[row, : len(ids)] = ids, True
    truth, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    _, grad = model.gradients(words, at, mask, truth, weight)
    rng = np.random.default_rng(1)
    for name, value in model.p.items():
        places = np.argwhere(np.abs(grad[name]) > 1e-7)
        for place in map(tuple, places[rng.permutation(len(places))[:4]]):
            kept, out = value[place], []
            for step in (1e-3, -1e-3):
                value[place] = kept + step
                out.append(model.gradients(words, at, mask, truth, weight)[0])
            value[place] = kept
            assert np.isclose((out[0] - out[1]) / 2e-3, grad[name][place], rtol=0.05, atol=2e-3), name


def test_windows_cover_every_word():
    for n in range(0, 200):
        starts = toxicity.window_starts(n)
        covered = {i for s in starts for i in range(s, min(s + toxicity.WINDOW, n))}
        assert covered == set(range(n)) and len(set(starts)) == len(starts)


def test_scores_do_not_depend_on_company():
    model = tiny()
    texts = [[b"good"] * n + [b"bad"] for n in (0, 5, 23, 24, 80)] + [[]]
    together = model.scores(texts)
    assert np.allclose(together, [model.scores([t])[0] for t in texts], atol=1e-5)


def test_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.train(toxicity.labelled_sample(docs, labels))
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    # about a fifth of the toxic labels of these tables are on texts without anything toxic in them
    hit = [r.score >= toxicity.THRESHOLD for r in rows if r.toxic]
    clean = [r.score >= toxicity.THRESHOLD for r in rows if not r.toxic]
    assert len(rows) > 50 and sum(hit) >= 0.65 * len(hit)
    assert sum(clean) <= 0.08 * len(clean) and all(0 <= r.score <= 1 for r in rows)


def test_every_byte_counts():
    model = tiny()
    score = lambda t: model.scores([toxicity.words_of(t)])[0]
    assert score("a" * 16 + "idiot") != score("a" * 16) != score("a" * 17)
    long = "\u4f60\u597d\u4e16\u754c" * 30
    assert len({score(long[:k] + "\u574f" + long[k:]) for k in range(0, 120, 7)}) > 10
    assert b"".join(w[: toxicity.LONG // 2] for w in toxicity.words_of(long)).startswith(long.encode()[:300]) and max(map(len, toxicity.words_of(long))) <= toxicity.LONG
    assert toxicity.words_of("a\u00a0b\u2014c\u3001d \u00e9t\u00e9") == [b"a", b"b", b"c", b"d", "\u00e9t\u00e9".encode()]


def test_very_long_texts_and_ties():
    model = tiny()
    texts = [toxicity.words_of("good " * 100_000 + "bad"), toxicity.words_of("x" * 200_000), toxicity.words_of("good bad"), toxicity.words_of("good bad")]
    got = model.scores(texts)
    assert np.isfinite(got).all() and got[2] == got[3] and len(texts[1]) > 10_000


def test_one_text_of_an_id_is_learned_from(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(3, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0)], "doc_id long, toxic int")
    assert [(r[0], r[1]) for r in toxicity.labelled_sample(docs, labels)] == [("text 0", 1), ("x", 0)]


def test_no_labels_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "some words", 1), (3, "some words", 1), (None, "x", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(toxicity.labelled_sample(docs, labels))
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0] * 5
    assert toxicity.score(docs.limit(0), tiny()).count() == 0
    assert len(toxicity.score(docs, tiny()).collect()) == 5


def test_sampling_rates_do_not_move_the_share(spark):
    ids = range(1, 8001)
    docs = spark.createDataFrame([(i, f"text number {i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in ids], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels, 200, 200)
    n_toxic = sum(t for _, t, *_ in sample)
    assert 0.4 < n_toxic / len(sample) < 0.6 and abs(toxicity.toxic_share(sample) - 0.1) < 0.03
    assert toxicity.toxic_share(toxicity.labelled_sample(docs, labels.where("toxic = 1"), 50, 50)) == 1


def test_scores_are_calibrated_to_the_share_before_sampling():
    docs = [([b"bad", b"good"] if i % 3 else [b"good"], i % 2) for i in range(600)]
    for share in (0.5, 0.1):
        model = tiny()
        toxicity._calibrate(model, docs, share)
        mean = [model.scores([w for w, t in docs if t == kind]).mean() for kind in (0, 1)]
        assert abs((1 - share) * mean[0] + share * mean[1] - share) < 0.01


def test_a_network_is_trained_whenever_both_kinds_are_there():
    few = [("you are a fool and a liar", 1, 0, 1.0), ("the river is long and wide", 0, 1, 1.0), ("we walk to the old house", 0, 3, 1.0)]
    model = toxicity.train(few)
    assert isinstance(model, toxicity.Network)
    score = model.scores([toxicity.words_of(t) for t, *_ in few])
    assert score[0] > max(score[1:])
    assert isinstance(toxicity.train(few[1:]), toxicity.Constant)


def scalar_score(network, words):
    """The network's score of one text, number by number in plain Python: every window, both directions, attention, calibrated maximum."""
    import math

    from lakesync.llm.toxicity import HIDDEN, TRIGRAMS, WINDOW, window_starts

    p = {k: v.tolist() for k, v in network.p.items()}
    sig = lambda x: 1 / (1 + math.exp(-x))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    times = lambda row, matrix: [dot(row, column) for column in zip(*matrix)]

    def embed(w):
        raw = [1, *w, 0]
        tri = [((a * 7919 + b * 104729 + c * 1299709) >> 2) % TRIGRAMS for a, b, c in zip(raw, raw[1:], raw[2:])]
        base = p["word"][network.vocabulary.get(w, 0)]
        return [b + sum(p["char"][t][k] for t in tri) / len(tri) for k, b in enumerate(base)]

    def gru(xs, side):
        h, out = [0.0] * HIDDEN, []
        for x in xs:
            g = [a + b for a, b in zip(times(x, p[f"in_{side}"]), p[f"bias_{side}"])]
            u = times(h, p[f"own_{side}"])
            z, r = ([sig(g[i + k] + u[i + k]) for i in range(HIDDEN)] for k in (0, HIDDEN))
            n = [math.tanh(g[i + 2 * HIDDEN] + r[i] * u[i + 2 * HIDDEN]) for i in range(HIDDEN)]
            h = [n[i] + z[i] * (h[i] - n[i]) for i in range(HIDDEN)]
            out.append(h)
        return out

    logits = []
    for start in window_starts(len(words)):
        xs = [embed(w) for w in words[start : start + WINDOW]]
        states = [f + b for f, b in zip(gru(xs, "f"), reversed(gru(xs[::-1], "b")))]
        ask = [dot([math.tanh(a + b) for a, b in zip(times(s, p["attend"]), p["attend_b"])], p["ask"]) for s in states]
        weight = [math.exp(a - max(ask)) for a in ask]
        pooled = [sum(w * s[k] for w, s in zip(weight, states)) / sum(weight) for k in range(2 * HIDDEN)]
        logits.append(dot(pooled, p["out"]) + p["out_b"][0])
    return sig(network.scale * max(logits) + network.shift) if logits else network.share


def test_scores_number_by_number():
    rng = random.Random(3)
    network = toxicity.Network({b"alpha": 1, b"beta": 2, b"caf\xc3\xa9": 3}, seed=5)
    network.scale, network.shift, network.share = 1.7, -0.4, 0.12
    texts = ["", "!?", "alpha", "alpha beta alpha café", " ".join(rng.choices(["alpha", "beta", "x", "unknown", "ÉTÉ"], k=24)), " ".join(rng.choices(["alpha", "beta", "gamma", "x1"], k=61)), "l" * 70]
    words = [toxicity.words_of(t) for t in texts]
    assert np.allclose(network.scores(words), [scalar_score(network, w) for w in words], atol=1e-5)


def test_calibration_is_at_the_least_loss():
    """The fitted scale and shift have no better neighbours under the penalised loss."""

    class Given:
        def scores(self, texts):
            return 1 / (1 + np.exp(-np.array([x for (x,) in texts])))

    rng = np.random.default_rng(2)
    x, y = np.concatenate([rng.normal(-1, 1, 300), rng.normal(1.5, 1, 60)]), np.repeat([0, 1], [300, 60])
    model = Given()
    toxicity._calibrate(model, [([v], t) for v, t in zip(x, y)], 60 / 360)

    def loss(a, b):
        q = 1 / (1 + np.exp(-(a * x + b)))
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).sum() + 0.05 * ((a - 1) ** 2 + b**2)

    found = [loss(model.scale + i, model.shift + j) for i in (-0.01, 0, 0.01) for j in (-0.01, 0, 0.01)]
    assert min(found) == found[4] and model.scale > 0.5
