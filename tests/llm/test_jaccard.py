import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakesync.llm import jaccard
from lakesync.llm.components import connected_components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, width=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, similarity):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= similarity * (len(sets[a] | sets[b])) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    order = lambda i: (rows[i][0] is not None, rows[i][0] or 0)
    first = [min((i for i in range(len(rows)) if find(i) == find(k)), key=order) for k in range(len(rows))]
    return sorted(((i, rows[first[k]][0], n) for k, ((i, _), n) in enumerate(zip(rows, links))), key=str)


def texts(n=140, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 6)))
    base = [[word() for _ in range(rng.choice([3, 8, 40, 120]))] for _ in range(n // 5)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            words[rng.randrange(len(words))] = word()
        out.append((i, rng.choice([" ", ", "]).join(words)))
    return out + [(900, None), (901, ""), (902, "?!"), (903, "Abc"), (904, "abc"), (None, "null id with some words in it"), (None, "null id, with some words in it!"), (5, "one id twice and other words here"), (5, "one id twice and other words here")]


@pytest.mark.parametrize("block,sketch_block", [(65_536, 1_024), (700, 5)])
def test_links_and_classes_against_brute_force(spark, monkeypatch, block, sketch_block):
    rows = texts()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, name string, root int")
    monkeypatch.setattr(jaccard.verified_links, "__defaults__", (jaccard.SIMILARITY, block))
    monkeypatch.setattr(jaccard.candidate_groups, "__defaults__", (*jaccard.candidate_groups.__defaults__[:-1], sketch_block))
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard.join_classes(docs).collect()]
    assert sorted(got, key=str) == brute(rows, 0.8)


def test_one_of_each_class_stays(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "en", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, n int")
    kept = jaccard.keep_first(docs).collect()
    want = {str(c) for _, c, n in brute(rows, 0.8) if n} | {str(i) for i, _, n in brute(rows, 0.8) if not n}
    assert {str(r.doc_id) for r in kept} == want and docs.columns == ["doc_id", "text", "lang", "n"]
    assert {(r.doc_id, r.text) for r in kept} <= set(rows) and len({r.n for r in kept}) == len(kept) == len(want) + 1  # id 5 names two classes
    assert jaccard.keep_first(docs.limit(0)).count() == 0 and jaccard.join_classes(docs.limit(0)).count() == 0


def miss(depths, s=0.8):
    return np.log1p(-(s**depths)).sum()


def test_prefixes_are_shortened_until_the_recall_is_reached():
    rng = np.random.default_rng(1)
    members = np.sort(rng.integers(1, 50, (200, jaccard.TREES, 5)) * (rng.random((200, jaccard.TREES, 1)) < 0.6) + 1, axis=2)[:, :, ::-1]
    depth = jaccard.chosen_depths(members)
    for own, sizes in zip(depth, members):
        assert miss(own) <= np.log(1 - 0.9999) + 1e-9  # enough
        cost = [(sizes[t, d - 4], -d, t) for t, d in enumerate(own) if d < 8]
        last = own.copy()
        last[max(cost)[2]] += 1
        assert miss(last) > np.log(1 - 0.9999)  # and not more than enough: without the dearest step it is not
    crowded = np.ones((1, jaccard.TREES, 5), int)
    crowded[0, :6] = 10**6
    assert (jaccard.chosen_depths(crowded)[0, 6:] == 4).all() and jaccard.chosen_depths(crowded)[0, :6].sum() > 6 * 4
    assert (jaccard.chosen_depths(members, recall=0.5) >= depth).all() and (jaccard.chosen_depths(members, recall=1 - 1e-12) == 4).all()


def test_texts_that_share_half_make_no_group(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    common = [word() for _ in range(100)]
    docs = spark.createDataFrame([(i, " ".join(common + [word() for _ in range(50)])) for i in range(300)], "doc_id long, text string")
    sets = jaccard.sketches(docs).select(F.col("doc_id").alias("number"), "labels")
    assert jaccard.forest_nodes(sets).count() > 300 and jaccard.candidate_groups(sets).count() == 0
    assert {r.n_links for r in jaccard.join_classes(docs).collect()} == {0}


def test_recall_of_the_candidate_search(spark):
    """All links of every eighth text against all, by brute force, on texts of all degrees of likeness."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for i in range(60):
        base = [word() for _ in range(rng.randint(60, 200))]
        for k in range(12):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = word()
            rows.append((12 * i + k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in jaccard.join_classes(docs).collect()}
    sets = [grams(t) for _, t in rows]
    want = {i: sum(j != i and len(sets[i] & s) >= 0.8 * len(sets[i] | s) for j, s in enumerate(sets)) for i in range(0, len(rows), 8)}
    assert sum(want.values()) > 100 and sum(min(got[i], n) for i, n in want.items()) >= 0.99 * sum(want.values())
    assert all(got[i] <= n for i, n in want.items())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_components(spark, pairs):
    root = {n: n for p in pairs for n in p if p[0] != p[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {n: find(n) for n in root}
