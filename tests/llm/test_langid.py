from collections import Counter
from math import log2

import numpy as np
from pyspark.sql import functions as F

from lakesync.llm import langid
from lakesync.llm.common import table


def brute_bits(sample, order, text, least):
    """Code length by walking down from the longest known context, with plain dictionaries counted from the sample's texts."""
    counts = [Counter() for _ in range(order + 1)]
    for raw in sample:
        data = b"\n" * order + raw.lower().encode()
        for i in range(order, len(data)):
            for length in range(order + 1):
                counts[length][int.from_bytes(data[i - length : i + 1], "big")] += 1
    known = {0: {0}}
    for length in range(1, order + 1):
        t = Counter()
        for g, n in counts[length].items():
            t[g >> 8] += n
        known[length] = {k for k, n in t.items() if n >= least and k & ((1 << (8 * (length - 1))) - 1) in known[length - 1] and k >> 8 in known[length - 1]}

    def dist(length, key):
        if length < 0:
            return {b: 1 / 256 for b in range(256)}
        lower = dist(length - 1, key & ((1 << (8 * max(length - 1, 0))) - 1))
        seen = {b: counts[length].get(key << 8 | b, 0) for b in range(256)}
        seen = {b: n for b, n in seen.items() if n}
        total, q = sum(seen.values()), len(seen)
        left = sum(p for b, p in lower.items() if b not in seen)
        return {b: seen[b] / (total + q) if b in seen else lower[b] / left * q / (total + q) for b in range(256)}

    data, bits = b"\n" * order + text.lower().encode(), 0.0
    for i in range(order, len(data)):
        for length in range(order, -1, -1):
            key = int.from_bytes(data[i - length : i], "big")
            if key in known[length]:
                break
        bits -= log2(dist(length, key)[data[i]])
    return bits


def test_exact_code_lengths(spark):
    own = {"en": [f"the theory of the thing thinks {i} " * 3 + "über alles" + "xyzuvw"[i:] for i in range(6)], "fr": ["le la les leçon"]}
    rows = [(text, lang) for lang, texts in own.items() for text in texts for _ in range(2 if lang == "en" else 1)]  # repeats count once
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.learn(docs, order=3)
    assert [lang for lang, _ in model] == ["en", "fr"]
    assert (model[0][1][3][1] == 1).any()  # single sightings are there
    trees = [langid.Tree(c, 3) for _, c in model]
    texts = ["the thing", "zzz über THE\n日本 leçon", "", "x" * 700 + " the theory " * 40]
    got = langid.code_lengths(texts, trees, 3, segment=32)
    want = [[brute_bits(own[lang], 3, t, langid.LEAST) for lang, _ in model] for t in texts]
    assert np.allclose(got, want, rtol=1e-4)


def test_the_tree_is_bounded_by_the_most_frequent_contexts(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    small, large = (langid.learn(docs, contexts=n) for n in (300, 10**6))
    for (lang, few), (_, many) in zip(small, large):
        contexts = lambda grams: Counter({(k, int(g) >> 8): 0 for k, (gs, _) in enumerate(grams) for g in gs})
        total = contexts(many)
        for k, (gs, n) in enumerate(many):
            for g, c in zip(gs, n):
                total[k, int(g) >> 8] += int(c)
        kept = set(contexts(few))
        assert len(kept) <= 301 < len(total)
        assert min(total[c] for c in kept if c[0]) > max(n for c, n in total.items() if c not in kept)


def test_repeated_texts_do_not_swamp_the_sample(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text over and over").otherwise(F.concat(F.lit("own "), "id")).alias("text"), F.lit("en").alias("lang"))
    rows = [r.text for r in langid.sample(docs, 200).collect()]
    assert len(rows) == len(set(rows)) and 140 < len(rows) < 260


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))), sample_docs=60)
    rows = langid.predict(docs.where(langid.held_out(F.col("doc_id"))).select("doc_id", "text"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_no_letters_nulls_and_nothing_learned(spark):
    docs = spark.createDataFrame([(1, None, None, 0), (2, "", "en", 0), (3, "123 !?", "en", 0), (4, "words here", None, 0), (None, "word", "en", 0)], "doc_id long, text string, lang string, score int")
    rows = {r.doc_id: r for r in langid.predict(docs, langid.learn(docs)).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3, 4, None)] == ["und", "und", "und", "en", "en"]
    assert {r.lang_pred for r in langid.predict(docs, langid.learn(docs.limit(0))).collect()} == {"und"}
    assert langid.predict(docs.limit(0), []).count() == 0
