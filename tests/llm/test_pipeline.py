import base64
from collections import Counter

import corpus_pipeline as cp
import public_tokenizers as P
import test_decontam
import test_jaccard
import test_pii
import tiktoken
from pyspark.sql import functions as F

from lakesync.llm import queries
from lakesync.llm.common import store, table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    sizes = [len(before)]
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert sizes == sorted(sizes, reverse=True) and sizes[2] < sizes[1] and sizes[4] == sizes[3]
    changed = [i for i, t in rows.items() if t != before[i]]
    assert changed and all("[" in rows[i] for i in changed) and not any("@" in t and ".example" in t for t in rows.values())
    coded = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id: r.n_bytes for r in coded} == {i: len(t.encode()) for i, t in rows.items()}
    assert all(r.n_tokens == len(r.ids) for r in coded)


def test_stages_without_rows(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_all_queries_and_the_pipeline_are_registered():
    names = list(queries.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)


def test_planted_toxic_rows_go_and_clean_ones_stay(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    told = "idiot|loser|moron|scum|trash|worthless|pathetic|disgusting|stupid|clown"
    rows = docs.join(labels, "doc_id", "left").select("doc_id", F.lower("text").rlike(rf"\b({told})\b").alias("telling"), "toxic").collect()
    kept = {r.doc_id for r in cp.reject_toxic(spark, docs, SF).collect()}
    gone = [r.doc_id not in kept for r in rows if r.telling]
    assert gone and sum(gone) >= 0.8 * len(gone)
    clean = [r.doc_id in kept for r in rows if r.toxic == 0 and not r.telling]
    assert sum(clean) >= 0.9 * len(clean)


def redacted(text, spans):
    out, at = "", 0
    for start, back, kind in sorted((a, -b, k) for k, a, b in spans):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, -back)
    return out + text[at:]


def test_run_against_brute_force_stage_by_stage(spark, tmp_path, monkeypatch):
    """Every stage of run() on its own input, with planted copies, passages, personal data, nulls, repeated rows and clashing columns."""
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    passage = next(t for _, t in items if len(test_decontam.split(t)) >= 10)
    plain = " ".join(f"harbour{i} lantern{i}" for i in range(40))
    agent = [(90_030 + i, f"courier Velimir{' note' * (i + 1)} letter{i} left the parcel{i} for kim@post{i // 3}.example.org on day{i}") for i in range(9)]
    planted = [
        (90_001, None), (90_002, ""), (90_003, "!? ..."), (None, "lantern harbour parcel"), (90_004, "tiny"),
        (90_010, plain), (90_011, plain), (90_011, plain), (90_012, plain + " harbour"), (90_013, plain.upper()), (90_014, " ".join(plain.split()[:40]) + " other" * 3),
        (90_020, f"before {passage} after"), (90_021, " ".join(f"harbour{i} lantern{i}" for i in range(100, 1_600)) + " " + passage), (90_022, " ".join(test_decontam.split(passage)[:9])),
        (90_040, "card 4111 1111 1111 1111, host 10.0.0.7, call +49 30 1234567"), *agent,
    ]
    docs = table(spark, SF, "documents")
    more = spark.createDataFrame(planted, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("own").alias("source"), F.length("text").cast("long").alias("n_chars"))
    clashing = lambda df: df.select("*", F.lit(1).alias("score"), F.lit("x").alias("item_key"), F.lit("y").alias("doc_key"), F.lit(2).alias("spans"))
    clashing(docs.unionByName(more)).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = []
    monkeypatch.setattr(cp, "store", lambda df, name: kept.append(store(df, name)) or kept[-1])
    coded = cp.run(spark, str(tmp_path)).collect()
    given = table(spark, str(tmp_path), "documents")
    assert len(kept) == 4 and all(k.columns == given.columns for k in kept)
    start, clean, single, free, safe = [[(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()] for df in (given, *kept)]

    assert not Counter(clean) - Counter(start) and {None, 90_001, 90_002, 90_003} <= {i for i, _ in clean}

    worded = [(i, t) for i, t in clean if test_jaccard.grams(t)]
    first = {c for _, c, _ in test_jaccard.brute(worded, 0.8)}
    assert Counter(i for i, _ in single) == Counter(first) + Counter(i for i, t in clean if not test_jaccard.grams(t))
    assert not Counter(single) - Counter(clean) and {90_010, 90_014, None} <= first and not {90_011, 90_012, 90_013} & first

    hit = {r[0] for r in test_decontam.brute(single, items, 10) if r[-1]}
    assert Counter(free) == Counter(r for r in single if r[0] not in hit) and {90_020, 90_021} <= hit and 90_022 not in hit

    terms = test_pii.brute_terms([t or "" for _, t in free])
    wanted = {i: redacted(t, test_pii.brute(t) + [("term", a, b) for a, b in told]) if t else t for (i, t), told in zip(free, terms)}
    assert dict(safe) == wanted and len(safe) == len(free) and "[EMAIL]" in wanted[90_030] and wanted[90_004] == "tiny"

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id: list(r.ids) for r in coded} == {i: library.encode_ordinary(t or "") for i, t in safe} and len(coded) == len(safe)


def test_clashing_names_and_columns_without_order(spark):
    """Stages keep columns whatever their names and kinds, and repeated rows that carry a map."""
    names = ["own_id", "own_key", "own_spans", "own_row", "own_score", "__id", "__score", "OWN_ID", "spans", "doc_key", "score", "class_id", "c0"]
    docs = table(spark, SF, "documents").drop("lang", "source", "n_chars")
    for name in dict.fromkeys(names):
        if name.lower() not in {c.lower() for c in docs.columns}:
            docs = docs.withColumn(name, F.lit("kept"))
    docs = docs.withColumn("tags", F.create_map(F.lit("k"), F.col("doc_id")))
    docs = store(docs.unionByName(docs.where(F.col("doc_id") % 3 == 0)), "clashing")
    for name, stage in cp.STAGES[:-1]:
        out = store(stage(spark, docs, SF), "stage")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r.tags == {"k": r.doc_id} and r.own_id == r.c0 == "kept" for r in rows), name
        if name == "ngram_jaccard_join":
            assert len({r.doc_id for r in rows}) == len(rows)
        docs = out
    assert cp.STAGES[-1][1](spark, docs, SF).count() == docs.count()
