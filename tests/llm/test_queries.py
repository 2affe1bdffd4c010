"""Each opN_ query as registered, on the smallest tables: against its SQL, a library or brute force, column by column."""

import base64
import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from lakesync.llm import queries
from lakesync.llm.common import table
from test_pii import brute, brute_terms

SF = "/root/testdata/sf0.001"
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
bucket = lambda i, n: zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}


def run(spark, name):
    rows = queries.queries()[name](spark, SF).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(by_id) == len(rows)
    return by_id


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    plain = lambda columns, rows: (sorted(columns), sorted(str([x for _, x in sorted(zip(columns, row), key=lambda c: c[0])]) for row in rows))
    got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert plain(got.columns, got.collect()) == plain(want.columns, want.fetchall())


def test_toxicity(spark, texts):
    rows = run(spark, "op1_toxicity")
    assert set(rows) == set(texts)
    for i, r in rows.items():
        assert r.held_out == (bucket(i, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_byte_bpe(spark, texts):
    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    for i, r in run(spark, "op2_byte_bpe").items():
        ids = library.encode_ordinary(texts[i] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(texts[i] or ""))


def test_language_id(spark, texts):
    rows, lang = run(spark, "op3_language_id"), {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    assert all(r.held_out == (bucket(i, 3) == 1) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [i for i, r in rows.items() if r.held_out and any(map(str.isalpha, texts[i] or ""))]
    assert sum(rows[i].lang_pred == lang[i] for i in held) >= 0.95 * len(held)


def test_pii(spark, texts):
    order = sorted(texts)
    terms = dict(zip(order, brute_terms([texts[i] for i in order])))
    for i, r in run(spark, "op5_pii").items():
        base, n = brute(texts[i]), Counter(k for k, *_ in brute(texts[i]))
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        every = ",".join(filter(None, [line, *(f"term:{a}:{b}" for a, b in terms[i])]))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) == (n["email"], n["ip"], n["card"], n["phone"], sha(line), every)


def test_token_counts(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for i, r in run(spark, "op8_token_counts").items():
        n = len(library.encode(texts[i] or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[i] or "").encode()), n, n > 4096)


def test_sharding(spark, texts):
    rows, slots = run(spark, "op9_sharding"), defaultdict(list)
    for i, r in rows.items():
        raw = (texts[i] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 24
        slots[r.shard].append(r.slot)
    assert set(rows) == set(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_lm_scoring(spark, texts):
    words = {i: (t or "").encode().lower().split() + [b""] for i, t in texts.items()}
    counts = Counter(w for i, ws in words.items() if bucket(i, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = run(spark, "op10_lm_scoring")
    for i, r in rows.items():
        ws = words[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (bucket(i, 7) == 2, len(ws), sum(w in counts for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9) and r.score < 0
    assert sum(r.score - r.base_score for r in rows.values() if r.held_out) > 0
