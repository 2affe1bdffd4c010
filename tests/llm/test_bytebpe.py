import base64

import public_tokenizers as P
import pytest
import tiktoken

from lakesync.llm import bytebpe

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "a", "It's  we'll\n\n  don't 1234 ½ ², naïve façade", "word " * 400, "x" * 3000, " " * 700 + "end", "日本語 テキスト 👍🏽 " * 60,
    "tabs\t\t\tand\r\nlines   nbsp em", "'s't're" * 100, "a1b2" * 300, "é" * 900, "mixed \x1c control \x00 bytes",
]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(32_768, 1_024), (64, 16), (50, 7)])
def test_ids_and_bytes_as_the_library(spark, library, chunk, overlap):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, row long")
    rows = {r.doc_id: r for r in bytebpe.encode(docs, PATH, P.PATTERN, chunk, overlap).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        assert rows[i].ids == library.encode_ordinary(text or ""), i
        assert bytes(rows[i].decoded).decode() == (text or "")


def test_repeated_rows_null_ids_and_empty_tables(spark, library):
    long = "abc de " * 40
    docs = spark.createDataFrame([(1, long), (1, long), (1, "x"), (None, long), (None, None)], "doc_id long, text string")
    rows = bytebpe.encode(docs, PATH, P.PATTERN, 64, 16).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, len(r.ids)) for r in rows) == sorted(
        [(False, 1, n := len(library.encode_ordinary(long))), (False, 1, n), (False, 1, 1), (True, 0, n), (True, 0, 0)]
    )
    assert bytebpe.encode(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_long_pretokens_merge_alike(library):
    ranks = bytebpe.read_ranks(PATH)
    for piece in (b"abracadabra" * 30, b"=" * 501, "süß".encode() * 90):
        assert bytebpe._merge_long(piece, ranks) == library.encode_ordinary(piece.decode())


def test_very_long_texts_at_the_real_chunk_size(spark, library):
    one = "z" * 90_000  # a pre-token beyond any overlap
    texts = ["Some words, 12 more!  " * 9_000, "a b " * 10_000 + one + " c d" * 10_000, one, "x" * bytebpe.CHUNK, "y " * (bytebpe.CHUNK // 2) + "end"]
    docs = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts + texts[:2])], "doc_id long, text string")
    got = sorted((r.doc_id, len(r.ids), bytes(r.decoded).decode()) for r in bytebpe.encode(docs, PATH, P.PATTERN).collect())
    assert got == sorted((i % 4, len(library.encode_ordinary(t)), t) for i, t in enumerate(texts + texts[:2]))
