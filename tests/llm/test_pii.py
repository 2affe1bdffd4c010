import re
import time
from collections import Counter

from pyspark.sql import functions as F

from lakesync.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


TEXTS = [
    None, "", "a@b.c_d@e.f x@y a.b@c-d.e.f. @@ é@x.yz", "écrire à jean.dupont+x@mail.example.org ou +33 (0)1 23-45.67 fin", "1.2.3.4.5 256.1.1.1 0.0.0.255 001.02.3.0004 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 42 4 2",
    "4111111111111111" * 3, "9" * 20_000, "+1 +12345678 +1234567 +1 (((( +49 30 1234567890123456", "l" * 30_000 + "@x.y", "👍 " * 500 + "me@x.io 10.0.0.1", "a.@b.c a@b..c %@-.-", "1.1.1.1" * 300, "+1.2.3.4 5@6.7.8.9",
]


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, spans int")
    for r in pii.find_spans(docs).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans] == brute(TEXTS[r.doc_id]), r.doc_id


def test_terms_that_give_an_entity_away(spark):
    told = [(i, f"Agent Zorblax wrote to zed@corp.org, note {i} about the plan") for i in range(5)]
    other = [(100 + i, f"the plan and the note about number{i}") for i in range(40)]
    docs = spark.createDataFrame([(*r, "k", "en") for r in told + other], "doc_id long, text string, kind string, lang string")
    rows = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    assert {t.value for t in rows[0].terms} == {"agent", "zorblax", "wrote", "to"}
    text = told[0][1]
    assert all(text[t.start : t.end].lower() == t.value for t in rows[0].terms) and not rows[100].terms
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert clean[0].text == "[TERM] [TERM] [TERM] [TERM] [EMAIL], note 0 about the plan" and clean[0].kind == "k"
    assert clean[105].text == other[5][1] and len(clean) == 45
    assert pii.sanitise(docs).columns == docs.columns


def test_rows_stay(spark):
    docs = spark.createDataFrame([(1, "me@x.io"), (1, "me@x.io"), (1, "10.0.0.1"), (None, None), (None, "+12345678")], "doc_id long, text string")
    assert sorted(str(r.text) for r in pii.sanitise(docs).collect()) == ["None", "[EMAIL]", "[EMAIL]", "[IP]", "[PHONE]"]
    assert pii.sanitise(docs.limit(0)).count() == 0 and pii.find_spans(docs.limit(0)).count() == 0


def test_running_sums(spark):
    for n in (0, 1, 63, 64, 65, 1000):
        values = list(range(1, n + 1))
        got = spark.createDataFrame([(values,)], "v array<int>").select(pii.running_sums(F.col("v")).alias("s")).first().s
        assert got == [sum(values[:i]) for i in range(n)]


def brute_terms(texts, support=3, most=2):
    spans = [[(a, b, (t or "")[a:b]) for _, a, b in brute(t)] for t in texts]
    words = [
        [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "") if re.sub("[0-9]", "", m[0]) and not any(a < m.end() and b > m.start() for a, b, _ in s)]
        for t, s in zip(texts, spans)
    ]
    n, both = Counter(), Counter()
    for w, s in zip(words, spans):
        n.update({x for x, *_ in w})
        both.update({(x, e) for x, *_ in w for *_, e in s})
    telling = {t for (t, _), k in both.items() if k >= support and n[t] <= most * k}
    return [[(a, b) for x, a, b in w if x in telling] for w in words]


def test_terms_far_from_an_entity_and_in_other_documents(spark):
    far = "filler words " * 20
    texts = [f"Zorblax the first {far} Quandle at zed@corp.org or 10.0.0.1" for _ in range(3)] + ["here is zorblax and quandle2 alone", f"{far} Quandle", None, ""]
    texts += [f"the first of {far} x{i}" for i in range(9)] + TEXTS + ["card 4111111111111111abc and \u00e9t\u00e9a@b.c, Zorblax"]
    docs = spark.createDataFrame([(None if i == 4 else min(i, 2) if i < 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") < 3, 0).otherwise(F.col("doc_id")))  # rows 0 to 2 are repeats
    want = sorted(zip((str(None if i == 4 else 0 if i < 3 else i) for i in range(len(texts))), brute_terms(texts)))
    got = sorted((str(r.doc_id), [(t.start, t.end) for t in r.terms]) for r in pii.find_spans(docs).collect())
    assert got == want and dict(want)["3"] == [(8, 15)] and dict(want)["None"]


def test_one_text_with_very_many_entities(spark):
    text = " ".join(f"name{i % 7}x wrote user{i}@site{i % 90}.example.org and 10.0.{i % 250}.7" for i in range(6_000))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    began = time.perf_counter()
    row = next(r for r in pii.find_spans(docs).collect() if r.doc_id == 1)
    clean = next(r.text for r in pii.sanitise(docs).collect() if r.doc_id == 1)
    assert [(s.kind, s.start, s.end) for s in row.spans] == brute(text) and len(row.spans) == 12_000
    assert clean == re.sub(r"10\.0\.[0-9]+\.7", "[IP]", re.sub(r"[a-z0-9]+@[a-z0-9.]+", "[EMAIL]", text))
    assert time.perf_counter() - began < 60


def test_short_names_and_odd_characters(spark):
    """Names of one and two characters, a word with U+FFFF, and texts with NUL are terms like any others."""
    texts = [f"\u674e\u660e and Bo at zed@corp.org zor\uffffblax a\x00b{i} \x00zed@corp.org\x00q x{'y' * i}" for i in range(5)] + [f"and at {i} a \x00 \uffff" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(t.start, t.end) for t in r.terms] for r in pii.find_spans(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_terms(texts)
    assert {"\u674e\u660e", "Bo", "zor\uffffblax", "q"} <= {texts[0][a:b] for a, b in got[0]}
