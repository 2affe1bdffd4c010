import re

from pyspark.sql import functions as F

from lakesync.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width):
    out = []
    for doc_id, text in docs:
        words, hit, found = split(text), set(), set()
        for item_id, item in items:
            w = split(item)
            for k in range(max(1, len(w) - width + 1)) if w else []:
                window = w[k : k + width]
                for s in range(len(words) - len(window) + 1):
                    if words[s : s + len(window)] == window:
                        hit.update(range(s, s + len(window)))
                        found |= {str(item_id)} - {"None"}
        out.append((doc_id, len(words), len(hit), tuple(sorted(found)), bool(hit)))
    return sorted(out, key=str)


PASSAGE = "alpha Beta gamma délta one two three four five six seven eight nine ten"
DOCS = [
    (1, f"start {PASSAGE}, end"), (2, PASSAGE.upper()), (3, None), (4, ""), (5, "the the the the the the the the the the the the"), (6, "alpha beta gamma"),
    (7, "x " * 500 + PASSAGE + " y" * 500 + " " + PASSAGE), (8, "nothing here"), (8, "one two three"), (9, f"{PASSAGE}"), (9, f"{PASSAGE}"), (None, PASSAGE), (10, "!!! ??"),
]
ITEMS = [(1, PASSAGE), (1, PASSAGE), (2, "the the the the the the the the the the the"), (3, "One, two; three."), (4, None), (5, ""), (10, PASSAGE + " tail"), (None, "nothing here"), (6, "words that never occur in any of the documents at all today")]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id long, text string, term string, item_key int")
    items = spark.createDataFrame([(*i, 5) for i in ITEMS], "item_id long, text string, doc_id int")
    for width in (10, 3):
        got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontam.contamination(docs, items, width).collect()]
        assert sorted(got, key=str) == brute(DOCS, ITEMS, width)


def near_brute(docs, items, width, slack):
    """Per row, the ids of items with a window whose two rarest terms (by count in docs, then place) have places in the row that fit within slack."""
    rows, cf, out = [(i, split(t)) for i, t in docs], {}, []
    for _, words in rows:
        for w in words:
            cf[w] = cf.get(w, 0) + 1
    for doc_id, words in rows:
        ids = set()
        for item_id, item in items:
            w = split(item)
            for k in range(max(1, len(w) - width + 1)) if w else []:
                places = sorted((cf.get(w[p], 0), p) for p in range(k, min(k + width, len(w))))
                if places[0][0]:
                    (_, a), (_, b) = places[0], places[min(1, len(places) - 1)]
                    at = lambda p: [j - p for j, x in enumerate(words) if x == w[p]]  # noqa: B023, E731
                    if any(abs(x - y) <= slack for x in at(a) for y in at(b)):
                        ids |= {str(item_id)} - {"None"}
        out.append((doc_id, len(words), tuple(sorted(ids))))
    return sorted(out, key=str)


def test_proximity_against_brute_force(spark):
    loose = [(20, "start " + " pad ".join(PASSAGE.split())), (21, " pad pad pad pad ".join(PASSAGE.split())), (22, " ".join(reversed(PASSAGE.split()))), (23, "the " * 40 + "nothing"), (24, "x one y two z three")]
    docs, items = spark.createDataFrame(DOCS + loose, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    for width, slack in ((10, 5), (3, 2), (10, 0), (4, 30)):
        got = [(r.doc_id, r.n_words, tuple(r.near)) for r in decontam.contamination(docs, items, width, slack).collect()]
        assert sorted(got, key=str) == near_brute(DOCS + loose, ITEMS, width, slack)


def test_a_long_text_full_of_a_short_item(spark):
    docs = [(1, "the cat " * 30_000), (2, "the " * 50_000 + PASSAGE)]
    items = [(1, "the"), (2, "cat the"), (3, PASSAGE)]
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: (60_000, 59_999, ["1", "2"]), 2: (50_014, 50_014, ["1", "3"])}


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.contamination(docs.limit(0), items).count() == 0
    assert {r.contaminated for r in decontam.contamination(docs, items.limit(0)).collect()} == {False}


def test_proximity_allows_gaps(spark):
    docs = spark.createDataFrame([(1, "rare1 a b rare2"), (2, "rare1 a x y b rare2"), (3, "rare1 " + "z " * 40 + "rare2 a b a b a b")], "doc_id long, text string")
    items = decontam.benchmark_items(spark.createDataFrame([(1, "rare1 a b rare2")], "item_id long, text string"))
    index = decontam.build_index(docs, items.select(F.explode("w").alias("term")).distinct())
    near = lambda slack: {r.doc_id for r in decontam.proximity_matches(index, items, 4, slack).collect()}
    assert near(0) == {1} and near(2) == {1, 2}
