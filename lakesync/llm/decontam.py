"""Benchmark decontamination by a positional inverted index over the training documents.

`build_index` stores the postings (document, position, term) of the benchmark's terms, and a first row for each document.
`phrase_matches` takes for each benchmark window its two rarest terms by collection frequency, shifts their postings by the
terms' places in the item, so that an occurrence of the window gives both the same shift, and intersects them; the alignments
that remain are compared word by word, a row for each word, so neither a long text nor many occurrences make a large row.
`proximity_matches` intersects the same lists but allows the shifts to differ.

Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased. A window is `width`
consecutive words of an item; an item with fewer words, but not none, is one window. Null and empty texts have no words and
are never hit. Repeated items count once; items with a null id hit words but are not listed. Rows of documents that share an id
are matched each by its own text. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesync.llm.common import broadcast_if_small, free_names, store, words

WIDTH = 10
#: How far, in words, the two rarest terms of a window may be from their distance in it and still be near.
SLACK = 5


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_key, w (words), ids (sorted item ids as strings): one row for each distinct word sequence that is not empty."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    return items.groupBy("w").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.xxhash64(F.array_join("w", " ")).alias("item_key"), "w", "ids")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, doc_key, n_words, pos, term, first: postings of the given terms, and each row's first word with a null term if need be."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc_key"), words(F.col("text")).alias("w"))
    tokens = rows.select("doc_id", "doc_key", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "word"))
    postings = tokens.join(broadcast_if_small(terms), tokens.word == terms.term, "left")
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    return postings.where(first | F.col("term").isNotNull()).select("doc_id", "doc_key", "n_words", F.coalesce("pos", F.lit(0)).alias("pos"), "term", first.alias("first"))


def _by_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """left joined with right by doc_id, null being a value, and doc_key."""
    own = right.withColumnsRenamed({"doc_id": "r_id", "doc_key": "r_key"})
    return left.join(own, left["doc_id"].eqNullSafe(own["r_id"]) & (left["doc_key"] == own["r_key"]), how).drop("r_id", "r_key")


def rarest_pairs(items: DataFrame, frequency: DataFrame, width: int) -> DataFrame:
    """item_key, a, b: for each window whose terms all have postings, the places in the item of its two rarest terms."""
    n, starts = F.size("w"), lambda p: F.sequence(F.greatest(p - width + 1, F.lit(0)), F.least(p, F.greatest(F.size("w") - width, F.lit(0))))
    placed = items.select("item_key", "w", F.posexplode("w").alias("p", "term")).withColumn("n", n).withColumn("k", F.explode(starts(F.col("p")))).drop("w")
    rare = placed.join(frequency, "term").groupBy("item_key", "k", "n").agg(F.array_sort(F.collect_list(F.struct("cf", "p", "term"))).alias("l"))
    whole = rare.where(F.size("l") == F.least("n", F.lit(width)))
    return whole.select("item_key", F.col("l")[0].alias("a"), F.coalesce(F.get("l", F.lit(1)), F.col("l")[0]).alias("b")).distinct()


def shifted_postings(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, doc_key, item_key, p, shift: postings of the rarest terms, as the distance between the document's and the item's place."""
    places = pairs.select("item_key", F.explode(F.array("a", "b")).alias("t")).select("item_key", "t.p", "t.term").distinct()
    hits = index.where(F.col("term").isNotNull()).select("doc_id", "doc_key", "pos", "term").join(broadcast_if_small(places), "term")
    return hits.select("doc_id", "doc_key", "item_key", "p", (F.col("pos") - F.col("p")).alias("shift"))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place % 64)


def alignments(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, doc_key, item_key, shift: where the lists of a window's two rarest terms meet.

    Places are folded into 64 bits, so a few alignments too many may stay; none is lost, and each is compared word by word later.
    """
    met = shifted_postings(index, pairs).groupBy("doc_id", "doc_key", "item_key", "shift").agg(F.bit_or(_bit(F.col("p"))).alias("got"))
    need = pairs.select("item_key", _bit(F.col("a.p")).bitwiseOR(_bit(F.col("b.p"))).alias("need")).groupBy("item_key").agg(F.collect_set("need").alias("needs"))
    full = met.join(broadcast_if_small(need), "item_key").where(F.exists("needs", lambda m: F.col("got").bitwiseAND(m) == m))
    return full.select("doc_id", "doc_key", "item_key", "shift")


def term_frequency(index: DataFrame) -> DataFrame:
    return index.where(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("cf"))


def phrase_matches(docs: DataFrame, index: DataFrame, items: DataFrame, width: int = WIDTH, pairs: DataFrame | None = None) -> DataFrame:
    """doc_id, doc_key, item_key, start, n: each run of n words in which a row and an item agree, of a window at least, exact."""
    pairs = store(rarest_pairs(items, term_frequency(index), width), "pairs") if pairs is None else pairs
    candidates = store(alignments(index, pairs), "alignments")
    held = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc_key"), "text")
    texts = _by_row(held, broadcast_if_small(candidates.select("doc_id", "doc_key").distinct()), "left_semi").dropDuplicates(["doc_id", "doc_key"])
    tokens = texts.select("doc_id", "doc_key", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    placed = items.select("item_key", F.size("w").alias("length"), F.posexplode("w").alias("p", "term"))
    wanted = candidates.join(broadcast_if_small(placed), "item_key").withColumnsRenamed({"doc_id": "c_id", "doc_key": "c_key"}).withColumn("at", F.col("shift") + F.col("p"))
    same_row = tokens["doc_id"].eqNullSafe(wanted["c_id"]) & (tokens["doc_key"] == wanted["c_key"])
    agreed = tokens.join(wanted, same_row & (tokens["pos"] == wanted["at"]) & (tokens["word"] == wanted["term"]))
    # places that follow each other have the same distance from their rank
    rank = F.row_number().over(Window.partitionBy("doc_id", "doc_key", "item_key", "length", "shift").orderBy("p"))
    runs = agreed.withColumn("run", F.col("p") - rank).groupBy("doc_id", "doc_key", "item_key", "length", "shift", "run").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("n"))
    return runs.where(F.col("n") >= F.least("length", F.lit(width))).select("doc_id", "doc_key", "item_key", "start", "n")


def proximity_matches(index: DataFrame, items: DataFrame, width: int = WIDTH, slack: int = SLACK, pairs: DataFrame | None = None) -> DataFrame:
    """doc_id, doc_key, item_key, shift: where a window's two rarest terms lie within `slack` (30 at most) words of their distance in it."""
    if not 0 <= slack <= 30:
        raise ValueError("slack must be from 0 to 30")
    pairs = store(rarest_pairs(items, term_frequency(index), width), "pairs") if pairs is None else pairs
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(name)["p"].alias("p"), F.col(name)["term"].alias("term"))
    sides = pairs.select("item_key", F.col("a.p").alias("pa"), F.col("b.p").alias("pb"), F.explode(F.array(side("a"), side("b"))).alias("t")).select("item_key", "pa", "pb", "t.*").distinct()
    hits = index.where(F.col("term").isNotNull()).join(broadcast_if_small(sides), "term").withColumn("shift", F.col("pos") - F.col("p"))
    # a shift falls in its own stretch of `slack` + 1 places and reaches into the next one, so any two that are close share a stretch
    stretch = F.floor(F.col("shift") / (slack + 1))
    spread = hits.withColumn("stretch", F.explode(F.array(stretch, stretch + 1))).withColumn("from", (F.col("stretch") - 1) * (slack + 1))
    bit = _bit((F.col("shift") - F.col("from")).cast("int"))
    of = lambda name: F.coalesce(F.bit_or(F.when(F.col("side") == name, bit)), F.lit(0)).alias(name)
    met = spread.groupBy("doc_id", "doc_key", "item_key", "pa", "pb", "from").agg(of("a"), of("b")).where((F.col("a") != 0) & (F.col("b") != 0))
    reach = F.col("b")
    for d in range(1, slack + 1):
        reach = reach.bitwiseOR(F.shiftleft("b", d)).bitwiseOR(F.shiftright("b", d))
    near = met.withColumn("near", F.col("a").bitwiseAND(reach)).where(F.col("near") != 0)
    places = F.filter(F.sequence(F.lit(0), F.lit(2 * slack + 1)), lambda o: F.col("near").bitwiseAND(_bit(o)) != 0)
    return near.select("doc_id", "doc_key", "item_key", "from", F.explode(places).alias("o")).select("doc_id", "doc_key", "item_key", (F.col("from") + F.col("o")).cast("int").alias("shift")).distinct()


def _ids_of(found: DataFrame, items: DataFrame, name: str) -> DataFrame:
    """doc_id, doc_key and the sorted ids of the items found in the row: as many as the benchmark has at most."""
    listed = found.select("doc_id", "doc_key", "item_key").distinct().join(broadcast_if_small(items.select("item_key", "ids")), "item_key")
    return listed.groupBy("doc_id", "doc_key").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias(name)).withColumn(name, F.array_distinct(name))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slack: int = SLACK) -> DataFrame:
    """Each row's doc_id, n_words, n_hit (words inside occurrences), items, near (sorted ids as strings: exact, in proximity), contaminated."""
    items = store(benchmark_items(benchmark), "items")
    index = store(build_index(docs, items.select(F.explode("w").alias("term")).distinct()), "postings")
    pairs = store(rarest_pairs(items, term_frequency(index), width), "pairs")
    found = store(phrase_matches(docs, index, items, width, pairs), "phrases")
    places = found.select("doc_id", "doc_key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos")).distinct()
    hits = _by_row(places.groupBy("doc_id", "doc_key").agg(F.count("*").alias("n_hit")), _ids_of(found, items, "items"), "inner")
    out = _by_row(index.where("first").select("doc_id", "doc_key", "n_words"), hits, "left")
    out = _by_row(out, _ids_of(proximity_matches(index, items, width, slack, pairs), items, "near"), "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0)), F.array().cast("array<string>")
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"), (n_hit > 0).alias("contaminated")
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without the rows that hold a window of the benchmark."""
    items = store(benchmark_items(benchmark), "items")
    index = store(build_index(docs, items.select(F.explode("w").alias("term")).distinct()), "postings")
    own_id, own_key = free_names(docs, "own_id", "own_key")
    hits = store(phrase_matches(docs, index, items, width).select(F.col("doc_id").alias(own_id), F.col("doc_key").alias(own_key)).distinct(), "hits")
    same = docs["doc_id"].eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(own_key))
    return docs.join(broadcast_if_small(hits), same, "left_anti")
