"""Spelling variants: words one edit apart, found by merging the light subtrees of the vocabulary's trie.

Words are runs of letters of whole texts, lower-cased A-Z only. A node of the trie is a prefix; its heavy child is the one with
the most words below it, so a word leaves heavy paths at most log2(vocabulary) times. Where a word goes on by a light child a
(or ends), below prefix p and with s behind a, the subtree is merged, small into large, in three ways: with a skipped (p s), with
the heavy child's letter put before it (p h a s), and with a replaced by the heavy letter (p h s). What comes out is looked up among the
words. Light subtrees of one node meet each other with a replaced by a wildcard: words with the same node and the same s. Two
words are one edit apart exactly if one of these four merges makes their terminals coincide, and then exactly one does, as an
insertion in a run of equal letters counts at the run's end; so near words are counted without repeats.

Nothing is a pair expansion: a node has as many children as there are letters, a light word makes at most four strings for each of
its light edges, and words with the same wildcard (one for each letter at most) are ranked, not paired. Nodes with many words below
them are few (the sum over all nodes is the number of letters) and are broadcast; no key of the other joins holds more than
a thousandth of the vocabulary. A form is followed to its root by pointer doubling. Nodes are named by a hash of 61 bits; two that
shared a name would only choose their heavy child together: merges compare whole strings, so results stay exact.

Null texts have no words; a null id counts as an empty one; repeated rows count as often as they stand; ties of n go to the smaller
word in code-point order; runs and texts may be of any length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesync.llm.common import broadcast_if_small, store

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, MODULUS, RATIO = 5, 3, 97, 2
#: Nodes with more than this part of the vocabulary below them are broadcast.
LARGE_SHARE, LARGE_LEAST = 1_000, 64
_PRIME, _BASE = (1 << 61) - 1, 1_000_003
_HELD = 200_000
_LOWER = {c: c + 32 for c in range(65, 91)}


def count_words(rows: Iterator[tuple[str | None, str | None]], least: int, modulus: int, counts: Counter) -> None:
    """Adds the words of (id, text) rows to counts; a letter is deleted where the modulus divides the crc32 of `<id>:<run>`."""
    for doc_id, text in rows:
        own = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
        for run, n in Counter(RUN.findall(text or "")).items():
            run = run.translate(_LOWER)
            h = zlib.crc32(run.encode(), own)
            if h % modulus == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                counts[run] += n


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, modulus: int = MODULUS) -> DataFrame:
    """word, n of docs (doc_id, text). Tasks count their own words batch by batch, so the shuffle carries sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            count_words(((i, texts[k].as_py()) for k, i in enumerate(ids)), least_length, modulus, counts)
            if len(counts) >= _HELD:
                yield _counted(counts)
                counts.clear()
        yield _counted(counts)

    parts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])


def trie_edges(words: DataFrame) -> DataFrame:
    """number, at, node, child: for each word (number, word) the edges it takes, from prefix to next letter; an empty child where it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.string()))], names=["number", "at", "node", "child"])

        for batch in batches:
            columns: tuple = ([], [], [], [])
            for number, word in zip(batch.column("number").to_pylist(), batch.column("word").to_pylist()):
                node = 0
                for at, child in enumerate((*word, "")):
                    for column, value in zip(columns, (number, at, node, child)):
                        column.append(value)
                    if child:
                        node = (node * _BASE + ord(child)) % _PRIME
                    if len(columns[0]) >= _HELD:
                        yield flush()
                        columns = ([], [], [], [])
            yield flush()

    return words.select("number", "word").mapInArrow(run, "number long, at int, node long, child string")


def light_edges(words: DataFrame) -> DataFrame:
    """number, at, heavy: where each word leaves the heavy path (or ends on it), and that path's next letter."""
    taken = store(trie_edges(words), "trie")
    edges = taken.groupBy("node", "child").agg(F.count("*").alias("below"))
    order = Window.partitionBy("node").orderBy(F.col("child") == "", F.col("below").desc(), "child")
    ranked = edges.withColumn("heavy", F.first("child").over(order)).withColumn("light", F.row_number().over(order) > 1)
    ranked = store(ranked, "edges")
    most = max(LARGE_LEAST, words.count() // LARGE_SHARE)
    # the words below all nodes are the letters of all words: at most LARGE_SHARE large edges for each letter of a mean word
    large = ranked.where(F.col("below") >= most).select("node", "child", "heavy", "light")
    marked = taken.join(broadcast_if_small(large), ["node", "child"], "left")
    small = ranked.where(F.col("light") & (F.col("below") < most)).select("node", "child", "heavy")
    rest = marked.where(F.col("light").isNull()).select("number", "at", "node", "child").join(small, ["node", "child"])
    return marked.where("light").select("number", "at", "heavy").unionByName(rest.select("number", "at", "heavy"))


def _merges(word: Column, at: Column, heavy: Column) -> Column:
    """The strings that a light edge makes: at is -1 for those that are looked up, else the wildcard's place."""
    child, before, behind = F.substring(word, at + 1, F.lit(1)), F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word))
    made = lambda place, text, wanted: F.when(wanted, F.struct(place.cast("int").alias("at"), text.alias("text")))
    goes_on, lookup = child != "", F.lit(-1)
    return F.array_compact(
        F.array(
            made(lookup, F.concat(before, behind), goes_on & (F.substring(behind, 1, 1) != child)),
            made(lookup, F.concat(before, heavy, child, behind), F.lit(True)),
            made(lookup, F.concat(before, heavy, behind), goes_on),
            made(at, F.concat(before, behind), goes_on),
        )
    )


def near_words(words: DataFrame) -> DataFrame:
    """number, n_near, best (struct of -n and word: the near word with the largest n) of the words (number, word, n) that have near words."""
    own = words.join(light_edges(words), "number")
    made = store(own.select("number", "word", "n", F.explode(_merges(F.col("word"), F.col("at"), F.col("heavy"))).alias("m")).select("number", "word", "n", "m.at", "m.text"), "merges")
    as_best = lambda n, word: F.struct((-n).alias("minus_n"), word.alias("word"))
    sought = made.where(F.col("at") < 0).select("number", as_best(F.col("n"), F.col("word")).alias("a"), "text")
    met = sought.join(words.select(F.col("number").alias("other"), F.col("word").alias("text"), "n"), "text").select("number", "a", "other", as_best(F.col("n"), F.col("text")).alias("b"))
    both = met.select(F.explode(F.array(F.struct(F.col("number"), F.col("b").alias("best")), F.struct(F.col("other").alias("number"), F.col("a").alias("best")))).alias("x"))
    looked_up = both.select("x.number", F.lit(1).cast("long").alias("k"), "x.best")
    # the words of one wildcard differ in one letter, so there are as many as letters at most
    member = F.struct(as_best(F.col("n"), F.col("word")).alias("best"), F.col("number"))
    slots = made.where(F.col("at") >= 0).groupBy("at", "text").agg(F.array_sort(F.collect_list(member)).alias("m")).where(F.size("m") > 1)
    others = slots.select((F.size("m") - 1).cast("long").alias("k"), F.posexplode("m").alias("place", "x"), F.get("m", F.lit(0))["best"].alias("one"), F.get("m", F.lit(1))["best"].alias("two"))
    wildcards = others.select(F.col("x.number").alias("number"), "k", F.when(F.col("place") == 0, F.col("two")).otherwise(F.col("one")).alias("best"))
    return looked_up.unionByName(wildcards).groupBy("number").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): forms followed to the last. Every form has at least twice the count, so no path returns; each round doubles the steps taken."""
    known = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = store(known.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if known.where("moved").isEmpty():
            return known.select("word", "root")
        known = known.select("word", "root")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, modulus: int = MODULUS, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs (doc_id, text)."""
    words = store(vocabulary(docs, least_length, least_count, modulus).withColumn("number", F.monotonically_increasing_id()), "words")
    found = words.join(near_words(words), "number", "left")
    form_n = -F.col("best.minus_n")
    taken = F.coalesce(form_n >= ratio * F.col("n"), F.lit(False))
    formed = store(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.word")).alias("form"), F.when(taken, form_n).alias("form_n")), "forms")
    ends = roots(formed.where(F.col("form").isNotNull()).select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
