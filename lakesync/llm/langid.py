"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to `order` bytes is counted on a bounded sample of its distinct texts. In a context,
a byte that was seen c of n times there, among q different ones, has probability c / (n + q); the escape, q / (n + q), goes to
the unseen bytes in proportion to their probabilities in the next shorter context, down to a uniform one. The tree holds the
contexts that were seen `least` times or more, and of these the `contexts` most frequent (all of a frequency or none), with whole counts,
single sightings included; in any other context the longest shorter one in the tree speaks. The statistics are
frozen, so a context tree is an automaton: one step per byte gives the next context and the exact code length. The shortest
code names the language.

Texts are lower-cased and preceded by newlines. A null text or one without a letter is ``und`` with score 0, as is every text
if no language was learned. Rows are independent; repeated rows repeat. Other columns are ignored, and neither language nor
id enter a prediction. Ties go to the language that sorts first. A text that stands in many rows counts once in the sample.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesync.llm.common import broadcast_if_small, crc_bucket, store

ORDER = 4
#: Bounds of the sample and of the trees: distinct texts (in expectation) and contexts per language, and sightings of a context.
SAMPLE_DOCS, CONTEXTS, LEAST = 1_500, 20_000, 6
SEGMENT, BATCH_BYTES = 256, 1 << 20
UNKNOWN = "und"


def _gram_counts(order: int):
    """Texts of a batch -> (lang, length, gram, n) for all byte strings of 1 to order + 1 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                raw = [b"\n" * order + texts[i].lower().encode() for i in np.flatnonzero(langs == lang)]
                data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
                fresh = np.zeros(len(data) + 1, bool)  # the first bytes of each text are context only
                for at in np.cumsum([0, *map(len, raw)])[:-1]:
                    fresh[at : at + order] = True
                gram, shift = np.zeros(len(data), np.int64), data
                for length in range(1, order + 2):
                    gram = gram + (shift << (8 * (length - 1)))  # the last byte is the lowest
                    keys, n = np.unique(gram[~fresh[:-1]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(np.full(len(keys), length, np.int32)), pa.array(keys), pa.array(n)], names=["lang", "length", "gram", "n"])
                    shift = np.concatenate([[0], shift[:-1]])

    return run


def sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """lang, text: about `sample_docs` distinct texts of each language, chosen by a hash of the text; all if there are fewer."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("key"))
    sizes = known.select("lang", "key").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    chance = F.least(F.lit(float(sample_docs)) / F.col("n"), F.lit(1.0))
    chosen = known.join(broadcast_if_small(sizes), "lang").where(F.pmod("key", F.lit(1 << 30)) < chance * (1 << 30))
    return chosen.groupBy("lang", "key").agg(F.min("text").alias("text")).select("lang", "text")


def learn(docs: DataFrame, order: int = ORDER, sample_docs: int = SAMPLE_DOCS, contexts: int = CONTEXTS, least: int = LEAST) -> list[tuple[str, list[tuple[np.ndarray, np.ndarray]]]]:
    """For each language the (gram, count) arrays by length: all grams that follow on a context of the tree, with their whole counts.

    What comes to the driver is bounded by languages x contexts x 256, whatever the sample.
    """
    grams = sample(docs, sample_docs).mapInArrow(_gram_counts(order), "lang string, length int, gram long, n long")
    counted = store(grams.groupBy("lang", "length", "gram").agg(F.sum("n").alias("n")), "grams")
    followed = counted.withColumn("context", F.shiftright("gram", 8))
    seen = followed.groupBy("lang", "length", "context").agg(F.sum("n").alias("seen")).where((F.col("seen") >= least) | (F.col("length") == 1))
    # the most frequent contexts, down to the number of sightings at which there are no more than `contexts` of them
    levels = seen.groupBy("lang", F.least("seen", F.lit(100_000)).alias("level")).agg(F.count("*").alias("k"))
    lowest = levels.withColumn("so_far", F.sum("k").over(Window.partitionBy("lang").orderBy(F.desc("level")))).where(F.col("so_far") <= contexts).groupBy("lang").agg(F.min("level").alias("lowest"))
    held = seen.join(broadcast_if_small(lowest), "lang", "left").where((F.col("seen") >= F.col("lowest")) | (F.col("length") == 1)).select("lang", "length", "context")
    table = followed.join(broadcast_if_small(store(held, "contexts"), limit=400_000), ["lang", "length", "context"]).select("lang", "length", "gram", "n").toArrow().to_pandas()
    out = []
    for lang, part in sorted(table.groupby("lang"), key=lambda x: x[0]):
        by_length = []
        for length in range(1, order + 2):
            rows = part[part["length"] == length].sort_values("gram")
            by_length.append((rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)))
        out.append((lang, by_length))
    return out


class Tree:
    """Code lengths and transitions by context and symbol. Symbols are the bytes that the sample shows, and one for all others."""

    def __init__(self, by_length: list[tuple[np.ndarray, np.ndarray]], order: int):
        seen = np.union1d(by_length[0][0], [ord("\n")])  # newlines precede every text, so they are contexts even where unseen
        self.symbol = np.full(256, len(seen), np.uint8 if len(seen) < 255 else np.int32)
        self.symbol[seen] = np.arange(len(seen))
        width = len(seen) + 1
        others = 256 - len(seen)
        base = np.full(width, 1 / 256)
        base[-1] = others / 256
        keys, tables, nexts, number = [], [], [], 0
        for length in range(order + 1):
            key = np.unique(by_length[length][0] >> 8) if length else np.zeros(1, np.int64)
            if length:
                # a context is kept only with the shorter ones that lead to it: its end, and its beginning
                lead = [np.isin(key & ((1 << (8 * (length - 1))) - 1), keys[-1]), np.isin(key >> 8, keys[-1])]
                key = key[lead[0] & lead[1]]
            keys.append(key)
            count = np.zeros((len(key), width))
            grams, n = by_length[length]
            held = np.searchsorted(key, grams >> 8) if len(key) else np.zeros(0, np.int64)
            ok = (held < len(key)) & (key[np.minimum(held, len(key) - 1)] == grams >> 8) if len(key) else np.zeros(len(grams), bool)
            if len(key):
                count[held[ok], self.symbol[grams[ok] & 255]] = n[ok]
            if length:
                # contexts of this length follow on those one shorter; their own transitions are those of their end
                nexts[-1][np.searchsorted(keys[-2], key >> 8), self.symbol[key & 255]] = number + np.arange(len(key))
                up = np.searchsorted(keys[-2], key & ((1 << (8 * (length - 1))) - 1))
                shorter, onward = tables[-1][up], nexts[-1][up].copy()
            else:
                shorter, onward = base[None, :].repeat(len(key), 0), np.zeros((len(key), width), np.int32)
            q = (count > 0).sum(1, keepdims=True)
            total = count.sum(1, keepdims=True) + q
            rest = np.where(count > 0, 0, shorter)
            left = rest.sum(1, keepdims=True)
            tables.append(np.where(count > 0, count / total, np.where(left > 0, rest / np.where(left > 0, left, 1), 0) * q / total))
            nexts.append(onward)
            number += len(key)
        prob = np.concatenate(tables)
        prob[:, -1] /= others or 1
        self.width = width
        self.cost = -np.log2(np.maximum(prob, 1e-12)).astype(np.float32).ravel()
        self.next = (np.concatenate(nexts).astype(np.int32) * width).ravel()

    def bits(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: int) -> np.ndarray:
        """Code length of each segment; it is preceded by `order` bytes that set its context. Longest segments first."""
        state = np.zeros(len(starts), np.int32)
        total = np.zeros(len(starts))
        for step in range(order + int(lengths[0]) if len(lengths) else 0):
            live = len(starts) if step < order else int(np.searchsorted(-lengths, -(step - order), side="left"))
            at = state[:live] + symbols[starts[:live] + step]
            if step >= order:
                total[:live] += self.cost[at]
            state = self.next[at]
        return total


_models: dict[str, tuple[list[str], list[Tree]]] = {}


def _trees(name: str, model: list, order: int) -> tuple[list[str], list[Tree]]:
    if name not in _models:
        _models.clear()
        _models[name] = ([lang for lang, _ in model], [Tree(counts, order) for _, counts in model])
    return _models[name]


def code_lengths(texts: list[str], trees: list[Tree], order: int, segment: int = SEGMENT) -> np.ndarray:
    """Bits of each text under each tree."""
    raw = [t.lower().encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(b"\n" * order + r for r in raw), np.uint8)
    begins = np.cumsum(sizes + order) - sizes - order
    n_segments = -(-sizes // segment)
    doc = np.repeat(np.arange(len(raw)), n_segments)
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(n_segments) - n_segments, n_segments)
    starts, lengths = begins[doc] + inner * segment, np.minimum(segment, sizes[doc] - inner * segment)
    by_size = np.argsort(-lengths, kind="stable")
    out = np.zeros((len(raw), len(trees)))
    for k, tree in enumerate(trees):
        bits = tree.bits(tree.symbol[data], starts[by_size], lengths[by_size], order)
        out[:, k] = np.bincount(doc[by_size], weights=bits, minlength=len(raw))
    return out


def predict(docs: DataFrame, model: list, order: int = ORDER, key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score (posterior of the prediction under equal priors), bits (code length under each language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, trees = _trees(name, shared.value, order)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ends = np.cumsum([len(t or "") for t in texts])
            cuts = sorted({0, len(texts), *np.searchsorted(ends, np.arange(BATCH_BYTES, int(ends[-1]) if len(ends) else 0, BATCH_BYTES), side="right").tolist()})
            pred, score, bits = [], [], []
            for a, b in zip(cuts, cuts[1:]):
                own = [t if t is not None and any(map(str.isalpha, t)) else "" for t in texts[a:b]]
                lengths = code_lengths(own, trees, order)
                for text, row in zip(own, lengths):
                    if not text or not langs:
                        pred.append(UNKNOWN), score.append(0.0), bits.append([])
                        continue
                    best = int(np.argmin(row))
                    pred.append(langs[best])
                    score.append(float(1 / np.exp2(np.maximum(row[best] - row, -1000)).sum()))
                    bits.append(row.tolist())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.list_(pa.float64()))], names=["key", "lang_pred", "score", "bits"])

    rows = docs.select(F.col(key).alias("key"), F.col("text"))
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, bits array<double>").withColumnRenamed("key", key)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id (null: empty) modulo 3 is 1."""
    return crc_bucket(F.coalesce(doc_id.cast("string"), F.lit("")), 3) == 1
