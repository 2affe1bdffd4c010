"""Toxicity by a bidirectional gated recurrent network with attention pooling, over words and their characters.

A word's input is an embedding of the word, if it is in the vocabulary, plus the mean embedding of all its character trigrams.
Words are runs of ASCII letters, digits and other characters that are no blanks or marks; one of more than `LONG` bytes (a text in a script
without blanks, say) is read as pieces of so many bytes that overlap by half, so every byte enters a window.
A text is cut into windows of `WINDOW` words that overlap by half (the last one ends with the text); the network reads each
window in both directions, attention pools its states, and the text's score is the calibrated maximum over all of its windows.
The network is trained in numpy on a bounded sample of labelled rows: windows of toxic texts count as positive if they hold a word
that the labels single out, windows of clean texts as negative, others are left aside. Where no window holds such a word (few labels
cannot single one out), the windows of each toxic text with the strongest evidence of it are the positives.

Null texts and texts without words give the network nothing to read: their score is the share of toxic labels. Rows are independent; repeated rows repeat. Without labels
of both kinds on texts with words every score is the share of toxic labels (0 without labels). Of rows that share a labelled id one text
may be learned from, the one that sorts first; an id that is labelled several times is toxic if one label says so. Only text enters a
score; other columns, whatever their names, are kept by `reject` and ignored elsewhere.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesync.llm.common import crc_bucket, free_names, released

#: Bounds of the labelled sample, in expectation: toxic and clean rows, and the length of a row that may serve for training.
TOXIC_ROWS, CLEAN_ROWS, TRAIN_CHARS = 1_500, 3_000, 20_000
WINDOW, STRIDE = 24, 12
VOCABULARY, TRIGRAMS, LONG = 8_192, 4_096, 24
INPUTS, HIDDEN, ATTENTION = 16, 8, 8
EPOCHS, STEPS, BATCH, RATE, NEGATIVES = 3, 120, 256, 0.01, 20_000  # epochs go on until so many steps are made
THRESHOLD = 0.3
#: What makes a word telling (root of the log-likelihood ratio, odds ratio), and in how many texts other words of the vocabulary stand.
EVIDENCE, ODDS, FAMILIAR = 5.5, 12.0, 20
_SLICE, _CHUNK = 300, 4_096
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Blanks and marks beyond ASCII, by their blocks (Latin-1, general and CJK punctuation, full-width forms).
_MARK = re.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u1680\u2000-\u206f\u3000-\u303f\ufe30-\ufe4f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65\ufeff]")


def words_of(text: str | None) -> list[bytes]:
    text = text or ""
    found = _WORD.findall((text if text.isascii() else _MARK.sub(" ", text)).lower().encode())
    if found and max(map(len, found)) > LONG:
        step = LONG // 2
        found = [w[k : k + LONG] for w in found for k in (range(0, len(w) - step, step) if len(w) > LONG else (0,))]
    return found


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of all words one after the other (each word with marks at both ends), and how many each word has."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(b"".join([b"\1" + w + b"\0" for w in words]), np.uint8).astype(np.int64)
    code = letters[:-2] * 7919 + letters[1:-1] * 104729 + letters[2:] * 1299709
    inside = np.repeat(2 * np.arange(len(words)), size) + np.arange(int(size.sum()))  # where a trigram of one word begins
    return ((code[inside] >> 2) % TRIGRAMS).astype(np.int32), size


def window_starts(n: int) -> np.ndarray:
    """Starts of the overlapping windows of a text of n words."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    return np.unique(np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, vocabulary: dict[bytes, int], seed: int = 11):
        rng = np.random.default_rng(seed)
        put = lambda *shape, scale=0.3: rng.normal(0, scale, shape).astype(np.float32)
        self.vocabulary = vocabulary
        word = put(len(vocabulary) + 1, INPUTS, scale=0.05)
        word[0] = 0
        self.p = {"word": word, "char": put(TRIGRAMS, INPUTS, scale=0.05), "attend": put(2 * HIDDEN, ATTENTION), "attend_b": put(ATTENTION), "ask": put(ATTENTION), "out": put(2 * HIDDEN), "out_b": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"in_{side}": put(INPUTS, 3 * HIDDEN), f"bias_{side}": np.zeros(3 * HIDDEN, np.float32), f"own_{side}": put(HIDDEN, 3 * HIDDEN)}
        self.scale, self.shift, self.share = 1.0, 0.0, 0.0

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        x = self.p["word"][ids]
        if not len(words):
            return x, (ids, ids, ids)
        tri, size = trigrams(words)
        x = x + np.add.reduceat(self.p["char"][tri], np.cumsum(size) - size) / size[:, None].astype(np.float32)
        return x, (ids, tri, size)

    def _gru(self, side: str, given: np.ndarray, at: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
        """States at each place, places first. given: each word's part of the gates."""
        own = self.p[f"own_{side}"]
        steps = at.shape[1]
        out = np.empty((steps, len(at), HIDDEN), np.float32)
        h = np.zeros((len(at), HIDDEN), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            g, u = given[at[:, t]], h @ own
            zr = _sigmoid(g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if mask is not None:
                new = np.where(mask[:, t, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, n, u[:, 2 * HIDDEN :]))
            out[t] = h = new
        return out

    def _pool(self, states: np.ndarray, mask: np.ndarray | None) -> tuple:
        """Attention over places: logits of the windows, and what the way back needs."""
        inner = np.tanh(states @ self.p["attend"] + self.p["attend_b"])
        ask = inner @ self.p["ask"]
        if mask is not None:
            ask = np.where(mask.T, ask, -1e9)
        weight = np.exp(ask - ask.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tm,tmh->mh", weight, states)
        return pooled @ self.p["out"] + self.p["out_b"], inner, weight, pooled

    def logits(self, given: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        states = np.concatenate([self._gru(s, given[s], at, mask, None) for s in "fb"], 2)
        return self._pool(states, mask)[0]

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {s: x @ self.p[f"in_{s}"] + self.p[f"bias_{s}"] for s in "fb"}

    def gradients(self, words: list[bytes], at: np.ndarray, mask: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradient over windows of the given distinct words."""
        p, grad = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        x, (ids, tri, size) = self.inputs(words)
        given = self.gates(x)
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._gru(s, given[s], at, mask, kept[s]) for s in "fb"], 2)
        logit, inner, attention, pooled = self._pool(states, mask)
        prob = _sigmoid(logit)
        loss = -float((weight * np.where(truth > 0, np.log(prob + 1e-9), np.log(1 - prob + 1e-9))).sum())
        d = weight * (prob - truth)
        grad["out"], grad["out_b"] = pooled.T @ d, d.sum(keepdims=True)
        d_pooled = d[:, None] * p["out"]
        d_states = attention[:, :, None] * d_pooled
        d_weight = np.einsum("mh,tmh->tm", d_pooled, states)
        d_ask = attention * (d_weight - (attention * d_weight).sum(0))
        grad["ask"] = np.einsum("tm,tma->a", d_ask, inner)
        d_inner = d_ask[:, :, None] * p["ask"] * (1 - inner**2)
        grad["attend"], grad["attend_b"] = np.einsum("tmh,tma->ha", states, d_inner), d_inner.sum((0, 1))
        d_states = d_states + d_inner @ p["attend"].T
        d_x = np.zeros_like(x)
        for k, s in enumerate("fb"):
            d_h, d_given = np.zeros((len(at), HIDDEN), np.float32), np.zeros_like(given[s])
            for t, h, z, r, n, u in reversed(kept[s]):
                d_h = d_h + d_states[t][:, k * HIDDEN : (k + 1) * HIDDEN]
                d_new, stay = np.where(mask[:, t, None], d_h, 0), np.where(mask[:, t, None], 0, d_h)
                d_n = d_new * (1 - z) * (1 - n**2)
                d_z, d_r = d_new * (h - n) * z * (1 - z), d_n * u * r * (1 - r)
                d_own = np.concatenate([d_z, d_r, d_n * r], 1)
                np.add.at(d_given, at[:, t], np.concatenate([d_z, d_r, d_n], 1))
                grad[f"own_{s}"] += h.T @ d_own
                d_h = stay + d_new * z + d_own @ p[f"own_{s}"].T
            grad[f"in_{s}"], grad[f"bias_{s}"] = x.T @ d_given, d_given.sum(0)
            d_x += d_given @ p[f"in_{s}"].T
        np.add.at(grad["word"], ids, d_x)
        grad["word"][0] = 0
        np.add.at(grad["char"], tri, np.repeat(d_x / size[:, None].astype(np.float32), size, axis=0))
        return loss, grad

    def window_scores(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Logit of each window of the texts, and the text it is of."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = [w for t in texts for w in t]
        number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        ids = np.fromiter(map(number.__getitem__, flat), np.int32, len(flat))
        given = self.gates(self.inputs(list(number))[0])
        begin = np.cumsum(sizes) - sizes
        starts = [window_starts(int(n)) for n in sizes]
        doc = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        first = np.concatenate([np.zeros(0, np.int64), *starts]) + begin[doc]
        length = np.minimum(sizes[doc], WINDOW)
        out = np.zeros(len(doc), np.float32)
        for full in (True, False):
            own = np.flatnonzero((length == WINDOW) == full)
            for low in range(0, len(own), _CHUNK):
                part = own[low : low + _CHUNK]
                place = first[part, None] + np.arange(WINDOW)
                mask = None if full else np.arange(WINDOW) < length[part, None]
                out[part] = self.logits(given, ids[place if full else np.where(mask, place, first[part, None])], mask)
        return out, doc

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        """Calibrated maximum over the windows of each text; the share of toxic labels where there is no window."""
        logit, doc = self.window_scores(texts)
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, doc, logit)
        read = np.isfinite(top)
        return np.where(read, _sigmoid(self.scale * np.where(read, top, 0.0) + self.shift), self.share)


class Constant:
    """What is left to say without labels of both kinds."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        return np.full(len(texts), self.share)


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> list[tuple[str, int, int, float]]:
    """(text, toxic, fold, weight) of about so many rows of each kind, chosen by a hash of the id; the bounds hold whatever the tables' size.

    A row's weight is the number of labelled rows of its kind that it stands for.
    """
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(learns(F.col("doc_id")))
    sizes = dict(own.groupBy("toxic").agg(F.count("*")).collect())
    rate = {1: min(toxic_rows / max(sizes.get(1, 0), 1), 1.0), 0: min(clean_rows / max(sizes.get(0, 0), 1), 1.0)}
    chance = F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0])
    chosen = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < chance * (1 << 30))
    texts = docs.select("doc_id", "text").where(F.length("text") <= TRAIN_CHARS).join(F.broadcast(chosen), "doc_id")
    # one text of each id, however many rows share it: no more rows than `chosen` has
    once = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = once.select("doc_id", "text", "toxic", crc_bucket(F.col("doc_id"), 4).alias("fold")).collect()
    return [(r.text, int(r.toxic), int(r.fold), 1 / rate[int(r.toxic == 1)]) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))]


def without_near_copies(docs: list[list[bytes]], bands: int = 6, rows: int = 3, seed: int = 3) -> list[int]:
    """Places of the first text of each group that shares a band of shingle minima: copies would count one text's words many times."""
    factor = np.random.default_rng(seed).integers(1, 2**62, bands * rows, dtype=np.uint64) | np.uint64(1)
    met, kept = set(), []
    for i, words in enumerate(docs):
        h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        if len(h) >= 5:
            h = sum(h[k : len(h) - 4 + k] * np.uint64(2 * k * k + 40_503) for k in range(5))
        if not len(h):
            continue
        h = h * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(29))
        low = (h[:, None] * factor).min(0)
        keys = {(b, low[b * rows : (b + 1) * rows].tobytes()) for b in range(bands)}
        if not keys & met:
            kept.append(i)
        met |= keys
    return kept


def parts(word: bytes) -> list[bytes]:
    """A word, and with a mark before it its runs of 4 and 5 bytes."""
    marked = b"^" + word
    return [word, *(marked[k : k + n] for n in (4, 5) for k in range(len(marked) - n + 1))]


class Hints:
    """Words and parts of words by number: how telling each is, and how many texts hold it.

    Telling is the root of the log-likelihood ratio against the labels' shares, where the odds are ODDS times or more, else 0.
    """

    def __init__(self, toxic: list[list[bytes]], clean: list[list[bytes]]):
        self.number: dict[bytes, int] = {}
        self.of_word: dict[bytes, np.ndarray] = {}
        held = []
        for texts in (clean, toxic):
            rows = [np.unique(np.concatenate([self._parts(w) for w in set(words)])) for words in texts if words]
            held.append(np.concatenate(rows) if rows else np.zeros(0, np.int32))
        c, t = (np.bincount(ids, minlength=len(self.number)).astype(float) for ids in held)
        share, n = len(toxic) / (len(toxic) + len(clean)), c + t
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(t > 0, t * np.log(t / (n * share)), 0) + np.where(c > 0, c * np.log(c / (n * (1 - share))), 0)
        odd = (t + 0.5) * (len(clean) + 1) >= ODDS * (c + 0.5) * (len(toxic) + 1)
        self.telling, self.texts = np.where(odd, np.sqrt(np.maximum(2 * ratio, 0)), 0), n

    def _parts(self, word: bytes) -> np.ndarray:
        if word not in self.of_word:
            self.of_word[word] = np.fromiter((self.number.setdefault(g, len(self.number)) for g in parts(word)), np.int32)
        return self.of_word[word]

    def strength(self, word: bytes) -> float:
        """Of the most telling part of a word."""
        return float(self.telling[self.of_word[word]].max())

    def own(self, word: bytes) -> tuple[float, int]:
        """How telling the word itself is, and in how many texts it stands."""
        i = self.number[word]
        return float(self.telling[i]), int(self.texts[i])


def toxic_share(sample: list[tuple[str, int, int, float]]) -> float:
    """The share of toxic rows among all labelled rows that the sample stands for."""
    weight = sum(w for *_, w in sample)
    return sum(w for _, toxic, _, w in sample if toxic) / weight if weight else 0.0


def train(sample: list[tuple[str, int, int, float]], seed: int = 5) -> Network | Constant:
    """Fit on folds 0 and 1, calibrate on fold 3 to the share of toxic rows before sampling and without copies taken out."""
    once = list({(text, toxic): (words_of(text), toxic, fold) for text, toxic, fold, _ in sample}.values())
    once = [once[i] for i in without_near_copies([w for w, _, _ in once])]
    fit, rest = [(w, t) for w, t, f in once if f != 3], [(w, t) for w, t, f in once if f == 3]
    kinds = lambda rows: len({t > 0 for _, t in rows})
    if kinds(fit) < 2 or kinds(rest) < 2:  # too few labels to part them
        fit = rest = fit + rest
    if kinds(fit) < 2:
        return Constant(toxic_share(sample))
    hint = Hints([w for w, t in fit if t], [w for w, t in fit if not t])
    strength = {w: hint.strength(w) for w in hint.of_word}
    own = {w: hint.own(w) for w in hint.of_word}
    strongest = [max((strength[w] for w in words), default=0.0) for words, _ in fit]
    proven = max(x for x, (_, toxic) in zip(strongest, fit) if toxic) >= EVIDENCE
    telling = {w: x for w, (x, _) in own.items() if x >= (EVIDENCE if proven else 1e-9)}
    ranked = sorted((w for w, (_, n) in own.items() if w in telling or n >= FAMILIAR), key=lambda w: (-telling.get(w, 0.0), -own[w][1], w))[:VOCABULARY]
    del hint, own
    model = Network({w: i + 1 for i, w in enumerate(ranked)})
    rng = np.random.default_rng(seed)
    positive, negative = [], []
    for (words, toxic), most in zip(fit, strongest):
        for a in window_starts(len(words)):
            window = words[a : a + WINDOW]
            if not toxic:
                negative.append(window)
            elif max(strength[w] for w in window) >= (EVIDENCE if proven else most):
                positive.append(window)
    pick = lambda windows, n: [windows[i] for i in rng.permutation(len(windows))[:n]]
    positive = pick(positive, NEGATIVES)
    for _ in range(2):  # the second time with the clean windows that the first took for toxic
        logits, _ = model.window_scores(negative)
        hard = [negative[i] for i in np.argsort(-logits, kind="stable")[: NEGATIVES // 2]]
        # and one word over and over, which texts of junk hold more kinds of than the sample shows
        again = [[w] * WINDOW for window in pick(negative, NEGATIVES // 20) for w in window[:1] if strength.get(w, 0.0) == 0]
        chosen = hard + pick(negative, NEGATIVES - len(hard)) + again
        truth = np.array([1] * len(positive) + [0] * len(chosen), np.float32)
        weight = np.where(truth > 0, 0.5 * len(truth) / len(positive), 0.5 * len(truth) / len(chosen)).astype(np.float32)
        _descend(model, positive + chosen, truth, weight, rng)
    _calibrate(model, rest, toxic_share(sample))
    return model


def _descend(model: Network, windows: list[list[bytes]], truth: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
    """Adam over shuffled batches."""
    first, second, step = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    epochs = max(EPOCHS, -(-STEPS // -(-len(windows) // BATCH)))
    for epoch in range(epochs):
        for low in range(0, len(order := rng.permutation(len(windows))), BATCH):
            own = order[low : low + BATCH]
            number = {w: i for i, w in enumerate(dict.fromkeys(w for i in own for w in windows[i]))}
            at, mask = np.zeros((len(own), WINDOW), np.int64), np.zeros((len(own), WINDOW), bool)
            for row, i in enumerate(own):
                n = len(windows[i])
                at[row, :n], mask[row, :n] = [number[w] for w in windows[i]], True
            _, grad = model.gradients(list(number), at, mask, truth[own], weight[own] / len(own))
            step += 1
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model.p[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)


def _calibrate(model: Network, docs: list[tuple[list[bytes], int]], share: float) -> None:
    """Scale and shift of the top logit by logistic regression on texts that were not fitted, weighted to the given share of toxic ones."""
    model.scale, model.shift, model.share = 1.0, 0.0, share
    docs = [(w, t) for w, t in docs if w]
    p = np.clip(model.scores([w for w, _ in docs]), 1e-9, 1 - 1e-9)
    x, y = np.log(p / (1 - p)), np.array([t for _, t in docs], float)
    n_toxic, a, b = y.sum(), 1.0, 0.0
    weight = np.where(y > 0, share * len(y) / max(n_toxic, 1), (1 - share) * len(y) / max(len(y) - n_toxic, 1)) if 0 < n_toxic < len(y) else np.ones(len(y))
    for _ in range(50):  # Newton's method with a weak pull to (1, 0)
        q = _sigmoid(a * x + b)
        e = weight * (q - y)
        g = np.array([(e * x).sum() + 0.1 * (a - 1), e.sum() + 0.1 * b])
        w = weight * q * (1 - q)
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -1, 1)
    model.scale, model.shift = float(max(a, 0.05)), float(b)


_models: dict[str, object] = {}


def score(docs: DataFrame, model: Network | Constant, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The kept columns and the score, called `name`, of each row of docs."""
    shared, run_id = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    kept = [f"c{i}" for i in range(len(keep))]
    text = kept[keep.index("text")] if "text" in keep else "text"  # never sent twice
    kinds = [f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(kept, keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if run_id not in _models:
            _models.clear()
            _models[run_id] = shared.value
        for batch in batches:
            texts = batch.column(text)
            scores = [_models[run_id].scores([words_of(t) for t in texts.slice(low, _SLICE).to_pylist()]) for low in range(0, len(texts), _SLICE)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())], names=[*kept, "score"])

    rows = docs.select(*[F.col(c).alias(k) for k, c in zip(kept, keep)], *([] if "text" in keep else ["text"]))
    return rows.mapInArrow(released(run), ", ".join([*kinds, "score double"])).toDF(*keep, name)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches the threshold, by a network trained on their labels."""
    (name,) = free_names(docs, "own_score")
    scored = score(docs, train(labelled_sample(docs, labels)), tuple(docs.columns), name)
    return scored.where(F.col(name) < threshold).drop(name)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never used: crc32 of the id modulo 4 is 2."""
    return F.coalesce(crc_bucket(doc_id, 4) == 2, F.lit(False))


def learns(doc_id: Column) -> Column:
    return ~held_out(doc_id)
