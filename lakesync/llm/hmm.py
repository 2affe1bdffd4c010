"""Language-model scoring by a hidden Markov model over word classes, beside an add-one unigram model.

Tokens are runs of non-blank bytes, A-Z lower-cased, and one end per text. Counts of all training tokens are taken over
the whole corpus. The most frequent tokens are classes of their own, the others fall in classes by their last bytes. Hidden
states emit classes, and a class emits its tokens by their counts plus one, with one part left for tokens that were
never seen. Baum-Welch runs over all training texts, each as one whole sequence: each partition turns its texts into expected counts, Spark sums them.
A text's score is the scaled forward recursion over its whole class sequence plus the log probabilities of its tokens in their classes.

Counts of frequent tokens reach the workers by broadcast, bounded by `FREQUENT` entries; the occurrences of all other tokens
are joined with their counts by a shuffle. Null texts count as empty: one end token. Repeated rows are scored each. An
empty table gives no rows; without training texts every token is unseen. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesync.llm.common import store

STATES, OWN, SHARED = 8, 256, 256
ITERATIONS = 6
#: Training keeps the states of this many tokens at once; of longer sequences it keeps every so many-th state and works out the others again.
HELD, STRETCH = 400_000, 4_096
#: Most entries of the broadcast table of frequent tokens.
FREQUENT = 250_000
_FLUSH, _SLICE = 500_000, 400
END = b""


def tokens(text: bytes | None) -> list[bytes]:
    """bytes.lower() changes A-Z only, and bytes.split() parts at blanks, tabs, line feeds, form feeds and the like."""
    return (text or b"").lower().split() + [END]


def _texts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, _SLICE):
        yield batch.slice(start, _SLICE)


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, c over all texts of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                counts.update(tokens(text))
                if len(counts) > _FLUSH:
                    yield rows()
                    counts.clear()
        if counts:
            yield rows()

    return docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


def shared_class(token: bytes) -> int:
    """Class of a token that has none of its own, from its last two bytes."""
    return OWN + (token[-1] * 31 + (token[-2] if len(token) > 1 else 7) * 17 + min(len(token), 8)) % SHARED if token else 0


@dataclass
class Lexicon:
    """Counts of the frequent tokens, the classes with own tokens, and the classes' totals."""

    frequent: dict[bytes, int]
    own: dict[bytes, int]
    least: int
    n: int
    v: int
    class_log: np.ndarray  # log10 of tokens + distinct tokens + 1 of each class


def lexicon(vocabulary: DataFrame, frequent: int = FREQUENT) -> Lexicon:
    """What workers need of the vocabulary, bounded by `frequent` and the number of classes."""
    total = vocabulary.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    sizes = dict(vocabulary.groupBy(F.floor(F.log2("c")).cast("int").alias("size")).agg(F.count("*")).collect())
    power, held = 64, 0
    while power > 0 and held + sizes.get(power - 1, 0) <= frequent:
        power -= 1
        held += sizes.get(power, 0)
    least = 1 << power
    known = {bytes(r.token): r.c for r in vocabulary.where(F.col("c") >= least).toLocalIterator()}
    own = {END: 0}
    for token in sorted(known, key=lambda t: (-known[t], t)):
        if len(own) == OWN:
            break
        own.setdefault(token, len(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((OWN + SHARED, 2), np.int64)
        for batch in batches:
            at = np.fromiter((own[t] if t in own else shared_class(t) for t in batch.column("token").to_pylist()), np.int64, batch.num_rows)
            sums[:, 0] += np.bincount(at, weights=batch.column("c").to_numpy(), minlength=len(sums)).astype(np.int64)
            sums[:, 1] += np.bincount(at, minlength=len(sums))
        used = np.flatnonzero(sums[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used, 0]), pa.array(sums[used, 1])], names=["class", "n", "v"])

    rows = vocabulary.mapInArrow(run, "class long, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    totals = np.ones(OWN + SHARED)
    for r in rows:
        totals[r["class"]] += r.n + r.v
    return Lexicon(known, own, least, total.n, total.v, np.log10(totals))


_lexicons: dict[str, tuple] = {}


def _lookup(name: str, own: Lexicon) -> tuple:
    """The frequent tokens' places, classes and logs, made once in a worker."""
    if name not in _lexicons:
        _lexicons.clear()
        words = list(own.frequent)
        classes = np.fromiter((own.own[w] if w in own.own else shared_class(w) for w in words), np.uint16, len(words))
        _lexicons[name] = ({w: i for i, w in enumerate(words)}, classes, np.log10(np.fromiter(own.frequent.values(), np.float64, len(words)) + 1))
    return _lexicons[name]


def encode(docs: DataFrame, words: Lexicon) -> DataFrame:
    """row, doc_id, trains, n_tokens, n_frequent, log_counts (sum of log10(c + 1) over frequent tokens), classes (uint16 bytes), rare (tokens)."""
    shared, name = docs.sparkSession.sparkContext.broadcast(words), uuid.uuid4().hex
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, class_of, log_of = _lookup(name, shared.value)
        own = shared.value.own
        for batch in batches:
            for part in _texts(batch):
                lists = [tokens(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                flat = [t for tokens_of in lists for t in tokens_of]
                at = np.fromiter(map(place.get, flat, repeat(-1)), np.int64, len(flat))
                doc = np.repeat(np.arange(len(lists)), sizes)
                rare = np.flatnonzero(at < 0)
                known = at >= 0
                classes = np.zeros(len(flat), np.uint16)
                classes[known] = class_of[at[known]]
                rare_tokens = [flat[i] for i in rare]
                classes[rare] = np.fromiter((own[t] if t in own else shared_class(t) for t in rare_tokens), np.uint16, len(rare))
                log_counts = np.bincount(doc[known], weights=log_of[at[known]], minlength=len(lists)).astype(np.float64)  # of no tokens it is whole numbers
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                rare_ends = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=len(lists)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), part.column("doc_id"), part.column("trains"), pa.array(sizes), pa.array(np.bincount(doc[known], minlength=len(lists))), pa.array(log_counts),
                        pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((ends * 2).astype(np.int32).tobytes()), pa.py_buffer(classes.tobytes())]),
                        pa.ListArray.from_arrays(pa.array(rare_ends), pa.array(rare_tokens, pa.binary())),
                    ],
                    names=["row", "doc_id", "trains", "n_tokens", "n_frequent", "log_counts", "classes", "rare"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "trains", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"row long, doc_id {kind}, trains boolean, n_tokens long, n_frequent long, log_counts double, classes binary, rare array<binary>")


@dataclass
class Hmm:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # states x classes

    @classmethod
    def initial(cls, states: int, classes: np.ndarray, seed: int = 7) -> Hmm:
        """States that stay, each with the corpus's classes in proportions of its own."""
        rng = np.random.default_rng(seed)
        emit = (classes + 0.1) * np.exp(rng.normal(0, 0.7, (states, len(classes))))
        return cls(np.full(states, 1 / states), np.eye(states) * 0.5 + 0.5 / states, emit / emit.sum(1, keepdims=True))


def _columns(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all sequences place by place (those still running at place t, longest sequences first), where each place begins, and the order."""
    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
    order = np.argsort(-sizes, kind="stable")
    n = sizes[order]
    running = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    begin = np.concatenate([[0], np.cumsum(running)])
    out = np.empty(int(begin[-1]), np.int64)
    for row, i in enumerate(order):
        out[begin[: len(sequences[i])] + row] = sequences[i]
    return out, begin, order


def _groups(sequences: list[np.ndarray], held: int) -> Iterator[list[np.ndarray]]:
    """Sequences of like lengths, the longest first, in groups of at most `held` symbols (or of one sequence)."""
    group, size = [], 0
    for seq in sorted(sequences, key=len, reverse=True):
        if group and size + len(seq) > held:
            yield group
            group, size = [], 0
        group.append(seq)
        size += len(seq)
    if group:
        yield group


def expected_counts(model: Hmm, sequences: list[np.ndarray], held: int = HELD, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch's expected starts, moves and emissions, and the log likelihood, over whole sequences.

    States are kept for one stretch of places at a time: the way forth keeps the states at which each stretch begins, and the way back,
    stretch by stretch from the last one, works out those inside again. Nothing is cut or guessed.
    """
    k, n_classes = model.emit.shape
    starts, moves, emits, gained = np.zeros(k), np.zeros((k, k)), np.zeros((k, n_classes)), 0.0
    move, emit, start = model.move.astype(np.float32), np.ascontiguousarray(model.emit.T, np.float32), model.start.astype(np.float32)
    back, ones = np.ascontiguousarray(move.T), np.ones((k, k), np.float32)
    for group in _groups([q for q in sequences if len(q)], held):
        symbols, begin, _ = _columns(group)
        longest = len(begin) - 1

        def forth(alpha: np.ndarray | None, low: int, high: int, keep: bool):
            """States after the places low to high, from those before; and the scaled states and emissions of each place."""
            states, shown, scales = [], [], []
            for t in range(low, high):
                e = emit[symbols[begin[t] : begin[t + 1]]]
                alpha = (start if t == 0 else alpha[: len(e)] @ move) * e
                scale = alpha @ ones  # the sum of each row, in all its places
                alpha = alpha / scale
                scales.append(scale)
                if keep:
                    states.append(alpha), shown.append(e)
            return alpha, states, shown, scales

        marks: list[np.ndarray | None] = [None]
        whole = longest <= stretch
        for low in range(0, 0 if whole else longest, stretch):
            marks.append(forth(marks[-1], low, min(low + stretch, longest), False)[0])
        beta, ahead = np.zeros((0, k), np.float32), None
        for part in reversed(range(-(-longest // stretch))):
            low, high = part * stretch, min((part + 1) * stretch, longest)
            _, states, shown, scales = forth(marks[part], low, high, True)
            gained += float(np.log(np.concatenate([x[:, 0] for x in scales])).sum(dtype=np.float64))
            gammas = [None] * (high - low)
            for t in range(high - 1, low - 1, -1):
                alpha = states[t - low]
                if ahead is not None:
                    moves += (alpha[: len(ahead)].T @ ahead) * model.move
                    beta = ahead @ back
                if len(beta) < len(alpha):  # sequences that end here
                    beta = np.concatenate([beta, np.ones((len(alpha) - len(beta), k), np.float32)])
                gammas[t - low] = alpha * beta
                ahead = shown[t - low] * beta / scales[t - low]
            seen, gamma = symbols[begin[low] : begin[high]], np.concatenate(gammas).T.astype(np.float64)
            for state in range(k):
                emits[state] += np.bincount(seen, weights=gamma[state], minlength=n_classes)
            if part == 0:
                starts += gammas[0].sum(0, dtype=np.float64)
    return starts, moves, emits, gained


def log_likelihoods(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of each whole sequence, by the scaled forward recursion."""
    out = np.zeros(len(sequences))
    symbols, begin, order = _columns(sequences)
    emit = np.ascontiguousarray(model.emit.T)
    alpha, total = None, np.zeros(len(sequences))
    for t in range(len(begin) - 1):
        e = emit[symbols[begin[t] : begin[t + 1]]]
        alpha = (model.start if t == 0 else alpha[: len(e)] @ model.move) * e
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        total[: len(e)] += np.log(scale)
    out[order] = total
    return out


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(c, np.uint16) for c in batch.column("classes").to_pylist()]


def train(encoded: DataFrame, states: int = STATES, iterations: int = ITERATIONS) -> Hmm:
    """Baum-Welch over all training rows; each iteration is one Spark job whose result is one number per state and class."""
    n_classes = OWN + SHARED
    rows = encoded.where("trains").select("classes")

    def summed(model: Hmm | None) -> dict[int, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(n_classes if model is None else states * (1 + states + n_classes) + 1)
            for batch in batches:
                if model is None:
                    for seq in _sequences(batch):
                        sums += np.bincount(seq, minlength=n_classes)
                    continue
                starts, moves, emits, gained = expected_counts(model, _sequences(batch))
                sums += np.concatenate([starts, moves.ravel(), emits.ravel(), [gained]])
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["place", "value"])

        return {r.place: r.value for r in rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()}

    dense = lambda got, size: np.array([got.get(i, 0.0) for i in range(size)])
    model = Hmm.initial(states, dense(summed(None), n_classes))
    for _ in range(iterations):
        got = dense(summed(model), states * (1 + states + n_classes) + 1)
        starts, moves, emits = got[:states] + 0.1, got[states : states * (1 + states)].reshape(states, states) + 0.1, got[states * (1 + states) : -1].reshape(states, n_classes) + 0.01
        model = Hmm(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))
    return model


def rare_sums(encoded: DataFrame, vocabulary: DataFrame, least: int) -> DataFrame:
    """row, log_rare, n_rare: sums of log10(c + 1), and the number of known ones, over the occurrences of tokens that are not frequent."""
    spread = encoded.select("row", F.explode("rare").alias("token"))
    joined = spread.join(vocabulary.where(F.col("c") < least), "token", "left")
    return joined.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("log_rare"), F.count("c").alias("n_rare"))


def score(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, trains, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text, trains)."""
    vocabulary = store(count_tokens(docs.where("trains")), "vocabulary")
    words = lexicon(vocabulary, frequent)
    encoded = store(encode(docs, words), "encoded")
    model = train(encoded, states, iterations)
    class_log = words.class_log
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _sequences(batch)
            logs = log_likelihoods(model, own) / np.log(10) - np.array([class_log[s].sum() for s in own])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "classes"), pa.array(logs)], names=[*(c for c in batch.schema.names if c != "classes"), "log_classes"])

    names = ["row", "doc_id", "trains", "n_tokens", "n_frequent", "log_counts"]
    scored = encoded.select(*names, "classes").mapInArrow(run, f"row long, doc_id {kind}, trains boolean, n_tokens long, n_frequent long, log_counts double, log_classes double")
    full = scored.join(rare_sums(encoded, vocabulary, words.least), "row", "left")
    counts = F.col("log_counts") + F.coalesce("log_rare", F.lit(0.0))
    return full.select(
        "doc_id", "trains", "n_tokens", (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(words.n).cast("long").alias("train_tokens"),
        (counts - F.col("n_tokens") * float(np.log10(words.n + words.v + 1))).alias("base_score"), (counts + F.col("log_classes")).alias("score"),
    )
