"""Packing of token pieces into sequences of a fixed width by minimum bin slack.

Each document is encoded, closed by an end id, and cut only if it is longer than the width: its first piece takes the
remainder and all others are whole. A piece matters to the packing by its length alone, so the plan is made from the number
of pieces of each length, at most `width` counts whatever the corpus holds: for each bin a bitset dynamic programme over
the available lengths finds the fullest feasible combination, larger lengths first among equals, and the combination is
removed as often as the counts allow. Two orders are tried, with and without the largest piece left as a member of every
bin, and the plan with fewer sequences is kept. Pieces then find their places by their rank among those of their length.

A piece's rank is its number within the task that cut it plus the numbers of earlier tasks, both written down before they
are used: a task that runs again changes nothing. Null texts are empty (the end id alone); ids may be null; repeated rows
are packed like any others; an empty table gives no rows; other columns are ignored. Long texts are encoded stretch by
stretch, cut where a letter, a space and a letter meet, which no pre-token crosses.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesync.llm.common import store

WIDTH, END = 1_024, 2
#: Strings inside texts that stand for an id of their own. Fixed values of the vocabulary.
SPECIAL = {"<|endoftext|>": 50_256}
#: Characters encoded at once.
STRETCH = 1 << 20
_SAFE = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")
#: Tasks whose counts are summed together.
_BLOCK = 64


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)


def encode(text: str, own) -> np.ndarray:
    """The ids of a whole text."""
    parts, at = [], 0
    while at < len(text) or not parts:
        cut = _SAFE.search(text, at + STRETCH) if len(text) - at > STRETCH else None
        part = text[at : cut.start() if cut else len(text)]
        special = any(s in part for s in SPECIAL)
        parts.append(np.asarray(own.encode(part, allowed_special="all") if special else own.encode_ordinary(part), "<u4"))
        at += max(1, len(part))
    return np.concatenate(parts)


def cut(n: int, width: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole ones, and a remainder first."""
    first = (n - 1) % width + 1
    return [(0, first), *((at, width) for at in range(first, n, width))]


def token_pieces(docs: DataFrame, ranks_path: str, pattern: str, width: int = WIDTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of docs (doc_id, text), with the task's number and the piece's number among its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, task = encoder(ranks_path, pattern), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            rows, origin = [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.append(encode(text.as_py(), own), np.uint32(end)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), width)):
                    rows.append((piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), task, seen[length]))
                    origin.append(i)
                    seen[length] += 1
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(origin)), *columns], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum of at most `room`; among those, the one with more of the largest lengths."""
    sizes = sorted(s for s, c in counts.items() if c and s <= room)
    mask, reach = (1 << (room + 1)) - 1, [1]
    for s in sizes:
        bits, left, step = reach[-1], min(counts[s], room // s), 1
        while left:  # one, two, four ... copies reach every number of copies
            take = min(step, left)
            bits |= bits << (s * take) & mask
            left, step = left - take, step * 2
        reach.append(bits)
    total, chosen = reach[-1].bit_length() - 1, {}
    for s, before in zip(reversed(sizes), reversed(reach[:-1])):
        n = min(counts[s], total // s)
        while not before >> (total - n * s) & 1:
            n -= 1
        if n:
            chosen[s], total = n, total - n * s
    return chosen


def minimum_slack(counts: dict[int, int], width: int, seeded: bool) -> list[tuple[int, dict[int, int]]]:
    """(times, combination) of all bins. Seeded: the largest length that is left belongs to every bin."""
    left, plan = {s: c for s, c in counts.items() if c}, []
    while left:
        chosen: dict[int, int] = {}
        room = width
        if seeded:
            largest = max(left)
            left[largest] -= 1
            chosen, room = fullest(left, width - largest), width
            left[largest] += 1
            chosen[largest] = chosen.get(largest, 0) + 1
        else:
            chosen = fullest(left, room)
        times = min(left[s] // n for s, n in chosen.items())
        plan.append((times, chosen))
        for s, n in chosen.items():
            left[s] -= times * n
            if not left[s]:
                del left[s]
    return plan


def best_plan(counts: dict[int, int], width: int) -> list[tuple[int, dict[int, int]]]:
    plans = [minimum_slack(counts, width, seeded) for seeded in (True, False)]
    return min(plans, key=lambda plan: sum(times for times, _ in plan))


class Places:
    """For each length the ranges of ranks that a combination takes, and where their pieces go."""

    def __init__(self, plan: list[tuple[int, dict[int, int]]]):
        taken, rows, sequence = Counter(), [], 0
        for times, chosen in plan:
            offset = 0
            for size in sorted(chosen, reverse=True):
                rows.append((size, taken[size], chosen[size], sequence, offset))
                taken[size] += times * chosen[size]
                offset += size * chosen[size]
            sequence += times
        self.rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.keys = self.rows[:, 0] << 44 | self.rows[:, 1]

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence and offset of the pieces with these lengths and ranks."""
        size, first, copies, sequence, offset = self.rows[np.searchsorted(self.keys, length << 44 | rank, side="right") - 1].T
        at = rank - first
        return sequence + at // copies, offset + at % copies * size


def rank_offsets(counted: DataFrame) -> DataFrame:
    """task, length, before: how many pieces of the length earlier tasks have. Sums of blocks of tasks keep every window short."""
    blocked = counted.withColumn("block", F.floor(F.col("task") / _BLOCK))
    blocks = blocked.groupBy("length", "block").agg(F.sum("n").alias("held"))
    ahead = blocks.select("length", "block", (F.sum("held").over(Window.partitionBy("length").orderBy("block")) - F.col("held")).alias("ahead"))
    inside = F.sum("n").over(Window.partitionBy("length", "block").orderBy("task")) - F.col("n")
    return blocked.withColumn("inside", inside).join(ahead, ["length", "block"]).select("task", "length", (F.col("ahead") + F.col("inside")).alias("before"))


def pack(docs: DataFrame, ranks_path: str, pattern: str, width: int = WIDTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of docs (doc_id, text)."""
    spark = docs.sparkSession
    pieces = store(token_pieces(docs, ranks_path, pattern, width, end), "pieces")
    counted = store(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `width` rows
    places = spark.sparkContext.broadcast(Places(best_plan(histogram, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            sequence, offset = places.value.of(column("length"), column("before") + column("nth"))
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ranked = pieces.join(rank_offsets(counted), ["task", "length"])
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
