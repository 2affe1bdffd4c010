"""Byte-level BPE encoding and decoding of whole texts by a rank file.

Texts up to `chunk` characters are encoded where they are read. Longer ones are cut into chunks that overlap, the
chunks are pre-tokenised in parallel, neighbours are stitched at the first boundary on which both agree (from there on
the pattern yields the same pre-tokens, as it looks back at nothing), and the pieces between the stitches are encoded in
parallel again. Only the boundaries in the overlaps are shuffled for that, never text. Decoding joins the raw bytes of the ids.

Null texts count as empty (no ids, empty bytes). Empty texts have no ids. Rows are independent: repeated rows and ids
give repeated results. A pre-token longer than the overlap leaves no boundary on which two chunks agree: from there on the text is
one piece, encoded by one task. An empty table gives no rows. Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesync.llm.common import broadcast_if_small, released, store

CHUNK, OVERLAP = 32_768, 1_024
#: Pre-tokens whose ids a worker remembers; longer ones than this many characters are never kept.
CACHE_ENTRIES, CACHE_CHARS = 450_000, 48
#: Texts whose characters all lie below this are split by a plain pattern with their letters, numbers and spaces listed.
PLAIN = 0x250


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that splits a text by the pattern. Where all characters are of the first blocks, the classes are spelled out for the faster engine."""
    import regex

    full = regex.compile(pattern)
    listed = lambda kind: "".join(re.escape(chr(c)) for c in range(PLAIN) if regex.match(kind, chr(c)))
    letters, numbers, spaces = listed(r"\p{L}"), listed(r"\p{N}"), listed(r"\s")
    # inside a class \p{L} stands for its members, outside for a class of them
    inside = re.sub(r"\[\^[^\]]*\]", lambda m: m[0].replace(r"\s", spaces).replace(r"\p{L}", letters).replace(r"\p{N}", numbers), pattern)
    plain = re.compile(inside.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]"))
    other = re.compile(f"[^\x00-{chr(PLAIN - 1)}]")
    return lambda text: full.findall(text) if other.search(text) else plain.findall(text)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: join the adjacent pair of the lowest rank, leftmost first, until no pair has a rank."""
    get, none = ranks.get, 1 << 40
    whole = get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 200:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pair = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pair and (low := min(pair)) != none:
        i = pair.index(low)
        joined = parts[i] = parts[i] + parts[i + 1]
        del parts[i + 1], pair[i]
        if i:
            pair[i - 1] = get(parts[i - 1] + joined, none)
        if i < len(pair):
            pair[i] = get(joined + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long pre-tokens, with a heap and a linked list instead of scans."""
    n = len(piece)
    end = list(range(1, n + 1))  # symbol at i spans piece[i:end[i]]; end[i] == 0: gone
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (j := before[i]) >= 0 and (r := ranks.get(piece[j:stop])) is not None:
            heapq.heappush(heap, (r, j, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder(dict):
    """Pre-token -> its ids as little-endian int32 bytes; a worker keeps one of bounded size between tasks."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.split = splitter(pattern)
        self.raw = {rank: token for token, rank in self.ranks.items()}

    def __missing__(self, token: str) -> bytes:
        ids = array("i", merge(token.encode(), self.ranks)).tobytes()
        if len(token) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[token] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.split(text))), "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def _encode_batches(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 300):
                part = batch.slice(start, 300)
                ids = [own.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in part.schema.names if c != "text"), _list_array(ids), pa.array([own.decode(i) for i in ids], pa.binary())],
                    names=[*(c for c in part.schema.names if c != "text"), "ids", "decoded"],
                )

    return run


def _edges(pattern: str, chunk: int):
    """Chunks -> where their pre-tokens begin, as offsets in the text, within the parts that they share with their neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        for batch in batches:
            heads, tails = [], []
            for at, text, shared in zip(batch.column("at").to_pylist(), batch.column("text").to_pylist(), batch.column("shared").to_pylist()):
                tokens = split(text)
                ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
                starts = np.concatenate([[0], ends[:-1]])
                # what reaches the cut may go on beyond it, and a run of spaces looks one character ahead
                sure = starts[ends < len(text) - 1]
                heads.append((sure[(sure > 0) & (sure < shared)] + at).astype(np.int32))
                tails.append((sure[sure >= chunk] + at).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("at"), _list_array(heads), _list_array(tails)], names=["name", "at", "head", "tail"])

    return run


def cut_points(chunks: DataFrame, pattern: str, chunk: int) -> DataFrame:
    """name, cuts: for each long text the boundaries, one for a pair of neighbouring chunks, from which both agree.

    A chunk counts only if all before it have met their neighbours; where two do not meet, no cut is made and the piece goes on.
    """
    edges = chunks.mapInArrow(released(_edges(pattern, chunk)), "name string, at int, head array<int>, tail array<int>").dropDuplicates(["name", "at"])
    order = Window.partitionBy("name").orderBy("at")
    met = edges.withColumn("cut", F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    reached = met.withColumn("reached", F.min((F.col("cut").isNotNull() | (F.col("at") == 0)).cast("int")).over(order))
    return reached.groupBy("name").agg(F.array_sort(F.collect_list(F.when(F.col("reached") == 1, F.col("cut")))).alias("cuts"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids array<int>, decoded binary of each row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")
    short = rows.where(size <= chunk).mapInArrow(released(_encode_batches(ranks_path, pattern)), f"doc_id {kind}, ids array<int>, decoded binary")
    # cuts depend on the text alone, so they are found once for each distinct text and named by its digest
    long = rows.where(size > chunk).withColumn("name", F.sha2("text", 256))
    chunks = long.withColumn("at", F.explode(F.sequence(F.lit(0), size - 1, F.lit(chunk)))).select(
        "name", "at", F.substring("text", F.col("at") + 1, F.lit(chunk + overlap)).alias("text"), F.lit(overlap).alias("shared")
    )
    cuts = store(cut_points(chunks, pattern, chunk), "cuts")
    # a row is named by its id and text, so that whatever is worked out again has the same name; repeated rows are encoded once and put back at the end
    once = long.groupBy("doc_id", "name").agg(F.first("text").alias("text"), F.count("*").alias("times"))
    bounded = once.join(broadcast_if_small(cuts, limit=50_000), "name").withColumn("cuts", F.concat(F.array(F.lit(0)), "cuts"))
    piece = F.substring("text", F.get("cuts", F.col("piece")) + 1, F.coalesce(F.get("cuts", F.col("piece") + 1), size) - F.get("cuts", F.col("piece")))
    pieces = bounded.withColumn("piece", F.explode(F.sequence(F.lit(0), F.size("cuts") - 1))).select("doc_id", "name", "times", "piece", piece.alias("text"))
    coded = pieces.mapInArrow(released(_encode_batches(ranks_path, pattern)), f"doc_id {kind}, name string, times long, piece int, ids array<int>, decoded binary")
    whole = (
        coded.groupBy("doc_id", "name", "times").agg(F.array_sort(F.collect_list(F.struct("piece", "ids", "decoded"))).alias("p"))
        .select("doc_id", F.flatten("p.ids").alias("ids"), F.aggregate("p.decoded", F.lit(b""), lambda acc, x: F.concat(acc, x)).alias("decoded"), F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select("doc_id", "ids", "decoded")
    )
    return short.unionByName(whole)
