"""Token counts of whole texts under a BPE piece model with byte fallback, without making ids.

Each stretch of text that merges cannot leave is counted by a heap and a linked list: the adjacent pair with the best
rank is popped and joined until none is left; the count is the number of initial symbols minus the merges. A character
outside the vocabulary stands for its UTF-8 bytes, which never merge.

Null and empty texts have no tokens. Rows are independent, so repeated rows give repeated results; columns other than the
id and the text are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48
NORMAL = 1


def count_symbols(word: str, rank: dict[str, int]) -> int:
    """Initial symbols minus merges of one stretch."""
    n = len(word)
    if n == 1 or word in rank and n < 3:
        return 1 if word in rank else len(word.encode())
    end = list(range(1, n + 1))  # the symbol at i spans word[i:end[i]]; 0: joined into its left neighbour
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two symbols has changed since
        merges += 1
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := rank.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (j := before[i]) >= 0 and (r := rank.get(word[j:stop])) is not None:
            heapq.heappush(heap, (r, j, stop))
    symbols = sum(1 if c in rank else len(c.encode()) for c in word)
    return symbols - merges


class Counter(dict):
    """Stretch -> its number of tokens; a worker keeps one of bounded size between tasks."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i)
        pieces = [(-model.get_score(i), i, model.id_to_piece(i)) for i in range(model.get_piece_size()) if not special(i)]
        # equal scores tie: the leftmost pair goes first, so they share a rank
        order = {s: k for k, s in enumerate(sorted({s for s, _, _ in pieces}))}
        self.rank = {piece: order[s] for s, _, piece in pieces}
        inner = any(SPACE in p.lstrip(SPACE) for p in self.rank)  # a piece across a word's start would allow merges there
        self.stretches = re.compile(".+" if inner else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.DOTALL)

    def __missing__(self, word: str) -> int:
        n = count_symbols(word, self.rank)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.stretches.findall(SPACE + text.replace(" ", SPACE))))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for batch in batches:
            text = batch.column("text")
            n = pa.array(map(own.count, text.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(text).cast(pa.int64()), n], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
