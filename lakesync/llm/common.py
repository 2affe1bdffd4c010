"""What the operators share: reading tables, size-checked broadcasts, words, folds."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesync.scratch import store

__all__ = ["ascii_lower", "broadcast_if_small", "crc_bucket", "free_names", "released", "store", "table", "words"]

#: A side is broadcast only if a count has shown that it has no more rows than this.
BROADCAST_ROWS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of words: ASCII other than digits and lower-case letters. Every other character is part of a word.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of df, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows, else as it is (Spark then shuffles the join)."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df


def released(run: Callable) -> Callable:
    """run for mapInArrow, whose worker gives freed memory back to the system when its task is done: workers live on, idle, beside the JVM."""

    def own(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return own


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """The words of a text: lower-cased A-Z, split at ASCII other than letters and digits. Null has no words."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
