"""Exact order statistics without sorting everything in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A span of values with at most so many rows is ranked on the driver.
SMALL = 10_000


def at_places(df: DataFrame, value: str, places: Callable[[int], dict[str, int]], buckets: int = 1_000, small: int = SMALL) -> tuple[int, dict[str, float]]:
    """The number n of values, and for each name of places(n) the element at that place, from 0, of the sorted values.

    Each place is known to lie in a span of values, at first all of them. A pass counts the span's buckets, with the least and the
    greatest value of each, and the bucket that holds the place is the next span, so an outlier costs a pass and not a task. Spans of
    one value are done; those of few rows are ranked. All places take the same passes. Nulls and NaN are passed over.
    """
    values = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x")).where(~F.isnan("x"))
    low, high, n = values.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if not n:
        return 0, {}
    asked = places(n)
    spans = dict.fromkeys(asked, (low, high, 0, n))  # from, to, rows before it, rows in it
    while wide := sorted({s for s in spans.values() if s[1] > s[0] and s[3] > small}):
        bucket = F.lit(None).cast("int")
        for low, high, *_ in reversed(wide):
            width = (high / buckets - low / buckets) or (high - low)
            bucket = F.when(F.col("x").between(low, high), F.least(F.floor(F.col("x") / width - low / width), F.lit(buckets - 1)).cast("int")).otherwise(bucket)
        of = F.coalesce(*[F.when(F.col("x").between(low, high), i) for i, (low, high, *_) in enumerate(wide)])
        held = values.select("x", of.alias("s"), bucket.alias("b")).where(F.col("s").isNotNull())
        sizes = held.groupBy("s", "b").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("s", "b").collect()  # places times buckets
        parts: dict[tuple, list[tuple]] = {s: [] for s in wide}
        for r in sizes:
            own = parts[wide[r.s]]
            before = own[-1][2] + own[-1][3] if own else wide[r.s][2]
            own.append((r.low, r.high, before, r.n))
        narrowed = {name: next(p for p in parts[s] if p[2] <= asked[name] < p[2] + p[3]) if s in parts else s for name, s in spans.items()}
        if narrowed == spans:
            break
        spans = narrowed
    many = {s for s in spans.values() if s[1] > s[0]}
    inside = F.lit(False)
    for low, high, *_ in sorted(many):
        inside = inside | F.col("x").between(low, high)
    counted = sorted(map(tuple, values.where(inside).groupBy("x").agg(F.count("*")).collect())) if many else []
    return n, {name: _ranked(counted, s, asked[name]) if s in many else s[0] for name, s in spans.items()}


def _ranked(counted: list[tuple[float, int]], span: tuple, place: int) -> float:
    reached = span[2]
    for x, n in counted:
        if span[0] <= x <= span[1]:
            reached += n
            if reached > place:
                return x
    raise ValueError("no value at this place")


def _middle(n: int) -> dict[str, int]:
    return {"_low": (n - 1) // 2, "_high": n // 2}


def _ranks(n: int, quantiles: dict[str, float]) -> dict[str, int]:
    return {name: min(int(q * n), n - 1) for name, q in quantiles.items()}


def at_ranks(df: DataFrame, value: str, quantiles: dict[str, float], buckets: int = 1_000) -> dict[str, float | None]:
    """For each name the element at place floor(q * n), from 0, of the sorted values."""
    n, got = at_places(df, value, lambda n: _ranks(n, quantiles), buckets)
    return got if n else dict.fromkeys(quantiles)


def median(df: DataFrame, value: str) -> float | None:
    """The middle value, or the mean of the two in the middle."""
    return summary(df, value, {})[1]


def summary(df: DataFrame, value: str, quantiles: dict[str, float]) -> tuple[int, float | None, dict[str, float | None]]:
    """The number of values, their median, and what at_ranks gives."""
    n, got = at_places(df, value, lambda n: _middle(n) | _ranks(n, quantiles))
    if not n:
        return 0, None, dict.fromkeys(quantiles)
    return n, (got.pop("_low") + got.pop("_high")) / 2, got
