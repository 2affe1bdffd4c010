"""Sharding by sampled splitters.

Records are ordered by a hash of their text. Keys are sampled with a chance in proportion to the record's size, their
quantiles split the key space into ranges of about equal bytes, as many as the bytes ask for, and a record's range is found by
binary search over the splitters. The ranges' true bytes are then summed; one that holds more than twice its share is subdivided by a
second hash of the key. A text whose rows alone weigh more than that (there are at most half as many as ranges) is no part of
any range: it goes whole to the shard with the least in it, the heaviest text first, and only where no shard has room for it are its copies
dealt out in parts of a range's share. Shards then take consecutive ranges up to equal bytes, so all other equal texts stay together.

Law: `bytes` - the shards' bytes are near equal. Null texts count as empty (8 bytes); an empty table gives no rows. Repeated
rows are placed like any others, each with a slot of its own; very long texts are one row each, whatever they weigh. Other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesync.llm.common import store

SHARDS = 24
#: Ranges for each shard at least, bytes of a range, ranges at most, and sampled keys for each range (in expectation). They bound what the driver holds.
RANGES, RANGE_BYTES, MOST_RANGES, SAMPLES = 64, 256 << 20, 20_000, 16
#: A shard has room for a heavy text up to so many times its equal part of the bytes.
ROOM = 1.01
HEADER = 8


def _sampled(total: int, wanted: int) -> Column:
    """True with a chance of size * wanted / total, decided by a hash."""
    chance = F.col("size") * (wanted / total)
    return F.pmod(F.xxhash64("doc_id", "key", "row", F.lit("sample")), F.lit(1 << 30)) < chance * (1 << 30)


def _range_of(key: Column, splitters: list[int]) -> Column:
    """The number of splitters that are at most the key, by binary search."""
    size = 1 << len(splitters).bit_length()
    padded = F.lit(splitters + [(1 << 63) - 1] * (size - len(splitters)))
    steps = [size >> i for i in range(1, size.bit_length())]
    found = F.aggregate(F.lit(steps), F.lit(0), lambda low, step: F.when(F.element_at(padded, low + step) <= key, low + step).otherwise(low))
    return F.least(found, F.lit(len(splitters)))


def _prefix(sums: list[int]) -> list[int]:
    return [0, *accumulate(sums)][: len(sums)]


def _heavy_parts(heavy: list[tuple[int, int, int]], shards: int, target: float, share: int) -> tuple[list[tuple[int, int, int]], list[int | None]]:
    """(key, first part, parts) of the heavy texts (key, bytes, rows), and the shard of each of those parts; None where the text is dealt out."""
    held, rows, shard_of = [0.0] * shards, [], []
    for key, size, n in sorted(heavy, key=lambda k: (-k[1], k[0])):
        parts = -(-size // share)
        emptiest = min(range(shards), key=held.__getitem__)
        whole = n == 1 or held[emptiest] + size <= ROOM * target
        rows.append((key, len(shard_of), parts))
        for _ in range(parts):
            s = emptiest if whole else min(range(shards), key=held.__getitem__)
            held[s] += size / parts
            shard_of.append(s if whole else None)
    return rows, shard_of


def _dealt(shard_of: list[int | None], n_bytes: list[int], shards: int) -> tuple[list[int], list[int]]:
    """The shard of each heavy part, with those of dealt texts given to the emptiest shard by their true bytes, and what the shards then hold."""
    held, out = [0] * shards, list(shard_of)
    for s, size in zip(shard_of, n_bytes):
        if s is not None:
            held[s] += size
    for p in sorted((p for p, s in enumerate(shard_of) if s is None), key=lambda p: (-n_bytes[p], p)):
        out[p] = min(range(shards), key=held.__getitem__)
        held[out[p]] += n_bytes[p]
    return out, held


def shard(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES, samples: int = SAMPLES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row of docs (doc_id, text)."""
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    records = store(
        docs.select("doc_id", (F.octet_length(text) + HEADER).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row")), "records"
    )
    total = records.agg(F.sum("size")).first()[0]
    if total is None:
        return records.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    parts = max(shards * ranges, min(MOST_RANGES, total // RANGE_BYTES))
    share = max(1, total // parts)
    # texts of more than two shares: half as many as there are ranges, at most
    heavy = [(r.key, r.bytes, r.n) for r in records.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where(F.col("bytes") > 2 * share).collect()]
    known, shard_of = _heavy_parts(heavy, shards, total / shards, share)
    dealt = records.join(F.broadcast(spark.createDataFrame(known, "key long, first int, parts int")), "key", "left")
    light = dealt.where(F.col("first").isNull()).drop("first", "parts")

    keys = sorted(r.key for r in light.where(_sampled(total, parts * samples)).select("key").collect())
    splitters = sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []
    ranged = light.withColumn("range", _range_of(F.col("key"), splitters))
    n_ranges = len(splitters) + 1
    filled = dict(ranged.groupBy("range").agg(F.sum("size")).collect())
    split = [max(1, -(-filled.get(r, 0) // share)) if filled.get(r, 0) > 2 * share else 1 for r in range(n_ranges)]
    at = lambda values, i: F.element_at(F.lit(values), i + 1)
    part = at(_prefix(split), F.col("range")) + F.pmod(F.xxhash64("key", F.lit("part")), at(split, F.col("range"))).cast("int")
    of_heavy = (F.col("first") + F.pmod(F.xxhash64("doc_id", "row", F.lit("part")), F.col("parts"))).cast("int")
    n_parts = sum(split)
    columns = ["doc_id", "size", "text_crc32", "key"]
    parted = ranged.select(*columns, part.alias("part")).unionByName(dealt.where(F.col("first").isNotNull()).select(*columns, (of_heavy + n_parts).alias("part")))

    sums = {r.part: r for r in parted.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
    every = range(n_parts + len(shard_of))
    n_bytes, n_rows = ([sums[p][name] if p in sums else 0 for p in every] for name in ("bytes", "rows"))
    shard_of, held = _dealt(shard_of, n_bytes[n_parts:], shards)
    ends = _ends([total / shards - h for h in held], sum(n_bytes[:n_parts]))
    in_order = Window.partitionBy("part").orderBy("key")
    group = F.sum("size").over(Window.partitionBy("part", "key"))
    middle = at(_prefix(n_bytes), F.col("part")) + F.sum("size").over(in_order) - group / 2  # of all rows of the same key
    place = at(_prefix(n_rows), F.col("part")) + F.row_number().over(Window.partitionBy("part").orderBy("key", "doc_id")) - 1
    is_light = F.col("part") < n_parts
    own_shard = F.when(is_light, _range_of(middle.cast("long"), ends)).otherwise(at(shard_of or [0], F.greatest(F.col("part") - n_parts, F.lit(0))))
    placed = store(parted.select("doc_id", "size", "text_crc32", own_shard.cast("int").alias("shard"), place.alias("place"), "part"), "placed")
    lights = {r.shard: r for r in placed.where(is_light).groupBy("shard").agg(F.min("place").alias("first"), F.count("*").alias("rows")).collect()}
    starts = [lights[s]["first"] if s in lights else 0 for s in range(shards)]
    # a shard's heavy parts follow its ranges
    reached, offsets, before = [lights[s]["rows"] if s in lights else 0 for s in range(shards)], [], _prefix(n_rows)
    for p, s in enumerate(shard_of):
        offsets.append(reached[s] - before[n_parts + p])
        reached[s] += n_rows[n_parts + p]
    slot = F.when(is_light, F.col("place") - at(starts, F.col("shard"))).otherwise(F.col("place") + at(offsets or [0], F.greatest(F.col("part") - n_parts, F.lit(0))))
    return placed.select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def _ends(room: list[float], total: int) -> list[int]:
    """Where each shard but the last ends among the ranges' bytes: shards take them in proportion to the room that they have left."""
    room = [max(0.0, r) for r in room]
    scale = total / (sum(room) or 1)
    return [round(e * scale) for e in accumulate(room)][:-1]
