import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lakesync.llm import sharding


def check(rows, got, shards):
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, held = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        held[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return [held[s] for s in range(shards)]


def test_equal_bytes_gapless_slots_and_groups(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.choice([0, 10, 200, 3000]) + str(i if i % 7 else i % 21)) for i in range(4000)] + [(None, None), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, shard int")
    got = sharding.shard(docs, 24).collect()
    held = check(rows, got, 24)
    assert max(held) <= 1.1 * sum(held) / 24 and min(held) >= 0.9 * sum(held) / 24
    of_text = defaultdict(set)
    text = dict((i, t) for i, t in rows if i != 7)
    for r in got:
        if r.doc_id in text and Counter(text.values())[text[r.doc_id]] < 5:
            of_text[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in of_text.values())


def test_a_third_of_all_rows_equal(spark):
    rows = [(i, "same text " * 30 if i % 3 == 0 else f"own text {i} " * 20) for i in range(6000)]
    held = check(rows, sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect(), 24)
    assert max(held) <= 1.05 * min(held)


def brute_heavy(rows, shards, ranges):
    """Every text of more than two ranges' share, heaviest first, into the emptiest shard if it has room: {text: shard or None if dealt out}."""
    weight = Counter()
    for _, t in rows:
        weight[t or ""] += len((t or "").encode()) + 8
    total, copies = sum(weight.values()), Counter(t or "" for _, t in rows)
    share = total // (shards * ranges)
    out, held = {}, [0.0] * shards
    for size, text in sorted(((w, t) for t, w in weight.items() if w > 2 * share), reverse=True):
        low = min(held)
        if copies[text] == 1 or low + size <= 1.01 * total / shards:
            held[held.index(low)] += size
            out[text] = True
        else:
            parts = -(-size // share)
            for _ in range(parts):
                held[held.index(min(held))] += size / parts
            out[text] = False
    return out


def test_classes_stay_whole_wherever_a_shard_has_room(spark):
    rng = random.Random(8)
    rows = [(i, f"own {i} " + "y" * rng.choice([10, 200, 900])) for i in range(6000)]
    for k, n in enumerate([700, 300, 300, 290, 40, 8, 8000]):
        rows += [(10_000 * (k + 1) + i, f"class {k} " + "z" * 90) for i in range(n)]
    rows += [(99_999, "v" * 400_000), (99_998, None), (99_997, "")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 24, 64).collect()
    held = check(rows, got, 24)
    rest = sorted(held)[:-1]  # one row weighs more than its shard's part
    assert max(held) == 400_008 and max(rest) <= 1.1 * sum(rest) / 23 and min(rest) >= 0.9 * sum(rest) / 23
    shards_of, text = defaultdict(set), dict(rows)
    for r in got:
        shards_of[text[r.doc_id] or ""].add(r.shard)
    whole = brute_heavy(rows, 24, 64)
    assert sorted(t.split()[1] for t, w in whole.items() if not w) == ["6"] and len(whole) >= 6
    assert all((len(shards_of[t]) == 1) == w for t, w in whole.items())
    assert all(len(s) == 1 for t, s in shards_of.items() if t not in whole)


def test_few_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    check([(1, "a"), (2, None)], sharding.shard(docs, 24).collect(), 24)
    assert sharding.shard(docs.limit(0)).count() == 0


def test_ranges_by_binary_search(spark):
    for splitters in ([], [5], [1, 5, 9], list(range(0, 100, 3))):
        rows = spark.range(-3, 110).select("id", sharding._range_of(F.col("id"), splitters).alias("r")).collect()
        assert all(r.r == sum(s <= r.id for s in splitters) for r in rows)
