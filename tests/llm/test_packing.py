import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lakesync.llm import packing

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def check(rows, got, library, width):
    """Every piece as cut from the library's ids, every sequence gapless and within the width; the number of sequences."""
    want = Counter()
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % width or width
        bounds = [0, *range(first, len(ids) + 1, width)]
        for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= width
    return len(held)


def least_bins(items, width):
    """The fewest bins, by trying everything."""
    best = [len(items)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= width:
                place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best[0]


def lower_bound(lengths, width):
    """No packing has fewer bins: pieces over half a bin take one each, and what is left over must hold the middle ones."""
    best = -(-sum(lengths) // width)
    for k in range(width // 2 + 1):
        alone = sum(s > width - k for s in lengths)
        large = [s for s in lengths if width / 2 < s <= width - k]
        rest = sum(s for s in lengths if k <= s <= width / 2) - (len(large) * width - sum(large))
        best = max(best, alone + len(large) + max(0, -(-rest // width)))
    return best


def test_fullest_combination_against_all():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(0, 30)
        sizes = sorted(counts, reverse=True)
        sums = [(sum(s * n for s, n in zip(sizes, ns)), ns) for ns in product(*(range(counts[s] + 1) for s in sizes)) if sum(s * n for s, n in zip(sizes, ns)) <= room]
        want = max(sums)
        got = packing.fullest(counts, room)
        assert tuple(got.get(s, 0) for s in sizes) == want[1]


def test_plans_use_all_and_are_near_the_least():
    rng, over = random.Random(2), 0
    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        plan = packing.best_plan(Counter(items), 24)
        used = Counter()
        for times, chosen in plan:
            assert times > 0 and sum(s * n for s, n in chosen.items()) <= 24
            for s, n in chosen.items():
                used[s] += times * n
        assert used == Counter(items)
        over += sum(times for times, _ in plan) - least_bins(items, 24)
    assert over <= 1


def test_large_counts_need_few_combinations():
    rng = random.Random(3)
    counts = {s: rng.randint(1, 10**10) for s in range(1, 1025)}
    plan = packing.best_plan(counts, 1024)
    bins, tokens = sum(t for t, _ in plan), sum(s * c for s, c in counts.items())
    large = sum(c for s, c in counts.items() if s > 512)
    assert len(plan) < 8_000 and bins <= 1.005 * max(-(-tokens // 1024), large)


def test_whole_documents(spark, library):
    rng = random.Random(4)
    words = ["alpha", "Beta", "don't", "12", "  ", "\n", "é", "李", "<|endoftext|>", "a" * 50]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 60, 400])))) for i in range(300)] + [(None, None), (7, "twice"), (7, "twice"), (8, ""), (9, "word " * 3000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, length int, task string").repartition(7)
    bins = check(rows, packing.pack(docs, RANKS, P.PATTERN, 256).collect(), library, 256)
    lengths = [n for _, t in rows for _, n in packing.cut(len(library.encode(t or "", add_special_tokens=False).ids) + 1, 256)]
    assert lower_bound(lengths, 256) <= bins <= lower_bound(lengths, 256) + 1


def test_a_third_of_one_length(spark, library):
    rows = [(i, "same text here" if i % 3 == 0 else "more words " * (i % 50)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(rows, packing.pack(docs, RANKS, P.PATTERN).collect(), library, 1024)


def test_stretches_and_empty_table(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 64)
    rng = random.Random(5)
    own = packing.encoder(RANKS, P.PATTERN)
    for _ in range(200):
        text = "".join(rng.choices(["a", "b c", " ", "  ", "é", "1", "'s", "\n", "<|endoftext|>", "word word"], k=rng.randint(0, 150)))
        assert packing.encode(text, own).tolist() == library.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, RANKS, P.PATTERN).count() == 0
    assert [packing.cut(n, 4) for n in (1, 4, 5, 8)] == [[(0, 1)], [(0, 4)], [(0, 1), (1, 4)], [(0, 4), (4, 4)]]


def test_runs_without_a_break(library):
    own = packing.encoder(RANKS, P.PATTERN)
    for text in ("a" * 100_000, " " * 100_000, "!?" * 50_000):
        assert packing.encode(text, own).tolist() == library.encode(text, add_special_tokens=False).ids
