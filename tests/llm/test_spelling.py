import random
import re
import zlib
from collections import Counter

from lakesync.llm import spelling


def brute_words(rows, least_length=5, least_count=3, modulus=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    near = {w: [o for o in counts if is_near(w, o)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts) if counts else []


def order(rows):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows)


def test_against_brute_force(spark):
    rng = random.Random(1)
    for letters, low, high in (("ab", 1, 6), ("abcé", 2, 7), ("abcdefghijklmnopqrstuvwxyz÷ß", 4, 12)):
        base = ["".join(rng.choices(letters, k=rng.randint(low, high))) for _ in range(60)]
        typos = []
        for w in base * 4:
            i, c = rng.randrange(len(w)), rng.choice(letters)
            typos.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c, w]))
        bag = [w for w in {*base, *typos} if w for _ in range(rng.choice([1, 2, 3, 7, 20, 90]))]
        rng.shuffle(bag)
        rows = [(i % 40, " ".join(bag[i::90])) for i in range(90)]
        docs = spark.createDataFrame([(*r, "w", 3) for r in rows], "doc_id long, text string, word string, n int")
        got = spelling.variants(docs, least_length=low, least_count=2).collect()
        want = brute_variants(brute_words(rows, low, 2))
        assert order(got) == want and any(w[4] for w in want)


def test_large_nodes_are_broadcast_and_agree(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choices("abc", k=5)) for _ in range(200))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_variants(brute_words(rows))
    for least in (1, 10_000):  # all nodes, and none
        monkeypatch.setattr(spelling, "LARGE_LEAST", least)
        assert order(spelling.variants(docs).collect()) == want


def test_colliding_names_of_nodes(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_PRIME", 5)
    rows = [(1, "abcde abcdf abcd xbcde bbcde abccde zzzzz zzzzzz zzzz zzyzz " * 4)]
    assert order(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), least_length=4).collect()) == brute_variants(brute_words(rows, 4))


def test_letters_case_chains_and_ties(spark):
    rows = [(None, "ÉCOLE école Ecole école " * 5), (1, None), (2, ""), (3, "Ärger ärger " * 9)]
    rows += [(4, "aaaaa " * 3 + "aaaab " * 6 + "aaabb " * 12 + "aabbb " * 24), (4, "colour " * 5 + "color " * 10 + "colors " * 10), (4, "twice over " * 3), (4, "twice over " * 3), (5, "×÷×÷× " * 3)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), modulus=10**12).collect()}
    assert order(got.values()) == brute_variants(brute_words(rows, modulus=10**12))
    assert got["aaaaa"].root == "aabbb" and got["colour"].form == "color" and got["colors"].form is None and "École".lower() not in got["ecole"].word
    assert got["Ärger"].n == 9 and got["twice"].n == 6 and got["×÷×÷×"].n == 3


def test_very_long_runs_and_no_rows(spark):
    long = "ab" * 4_000
    rows = [(1, f"{long} {long} {long} {long}"), (2, f"{long}c {long}c {long}c {long[1:]} {long[1:]} {long[1:]} {long[1:]}")]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), modulus=10**12).collect()
    assert order(got) == brute_variants(brute_words(rows, modulus=10**12))
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_third_of_one_word(spark):
    rows = [(i, "hotword " * 20 if i % 3 == 0 else f"hotwor{'abcdefgh'[i % 8]} other{'abc'[i % 3]}s " * 3) for i in range(300)]
    assert order(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()) == brute_variants(brute_words(rows))
