"""Similarity join of documents on the Jaccard index of their word n-grams, by a MinHash LSH forest.

A document's set holds the hashes of its runs of `WIDTH` words (of all its words, if it has fewer). Documents with equal sets are
copies; one stands for all. Each tree of the forest labels a set with the sequence of `DEPTH` minima of its hashes; the labels,
as numbers, sort like a trie of prefixes. A set starts in all trees with its longest prefixes. They are shortened a symbol at a
time, in the tree where the shorter prefix has the fewest members first, until 1 - product(1 - s ** depth) over the trees
reaches the target at similarity s: a set that is alone under its shortest prefix of a tree has that tree for free, and crowded
prefixes stay long. Sets meet in the nodes that one of them has chosen. In a node all pairs are compared by their whole
signatures, as linked parts against the rest; only what is alike there by a wide margin joins a group, and all pairs of a group are
verified exactly, in blocks of bounded size, by tasks that count links and hand on a spanning forest of them instead of pairs.
Components of the links are the classes.

Words are those of `common.words`. Documents without words (null, empty, only punctuation) resemble nothing. Rows that repeat
are copies of each other. A class is named by its smallest doc_id (null first). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesync.llm.common import broadcast_if_small, free_names, released, store
from lakesync.llm.components import connected_components

WIDTH, SIMILARITY = 5, 0.8
TREES, DEPTH, SHORTEST, RECALL = 20, 8, 4, 0.9999
#: Share of equal symbols that makes a pair worth verifying; over 160 symbols a pair at 0.8 falls below it once in a million.
ALIKE = 0.65
#: Sets of a node that meet in one task by their signatures, and hashes of a block of sets that are verified together.
SKETCH_BLOCK, BLOCK = 1_024, 65_536
_SLICE = 300
_NOT_WORD = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_BLANKED = bytes(b + 32 if 65 <= b <= 90 else 32 if b in _NOT_WORD else b for b in range(256))


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams."""
    lists = [(t or b"").translate(_BLANKED).split() for t in texts]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for words in lists for w in words))}
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    out = []
    for words in lists:
        h = hashes[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]
        n = len(h) - width + 1
        if not len(h):
            out.append(h)
            continue
        gram = np.zeros(max(n, 1), np.uint64)
        for k in range(min(width, len(h))):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + (h[k : k + max(n, 1)] ^ (h[k : k + max(n, 1)] >> np.uint64(31)))
        gram ^= gram >> np.uint64(32)
        gram *= np.uint64(0xD6E8FEB86659FD93)
        out.append(np.unique(gram ^ (gram >> np.uint64(29))))
    return out


def _set_name(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def signatures(sets: list[np.ndarray], trees: int = TREES, seed: int = 17) -> np.ndarray:
    """Symbols of 16 bits: sets x trees x DEPTH."""
    factor = np.random.default_rng(seed).integers(1, 2**63, trees * DEPTH, dtype=np.uint64) | np.uint64(1)
    out = np.zeros((len(sets), trees * DEPTH), np.uint16)
    for i, grams in enumerate(sets):
        low = np.full(trees * DEPTH, np.iinfo(np.uint64).max)
        for at in range(0, len(grams), 1_024):
            low = np.minimum(low, (grams[at : at + 1_024, None] * factor).min(0))
        out[i] = low >> np.uint64(20) & np.uint64(0xFFFF)
    return out.reshape(len(sets), trees, DEPTH)


def sketches(docs: DataFrame, width: int = WIDTH, trees: int = TREES) -> DataFrame:
    """doc_id, doc_key, name (of the set; null: no words), n (its size), labels (for each tree two numbers of four symbols each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE):
                part = batch.slice(start, _SLICE)
                sets = shingle_sets(part.column("text").cast(pa.binary()).to_pylist(), width)
                sizes = np.fromiter(map(len, sets), np.int32, len(sets))
                held = np.flatnonzero(sizes)
                # the first symbol is the highest part of a number, so that labels sort as their sequences do
                label = signatures([sets[i] for i in held], trees)[:, :, ::-1].copy().view(np.int64)[:, :, ::-1]
                ends = np.zeros(len(sets) + 1, np.int32)
                np.cumsum(np.where(sizes > 0, 2 * trees, 0), out=ends[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("doc_key"), pa.array([_set_name(g) if len(g) else None for g in sets], pa.binary()), pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(label.ravel())),
                    ],
                    names=["doc_id", "doc_key", "name", "n", "labels"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc_key"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(released(run), f"doc_id {kind}, doc_key long, name binary, n int, labels array<long>")


def chosen_depths(members: np.ndarray, similarity: float = SIMILARITY, recall: float = RECALL) -> np.ndarray:
    """Depths by set and tree. members: sets x trees x depths from SHORTEST to DEPTH, the number of sets under each prefix.

    From the longest prefixes on, the one whose shorter form has the fewest members is shortened, until the target is reached or all are at their shortest.
    """
    n, trees, levels = members.shape
    miss = np.log1p(-(similarity ** np.arange(SHORTEST, DEPTH + 1)))  # log of the chance that a tree shows nothing, by depth
    depth = np.full((n, trees), DEPTH)
    # a step to depth d costs the members under the shorter prefix; of equal costs the longer prefix goes first
    cost = members[:, :, :-1].reshape(n, -1) * (levels * 1.0) + (levels - 1 - np.tile(np.arange(levels - 1), trees))
    order = np.argsort(cost, axis=1, kind="stable")
    gain = np.tile(miss[1:] - miss[:-1], trees)[order]
    reached = trees * miss[-1] - np.cumsum(gain, axis=1)
    used = np.concatenate([np.full((n, 1), trees * miss[-1]), reached[:, :-1]], 1) > np.log1p(-recall) + 1e-12
    row, at = np.nonzero(used)
    tree, level = np.divmod(order[row, at], levels - 1)
    np.minimum.at(depth, (row, tree), SHORTEST + level)
    return depth


def _prefix(low: Column, depth: Column) -> Column:
    """The symbols of a label's second number that belong to its prefix of a depth."""
    drop = 16 * (DEPTH - depth)
    return F.when(drop >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", low, drop))


def forest_nodes(sets: DataFrame, trees: int = TREES, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """node, number, first, size: the sets that meet in a node which one of them has chosen. sets: number, labels."""
    at = lambda i: F.get("labels", i)
    spread = sets.select("number", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(at(2 * t).alias("high"), at(2 * t + 1).alias("low")))).alias("tree", "x")).select("number", "tree", "x.high", "x.low")
    # the shortest prefix is the first number: a set that is alone under it meets nobody in that tree
    crowded = spread.groupBy("tree", "high").agg(F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    met = store(spread.join(crowded, ["tree", "high"]), "met")
    paths = met.withColumn("depth", F.explode(F.array(*map(F.lit, range(SHORTEST, DEPTH + 1))))).withColumn("prefix", _prefix(F.col("low"), F.col("depth"))).drop("low")
    node = ["tree", "depth", "high", "prefix"]
    sizes = store(paths.groupBy(*node).agg(F.count("*").alias("size"), F.min("number").alias("first"), F.sum(F.xxhash64("number").cast("decimal(38,0)")).alias("sign")).where(F.col("size") > 1), "nodes")
    known = paths.join(sizes, node).select("number", "tree", "depth", "high", "prefix", "size")
    by_set = known.groupBy("number").agg(F.collect_list(F.struct("tree", "depth", "size")).alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = np.ones((batch.num_rows, trees, DEPTH - SHORTEST + 1))
            rows = batch.column("sizes")
            owner, inner = np.repeat(np.arange(len(rows)), np.diff(rows.offsets.to_numpy())), rows.flatten()
            tree, depth, size = (inner.field(k).to_numpy() for k in range(3))
            members[owner, tree, depth - SHORTEST] = size
            chosen = chosen_depths(members, similarity, recall)
            where = np.nonzero(members[np.arange(len(members))[:, None], np.arange(trees), chosen - SHORTEST] > 1)
            yield pa.RecordBatch.from_arrays([batch.column("number").take(pa.array(where[0])), pa.array(where[1].astype(np.int32)), pa.array(chosen[where].astype(np.int32))], names=["number", "tree", "depth"])

    chosen = store(by_set.mapInArrow(released(run), "number long, tree int, depth int"), "chosen")
    opened = met.join(chosen, ["number", "tree"]).select("tree", "depth", "high", _prefix(F.col("low"), F.col("depth")).alias("prefix")).distinct()
    # of nodes one above the other the shorter prefix holds all members of the longer one; of nodes with the same members one is enough
    on_path = paths.join(opened, node).groupBy("number", "tree").agg(F.min(F.struct("depth", "high", "prefix")).alias("p")).select("number", "tree", "p.*")
    top = store(on_path.select(*node).distinct().join(sizes, node), "top")
    once = top.groupBy("size", "first", "sign").agg(F.min(F.struct(*node)).alias("at")).select("at.*", "size", "first")
    return on_path.join(once, node).select(F.xxhash64(*node).alias("node"), "number", "first", "size")


def _lanes(column: pa.ListArray) -> np.ndarray:
    """Lists of labels as rows of 16-bit symbols."""
    return np.ascontiguousarray(column.flatten().to_numpy()).view(np.uint16).reshape(len(column), -1)


def _with_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        share = (_lanes(batch.column("labels")) == _lanes(batch.column("other"))).mean(1) if batch.num_rows else np.zeros(0)
        alike = pa.array(share >= ALIKE)
        yield pa.RecordBatch.from_arrays([batch.column("number").filter(alike), batch.column("first").filter(alike)], names=["u", "v"])


def _spanning(rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """(part, smallest part reached) of the parts whose sets are alike, of one pair of blocks. rows: number, part, left, right, labels."""
    part, left, right = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    lanes = np.stack([np.frombuffer(r[4], np.uint16) for r in rows])
    names, own_part = np.unique(part, return_inverse=True)
    root = np.arange(len(names))
    ours, others = np.flatnonzero(left), np.flatnonzero(right)
    for low in range(0, len(ours), 64):
        own = ours[low : low + 64]
        same = np.zeros((len(own), len(others)), np.int32)
        for k in range(lanes.shape[1]):
            same += lanes[own, k][:, None] == lanes[others, k]
        for i, alike in zip(own, same >= ALIKE * lanes.shape[1]):
            met = np.unique(root[np.append(own_part[others[alike]], own_part[i])])
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
    changed = np.flatnonzero(root != np.arange(len(names)))
    yield from zip(names[changed].tolist(), names[root[changed]].tolist())


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the linked parts of sets that are alike, for each pair of blocks that meet in a node; rows come sorted by node, i, j."""
    rows = lambda edges: pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in range(2)], names=["u", "v"])
    key, held = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("node", "i", "j", "number", "part", "left", "right")]
        lanes, found = _lanes(batch.column("labels")), []
        for k, (node, i, j, *row) in enumerate(zip(*columns)):
            if (node, i, j) != key:
                found.extend(_spanning(held) if held else ())
                key, held = (node, i, j), []
            held.append((*row, lanes[k].tobytes()))
        yield rows(found)
    yield rows(list(_spanning(held)) if held else [])


def candidate_groups(sets: DataFrame, trees: int = TREES, similarity: float = SIMILARITY, recall: float = RECALL, block: int = SKETCH_BLOCK) -> DataFrame:
    """number, root: sets that are alike by their signatures to one that they meet in the forest, directly or through others. sets: number, labels."""
    nodes = store(forest_nodes(sets, trees, similarity, recall), "forest")
    own = sets.select("number", "labels")
    # first each member against the node's first one: of a node of copies nothing is left to compare
    beside = nodes.where(F.col("number") != F.col("first")).select("number", "first").distinct().join(own, "number")
    firsts = own.select(F.col("number").alias("first"), F.col("labels").alias("other"))
    linked = store(connected_components(beside.join(firsts, "first").select("number", "first", "labels", "other").mapInArrow(_with_first, "u long, v long")), "linked")
    placed = nodes.join(linked.select(F.col("node").alias("number"), "root"), "number", "left")
    placed = store(placed.select("node", "number", "size", F.coalesce("root", "number").alias("part")), "parts")
    # then, in nodes of several linked parts, all members but those of the largest part against all members
    parts = placed.groupBy("node", "part").agg(F.count("*").alias("n"))
    large = parts.groupBy("node").agg(F.max(F.struct("n", "part")).alias("m"), F.count("*").alias("parts")).where(F.col("parts") > 1).select("node", F.col("m.n").alias("n_large"), F.col("m.part").alias("large"))
    open_nodes = placed.join(large, "node").withColumn("rest", F.col("part") != F.col("large"))
    rest_blocks, large_blocks = F.ceil((F.col("size") - F.col("n_large")) / block).cast("int"), F.ceil(F.col("n_large") / block).cast("int")
    slot = F.pmod(F.xxhash64("number"), F.when(F.col("rest"), rest_blocks).otherwise(large_blocks)).cast("int")
    dealt = open_nodes.withColumns({"b": slot, "rb": rest_blocks, "lb": large_blocks})
    # i: a block of the rest; j: a later or the same one of the rest, or, counted on from them, one of the large part
    as_left = dealt.where("rest").select("node", "number", "part", F.col("b").alias("i"), F.explode(F.sequence(F.col("b"), F.col("rb") + F.col("lb") - 1)).alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right"))
    as_right = dealt.where("rest").select("node", "number", "part", F.explode(F.sequence(F.lit(0), F.col("b"))).alias("i"), F.col("b").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    as_large = dealt.where(~F.col("rest")).select("node", "number", "part", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("i"), (F.col("b") + F.col("rb")).alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    units = as_left.unionByName(as_right).unionByName(as_large).join(own, "number").repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")
    more = connected_components(units.mapInArrow(_across, "u long, v long")).withColumnsRenamed({"node": "part", "root": "whole"})
    every = linked.select(F.col("node").alias("number"), F.col("root").alias("part")).unionByName(more.select(F.col("part").alias("number"), "part").join(linked.select(F.col("node").alias("number")), "number", "left_anti"))
    return every.join(more, "part", "left").select(F.col("number").alias("node"), F.coalesce("whole", "part").alias("root"))


def _joined(numbers: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], side: np.ndarray, across: bool, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the sets of one or two blocks: linked documents, linked sets and the smallest number reached, for each; across: only pairs of both sides."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), size)
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    use = shared[gram]
    gram, owner = column[gram[use]], owner[use]
    common = np.zeros((len(sets), len(sets)))
    by_gram = np.argsort(gram, kind="stable")
    gram, owner = gram[by_gram], owner[by_gram]
    step = max(1, 4_000_000 // len(sets))  # columns of the incidence matrix that are held at once
    for low in range(0, int(gram[-1]) + 1 if len(gram) else 0, step):
        a, b = np.searchsorted(gram, [low, low + step])
        held = np.zeros((len(sets), step), np.float32)
        held[owner[a:b], gram[a:b] - low] = 1
        common += held @ held.T
    union = size[:, None] + size[None, :] - common
    linked = common >= similarity * union - 1e-9
    np.fill_diagonal(linked, False)
    if across:
        linked &= side[:, None] != side[None, :]
    root = np.arange(len(sets))
    while True:  # smallest place reached, a hop at a time and then along the roots
        best = np.minimum(root, np.where(linked, root[None, :], len(sets)).min(1))
        best = np.minimum(best, best[best])
        if (best == root).all():
            break
        root = best
    return (linked * copies[None, :]).sum(1), linked.sum(1), numbers[root]


def verified_links(members: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """number, docs, texts, reached: partial counts of links, and edges that span them. members: root, size and hashes (of the group), number, copies, grams."""
    blocks = F.least(F.col("size"), F.ceil(F.col("hashes") / block)).cast("int")
    own = F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "number", "copies", "grams")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
        key, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("root", "i", "j", "own", "number", "copies", "grams")]
            for root, i, j, own_block, number, copies, grams in zip(*columns):
                if (root, i, j) != key:
                    if held:
                        yield key, held
                    key, held = (root, i, j), []
                held.append((number, copies, own_block, grams))
        if held:
            yield key, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], []]
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["number", "docs", "texts", "reached"])
        for (_, i, j), held in groups(batches):
            once = sorted({h[0]: h for h in held}.values(), key=lambda h: h[0])
            if len(once) < 2:
                continue
            numbers, copies, side = (np.array([h[k] for h in once]) for k in range(3))
            docs, texts, reached = _joined(numbers, copies, [np.frombuffer(h[3], np.uint64) for h in once], side, i != j, similarity)
            some = texts > 0
            for x, y in zip(out, (numbers, docs, texts, reached)):
                x.extend(y[some].tolist())
            if len(out[0]) > 10_000:
                yield rows()
                out = [[], [], [], []]
        yield rows()

    # the groups are many and small: they are dealt by a hash and told apart as they come, sorted
    ordered = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return ordered.mapInArrow(released(run), "number long, docs long, texts long, reached long")


def set_members(docs: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """wanted with grams (uint64 bytes), from the texts of the documents that stand for the sets. wanted: doc_id, doc_key, name and more."""
    names = [c for c in wanted.columns if c not in ("doc_id", "doc_key")]
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc_key"), "text")
    joined = texts.join(broadcast_if_small(wanted), texts.doc_id.eqNullSafe(wanted.doc_id) & (texts.doc_key == wanted.doc_key)).select(*names, "text")
    kinds = [f"{c} {wanted.schema[c].dataType.simpleString()}" for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE):
                part = batch.slice(start, _SLICE)
                grams = [g.tobytes() for g in shingle_sets(part.column("text").cast(pa.binary()).to_pylist(), width)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(grams, pa.binary())], names=[*names, "grams"])

    return joined.mapInArrow(released(run), ", ".join([*kinds, "grams binary"]))


def join_classes(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """doc_id, doc_key, class_id, first_key (doc_key of the document that names the class), n_copies, n_links (other documents at or above the similarity), n_texts (other sets)."""
    rows = store(sketches(docs, width, trees), "sketches")
    worded = rows.where(F.col("name").isNotNull())
    # equal sets have equal labels; the smallest document stands for them
    grouped = worded.groupBy("name").agg(F.min(F.struct("doc_id", "doc_key")).alias("d"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("labels").alias("labels"))
    sets = store(grouped.select("name", "d.doc_id", "d.doc_key", "copies", "n", "labels", F.monotonically_increasing_id().alias("number")), "sets")
    groups = store(candidate_groups(sets, trees, similarity, recall), "groups")
    grouped = store(groups.join(sets.drop("labels"), groups.node == sets.number).select("doc_id", "doc_key", "root", "number", "copies", "n"), "grouped")
    sizes = grouped.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("hashes"))
    wanted = grouped.drop("n").join(sizes, "root")
    links = store(verified_links(set_members(docs, store(wanted, "wanted"), width), similarity), "links")
    spanning = connected_components(links.select(F.col("number").alias("u"), F.col("reached").alias("v")))
    counts = links.groupBy("number").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    full = sets.drop("labels", "n").join(counts, "number", "left").join(spanning, F.col("number") == F.col("node"), "left")
    full = store(full.select("name", "doc_id", "doc_key", "copies", F.coalesce("root", "number").alias("root"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("texts", F.lit(0)).alias("texts")), "linked")
    classes = full.groupBy("root").agg(F.min(F.struct("doc_id", "doc_key")).alias("first"))
    known = full.join(classes, "root").select(
        F.col("name").alias("set"), F.col("first.doc_id").alias("class_id"), F.col("first.doc_key").alias("first_key"), F.col("copies").alias("n_copies"), (F.col("docs") + F.col("copies") - 1).alias("n_links"), F.col("texts").alias("n_texts")
    )
    alone = rows.where(F.col("name").isNull()).select("doc_id", "doc_key", F.col("doc_id").alias("class_id"), F.col("doc_key").alias("first_key"), *[F.lit(x).cast("long").alias(n) for x, n in ((1, "n_copies"), (0, "n_links"), (0, "n_texts"))])
    return worded.join(known, worded.name == known.set).select("doc_id", "doc_key", "class_id", "first_key", "n_copies", "n_links", "n_texts").unionByName(alone)


def keep_first(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each class, the one that names it; documents without words stay. Rows, columns and texts are unchanged."""
    found = store(join_classes(docs, width, similarity), "classes")
    own_id, own_key, own_row = free_names(docs, "own_id", "own_key", "own_row")
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("doc_key") == F.col("first_key"))
    worded = F.col("n_links") > 0
    dropped = found.where(worded & ~first).select(F.col("doc_id").alias(own_id), F.col("doc_key").alias(own_key)).distinct()
    # a row that stands several times is kept once: such rows are taken out and put back without their repeats
    again = store(found.where(worded & first).groupBy(F.col("doc_id").alias(own_id), F.col("doc_key").alias(own_key)).agg(F.count("*").alias("n")).where(F.col("n") > 1).drop("n"), "again")
    same = docs["doc_id"].eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(own_key))
    repeated = again.count()
    gone = dropped.unionByName(again) if repeated else dropped
    kept = docs.join(broadcast_if_small(gone), same, "left_anti")
    if repeated:
        # copies may differ in other columns: the row whose JSON sorts first stays, as some kinds of column have no order
        names = docs.columns
        row = F.struct(*[docs[c] for c in names])
        back = docs.join(broadcast_if_small(again, repeated), same, "left_semi").groupBy(docs["doc_id"], F.xxhash64(docs["text"]).alias(own_key)).agg(F.min_by(row, F.to_json(row)).alias(own_row))
        kept = kept.unionByName(back.select(*[F.col(own_row)[c].alias(c) for c in names]))
    return kept
