"""Trees of digests: what differs is found, equal folders stay closed, and a tree follows its changes."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakesync.operators import hashtree

SCHEMA = "tenant_id string, table_fqn string, partition_key string"
PATHS = st.lists(st.sampled_from(["a=1", "a=2", "b=1", "b=2", ""]), min_size=1, max_size=3).map("/".join)
ROWS = st.sets(st.tuples(st.sampled_from(["t", "", None]), st.just("f"), PATHS), max_size=12)


def frame(spark, rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def unequal(spark, ours, theirs):
    return hashtree.descend(*(hashtree.written(hashtree.tree(frame(spark, rows))) for rows in (ours, theirs)))


def folders(rows):
    return {(t, "/".join(k.split("/")[:i])) for t, _, k in rows for i in range(len(k.split("/")))}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(ROWS, ROWS)
def test_differences_are_those_of_the_sets(spark, ours, theirs):
    got = {tuple(r) for r in hashtree.differences(unequal(spark, ours, theirs)).collect()}
    assert got == {(*r, "ADD") for r in theirs - ours} | {(*r, "DROP") for r in ours - theirs}


def test_equal_and_empty_trees_are_closed(spark):
    rows = {("t", "f", f"a={i}/b={j}") for i in range(5) for j in range(4)}
    assert unequal(spark, rows, rows).isEmpty() and unequal(spark, [], []).isEmpty()
    got = unequal(spark, rows, [])
    assert hashtree.differences(got).count() == 20 and hashtree.requests(got).first()[1] == len(folders(rows))


def test_one_difference_opens_one_folder_a_level(spark):
    rows = [("t", "f", f"a={i}/b={j}/c={k}") for i in range(20) for j in range(20) for k in range(5)]
    got = unequal(spark, rows, [*rows[1:], ("t", "f", "a=7/b=7/c=9")])
    assert {(r.partition_key, r.action) for r in hashtree.differences(got).collect()} == {(rows[0][2], "DROP"), ("a=7/b=7/c=9", "ADD")}
    assert hashtree.requests(got).first()[1] == 1 + 2 + 2


def test_a_level_reads_the_parts_of_opened_folders_only(spark):
    nodes = hashtree.written(hashtree.tree(frame(spark, [("t", "f", f"a={i}/b={j}") for i in range(200) for j in range(5)])))
    opened = frame(spark, [("t", "f", "a=3")]).withColumnRenamed("partition_key", "prefix")
    bucket = opened.select(F.pmod(F.hash("prefix"), F.lit(hashtree.BUCKETS))).first()[0]
    part = hashtree._children(nodes, 2, opened, [bucket])
    assert part.count() == 5
    filters = next(line for line in part._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1:])
    assert filters.startswith("[isnotnull(level#") and f"= {bucket})" in filters.split("PushedFilters")[0]
    files = {f.rsplit("/part-", 1)[0] for f in nodes.inputFiles()}
    assert len(files) > 60  # of which the filters leave one folder



def test_repeated_keys_count_once_and_null_names_none(spark):
    nodes = hashtree.tree(frame(spark, [("t", "f", "a=1")] * 3 + [("t", "f", None)]))
    assert {(r.level, r.prefix, r.n, r.own) for r in nodes.collect()} == {(0, "", 1, 0), (1, "a=1", 1, 1)}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(ROWS, ROWS)
def test_an_updated_tree_is_the_tree_of_what_is_left(spark, before, after):
    changes = [(*r, True) for r in after - before] + [(*r, False) for r in before - after]
    got = hashtree.updated(hashtree.tree(frame(spark, before)), spark.createDataFrame(changes, SCHEMA + ", added boolean"))
    want = hashtree.tree(frame(spark, after))
    assert {tuple(r[c] for c in want.columns) for r in got.collect()} == {tuple(r) for r in want.collect()}
