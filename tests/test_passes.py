"""What a row costs: each path is made once, folds don't sort, routes are found by folder, logs have few segments."""

import random

from pyspark.sql import functions as F

from lakesync.config import ADD_CANDIDATE, CREATED, DELETED, DROP_CANDIDATE, SyncConfig
from lakesync.functions import paths
from lakesync.functions.moments import moment, seq_of, time_of
from lakesync.operators import intents, inventory, sessions
from lakesync.plans import registry
from lakesync.sources import envelopes, eventlog

SF = "/root/testdata/sf0.001"
ENVELOPE = "seq long, t_us long, tenant_id string, op string, object_key string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_path_is_put_together_once_a_row(spark):
    for rows in (intents.candidate_intents(envelopes.read(spark, SF)), inventory.live_inventory(intents.kept(envelopes.read(spark, SF)))):
        assert plan(rows).count("date_format") == 1


def test_folds_of_objects_do_not_sort(spark):
    assert "SortAggregate" not in plan(inventory.live_inventory(intents.kept(envelopes.read(spark, SF))))


def test_folds_go_by_time_then_number(spark):
    rows = spark.createDataFrame([(5, 10, "a", CREATED, "x"), (6, 10, "a", DELETED, "x"), (9, 10, "a", DELETED, "y"), (2, 11, "a", CREATED, "y"), (1, None, "a", DELETED, "z"), (0, -4, "a", CREATED, "z"), (-2, -9, "b", CREATED, "x"), (-1, -9, "b", None, "x")], ENVELOPE)
    assert {(r.tenant_id, r.object_key, r.live) for r in inventory.fold_objects(rows).collect()} == {("a", "x", False), ("a", "y", True), ("a", "z", True), ("b", "x", False)}
    last = inventory.last_operations(rows)
    assert last.count() == 8 and {tuple(r) for r in inventory.fold_objects(last).collect()} == {tuple(r) for r in inventory.fold_objects(rows).collect()}


def test_moments_keep_their_times_and_order(spark):
    pairs = [(1704067211172425, 5), (-7, -3), (0, 0), (-(2**61) + 1, -(2**63)), (2**61 - 1, 2**63 - 1), (3, 2**63 - 1), (4, -(2**63))]
    m = spark.createDataFrame(pairs, "t long, s long").withColumn("m", moment(F.col("t"), F.col("s")))
    got = m.select("t", "s", time_of(F.col("m")).alias("t2"), seq_of(F.col("m")).alias("s2"), "m").collect()
    assert all((r.t, r.s) == (r.t2, r.s2) for r in got) and [r.m for r in sorted(got)] == sorted(r.m for r in got)


def test_partition_keys_of_odd_paths(spark):
    root = "warehouse/sales/"
    cases = {
        "dt=1/region=2/p.orc": "dt=1/region=2", "dt=1/foo/region=2/p.orc": "dt=1/region=2", "foo/dt=1/p.orc": "dt=1", "dt=1/foo/p.orc": "dt=1", "foo/bar/p.orc": "", "p.orc": "", "a=b=c/p.orc": "a=b=c",
        "//dt=1//p=.orc": "dt=1", "=/x/p.orc": "=", "dt=1/": "dt=1", "f=1.orc": "", "dt=1/\n/h=\n2/p": "dt=1/h=\n2", "": "",
    }
    rows = spark.createDataFrame([(root + k, v) for k, v in cases.items()] + [("warehouse/other/dt=1/p.orc", ""), ("x", ""), ("", "")], "k string, want string")
    for r in rows.select("k", "want", paths.partition_key(F.col("k")).alias("got"), (paths.in_root(F.col("k")) & paths.has_partition(F.col("k"))).alias("has")).collect():
        assert r.got == r.want and r.has == (r.want != ""), r


def test_proofs_are_the_first_additions(spark):
    draw = random.Random(5)
    rows = [(i, draw.randrange(40), "a", "t", f"k={draw.randrange(6)}", ADD_CANDIDATE if draw.random() < 0.5 else DROP_CANDIDATE) for i in range(400)] + [(1000, 7, "a", "t", "k=lone", ADD_CANDIDATE), (1001, 7, None, "t", "k=null", ADD_CANDIDATE)]
    frame = spark.createDataFrame(rows, "seq long, t_us long, tenant_id string, table_fqn string, partition_key string, kind string").withColumn("partition_prefix", F.lit("p")).withColumn("proof", F.col("seq").cast("string"))
    for proofs in (1, 3, 5):
        want = {}
        for seq, _, _, _, key, kind in sorted(rows, key=lambda r: (r[1], r[0])):
            want.setdefault(key, []).extend([str(seq)] if kind == ADD_CANDIDATE else [])
        assert {r.partition_key: r.proof_keys for r in sessions.reconcile(frame, SyncConfig(proofs=proofs)).collect()} == {k: v[:proofs] for k, v in want.items()}


def test_routes_take_the_longest_root_and_keep_every_row(spark):
    """Rows that tell the same twice stay two; a row of no route is left out."""
    rows = spark.createDataFrame([(1, 1, "a", CREATED, "w/x/y/k=1/p.orc"), (1, 1, "a", CREATED, "w/x/y/k=1/p.orc"), (2, 1, "a", CREATED, "w/x/k=2/p.orc"), (3, 1, "a", CREATED, "v/k=2/p.orc"), (4, 1, "a", CREATED, "w/x/p.orc"), (5, 1, "a", CREATED, "p.orc")], ENVELOPE)
    routes = spark.createDataFrame([("w/", "one"), ("w/x/y/", "three"), ("w/x/", "two")], "table_root string, table_fqn string")
    got = sorted((r.seq, r.table_fqn, r.partition_prefix) for r in intents.routed_intents(rows, routes).collect())
    assert got == [(1, "three", "w/x/y/k=1/"), (1, "three", "w/x/y/k=1/"), (2, "two", "w/x/k=2/")]


def test_a_large_log_has_few_segments(spark):
    rows = spark.range(200_000).select(F.col("id").alias("seq"), F.concat(F.lit("k"), (F.col("id") % 50).cast("string")).alias("key"), F.lit("v").alias("value"))
    path = registry._log(spark, rows, 2)
    segments = sum(-(-(e["end"] - e["first"] + 1) // e["segment"]) for e in eventlog.manifest(path))
    assert segments <= registry._SEGMENTS + 2
    got = eventlog.read(spark, path).groupBy("partition").agg(F.count("*").alias("n"), F.count_distinct("offset").alias("d"), F.max("offset").alias("m")).collect()
    assert sum(r.n for r in got) == 200_000 and all(r.n == r.d == r.m for r in got)
