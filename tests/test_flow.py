"""Behaviour of intents, sessions, commit and retries, on small rows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakesync.config import ADD_CANDIDATE, CREATED, DELETED, DROP_CANDIDATE, SyncConfig
from lakesync.functions import hashing, paths, quantiles
from lakesync.operators import catalog, commit, intents, inventory, replay, retries, sessions
from lakesync.sources import envelopes, generator

ROOT, TENANT, TABLE = "warehouse/sales/", "tenant-1", "warehouse.sales"
BOSTON = "country=us/city=boston"


def candidates(spark, rows, key=BOSTON):
    """rows: (seconds, kind, proof)."""
    full = [(n, round(t * 1e6), TENANT, TABLE, key, f"{ROOT}{key}/", kind, proof, proof or "x") for n, (t, kind, proof) in enumerate(rows)]
    return spark.createDataFrame(full, "seq long, t_us long, tenant_id string, table_fqn string, partition_key string, partition_prefix string, kind string, proof string, object_key string")


def flush(spark, rows):
    return sessions.reconcile(candidates(spark, rows), SyncConfig()).collect()


def test_additions_coalesce_with_three_proofs_at_most(spark):
    (r,) = flush(spark, [(i, ADD_CANDIDATE, f"p{i}") for i in range(5)])
    assert r.kind == "ADD" and r.proof_keys == ["p0", "p1", "p2"] and r.n == 5


def test_addition_dominates_and_repeats_are_kept(spark):
    (r,) = flush(spark, [(0, DROP_CANDIDATE, None), (1, ADD_CANDIDATE, "a"), (2, ADD_CANDIDATE, "a")])
    assert r.kind == "ADD" and r.proof_keys == ["a", "a"] and (r.n, r.first_us, r.last_us) == (3, 0, 2_000_000)
    (r,) = flush(spark, [(0, DROP_CANDIDATE, None)] * 2)
    assert r.kind == "DROP" and r.proof_keys == []
    assert flush(spark, []) == []


def effective(spark, kind="ADD", proofs=("f1",), key=BOSTON):
    return spark.createDataFrame([(TENANT, TABLE, key, f"{ROOT}{key}/", kind, list(proofs), 1)], "tenant_id string, table_fqn string, partition_key string, partition_prefix string, kind string, proof_keys array<string>, n long")


def known(spark, *keys):
    return spark.createDataFrame([(TENANT, TABLE, k, f"{ROOT}{k}/") for k in keys], "tenant_id string, table_fqn string, partition_key string, location string")


def stored(spark, *objects):
    return spark.createDataFrame([(TENANT, o) for o in objects], "tenant_id string, object_key string")


def faults(spark, call, error):
    return spark.createDataFrame([(BOSTON, call, error)], "partition_key string, call string, error string")


FILE = f"{ROOT}{BOSTON}/part-0.parquet"
TABLE_OF_OUTCOMES = [
    # kind, proofs, in catalog, objects, drop enabled, fault, status, reason, heads, lists, in catalog after
    ("ADD", [FILE], False, [FILE], True, None, "APPLIED", None, 1, 0, True),
    ("ADD", ["gone", FILE], False, [FILE], True, None, "APPLIED", None, 2, 0, True),
    ("ADD", ["gone"], False, [FILE], True, None, "APPLIED", None, 1, 1, True),
    ("ADD", ["gone"], False, [], True, None, "RETRY", "not_visible_yet", 1, 1, False),
    ("ADD", ["gone"], False, [f"{ROOT}{BOSTON}/_SUCCESS.parquet"], True, None, "RETRY", "not_visible_yet", 1, 1, False),
    ("ADD", [FILE], True, [FILE], True, None, "NOOP", "already_exists_verified", 0, 1, True),
    ("ADD", [FILE], True, [], True, None, "RETRY", "stale_catalog_entry_cleared", 0, 1, False),
    ("ADD", [FILE], True, [], False, None, "NOOP", "already_exists", 0, 0, True),
    ("ADD", [FILE], False, [FILE], True, ("head", "transient"), "RETRY", "storage_transient", 1, 0, False),
    ("ADD", ["gone"], False, [FILE], True, ("list", "transient"), "RETRY", "storage_transient", 1, 1, False),
    ("ADD", [FILE], True, [FILE], True, ("list", "transient"), "RETRY", "storage_transient", 0, 1, True),
    ("ADD", [FILE], False, [FILE], True, ("create", "transient"), "RETRY", "catalog_transient", 1, 0, False),
    ("ADD", [FILE], False, [FILE], True, ("create", "fatal"), "ERROR", "catalog_fatal", 1, 0, False),
    ("ADD", [FILE], True, [], True, ("drop", "transient"), "RETRY", "catalog_transient", 0, 1, True),
    ("DROP", [], True, [], True, None, "APPLIED", None, 0, 1, False),
    ("DROP", [], True, [FILE], True, None, "NOOP", "still_non_empty", 0, 1, True),
    ("DROP", [], False, [], True, None, "NOOP", "not_found", 0, 0, False),
    ("DROP", [], True, [], False, None, "NOOP", "drop_disabled", 0, 0, True),
    ("DROP", [], True, [], True, ("list", "transient"), "RETRY", "storage_transient", 0, 1, True),
    ("DROP", [], True, [], True, ("drop", "transient"), "RETRY", "catalog_transient", 0, 1, True),
    ("DROP", [], True, [], True, ("drop", "fatal"), "ERROR", "catalog_fatal", 0, 1, True),
    ("MERGE", [], True, [], True, None, "ERROR", "unknown_kind", 0, 0, True),
]


def test_decision_table(spark):
    """All rows of the table as one flush per setting of drop: each has its own key."""
    for enable in (True, False):
        cases = [(n, c) for n, c in enumerate(TABLE_OF_OUTCOMES) if c[4] == enable]
        key = lambda n: f"{BOSTON}{n}"
        own = lambda n, o: o.replace(BOSTON, key(n))
        eff, cat, inv, bad = None, [], [], []
        for n, (kind, proofs, there, objects, _, fault, *_) in cases:
            row = effective(spark, kind, [own(n, p) for p in proofs], key(n))
            eff = row if eff is None else eff.unionByName(row)
            cat += [key(n)] * there
            inv += [own(n, o) for o in objects]
            bad += [(key(n), *fault)] if fault else []
        f = spark.createDataFrame(bad, "partition_key string, call string, error string")
        got = {r.partition_key: r for r in commit.apply(eff, known(spark, *cat), stored(spark, *inv), enable, f).collect()}
        for n, case in cases:
            r = got[key(n)]
            assert (r.status, r.reason, r.heads, r.lists, r.in_catalog_after) == case[6:], case


def test_nested_partitions_count_for_their_parent(spark):
    p = spark.createDataFrame([(TENANT, f"{ROOT}dt=1/"), (TENANT, f"{ROOT}dt=1/hour=2/"), (TENANT, f"{ROOT}dt=10/")], "tenant_id string, partition_prefix string")
    got = {r.partition_prefix: r.non_empty for r in inventory.list_prefixes(p, stored(spark, f"{ROOT}dt=1/hour=2/a.parquet")).collect()}
    assert got == {f"{ROOT}dt=1/": True, f"{ROOT}dt=1/hour=2/": True, f"{ROOT}dt=10/": False}


def test_cap_forces_a_hot_key_out(spark):
    config = SyncConfig(window=1, grace=0.5, cap=5)
    rows = candidates(spark, [(i * 0.5, ADD_CANDIDATE, "p") for i in range(9)])
    out = sessions.effective_intents(sessions.assign_sessions(rows, config), config).collect()
    assert [(r.n, r.flush_us) for r in out] == [(9, 5_000_000)]  # flushed at 5.5 s, grace after 5.0
    for now, still in ((5_400_000, 1), (5_600_000, 0)):
        assert sessions.buffer_snapshot(sessions.assign_sessions(rows, config), now, config).count() == still
    assert SyncConfig(window=10).cap_us == 50_000_000 and SyncConfig(window=10, cap=3).cap_us == 3_000_000


def scalar_sessions(times, window, cap, grace):
    out, first, last = [], None, None
    for t in times:
        opens = first is None or t > min(last + window, first + cap) + grace
        first = t if opens else first
        last = t
        out.append(opens)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=30), st.integers(0, 9), st.integers(0, 20), st.integers(0, 3), st.integers(1, 30))
def test_session_starts_against_a_scalar_model(gaps, window, cap, grace, cut):
    times = np.cumsum(gaps).astype(np.int64) if gaps else np.zeros(0, np.int64)
    want, got, last, first = scalar_sessions(times.tolist(), window, cap, grace), [], None, None
    for a in range(0, len(times), cut):  # as if the key came in several batches
        opens, first = sessions.session_starts(times[a : a + cut], window, cap, grace, last, first)
        last = int(times[a : a + cut][-1])
        got += opens.tolist()
    assert got == want


def test_batches_do_not_change_sessions(spark):
    own = intents.candidate_intents(envelopes.read(spark, "/root/testdata/sf0.001"))
    config = SyncConfig(window=3600, grace=10, cap=7200)
    columns = ["seq", "sid", "place"]
    whole = sorted(map(tuple, sessions.assign_sessions(own, config).select(*columns).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, sessions.assign_sessions(own, config).select(*columns).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("window,want", [
    (900, {("APPLIED", "ADD", None): 536, ("APPLIED", "DROP", None): 247, ("NOOP", "DROP", "not_found"): 428, ("NOOP", "DROP", "still_non_empty"): 1595, ("NOOP", "ADD", "already_exists_verified"): 2331, ("RETRY", "ADD", "not_visible_yet"): 16, ("RETRY", "ADD", "stale_catalog_entry_cleared"): 11}),
    (3600, {("APPLIED", "ADD", None): 420, ("APPLIED", "DROP", None): 103, ("NOOP", "DROP", "not_found"): 191, ("NOOP", "DROP", "still_non_empty"): 501, ("NOOP", "ADD", "already_exists_verified"): 1404, ("RETRY", "ADD", "not_visible_yet"): 46, ("RETRY", "ADD", "stale_catalog_entry_cleared"): 39}),
])
def test_replay_counts_without_a_cap(spark, window, want):
    config = SyncConfig(window=window, grace=10, cap=10**7)
    own = intents.candidate_intents(envelopes.read(spark, "/root/testdata/sf0.01"))
    rows = replay.replay(sessions.assign_sessions(own, config), config)
    got = {(r.status, r.kind, r.reason): r["n"] for r in rows.groupBy("status", "kind", "reason").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_catalog_is_the_partitions_with_live_objects(spark):
    """After all flushes, whatever the sessions were."""
    own = intents.candidate_intents(envelopes.read(spark, "/root/testdata/sf0.001"))
    config = SyncConfig(window=900, grace=10)
    last = replay.replay(sessions.assign_sessions(own, config), config).groupBy(*sessions.KEY).agg(F.max_by("non_empty", "sid").alias("there")).where("there").select(*sessions.KEY)
    live = catalog.converged(inventory.live_inventory(intents.kept(envelopes.read(spark, "/root/testdata/sf0.001")))).select(*sessions.KEY)
    assert last.exceptAll(live).count() == 0 and live.exceptAll(last).count() == 0


def test_verdicts_nulls_and_order_of_reasons(spark):
    cases = [
        ("OTHER", "x", "invalid_op"), (None, FILE, "invalid_op"), (CREATED, f"{ROOT}dt=1/_SUCCESS", "non_data_file"), (CREATED, f"{ROOT}dt=1/a.parquet.crc", "non_data_file"), (CREATED, f"{ROOT}dt=1/a.txt", "non_data_file"),
        (CREATED, None, "non_data_file"), (DELETED, "warehouse/other/dt=1/a.orc", "out_of_root"), (CREATED, f"{ROOT}a.csv", "no_partition"), (CREATED, f"{ROOT}x/dt=1/a.avro", "kept"), (CREATED, f"{ROOT}dt=1/a.PARQUET", "non_data_file"),
        (CREATED, f"{ROOT}dt=1/x_SUCCESS", "non_data_file"), (CREATED, f"{ROOT}dt=2024-13-01/_SUCCESS.parquet", "kept"),
    ]
    df = spark.createDataFrame([(n, o, k, v) for n, (o, k, v) in enumerate(cases)], "seq long, op string, object_key string, want string")
    assert all(r.verdict == r.want for r in intents.with_verdict(df).collect())


def test_paths(spark):
    cases = [(f"{ROOT}dt=1/h=2/f.parquet", f"{ROOT}dt=1/h=2/", "dt=1/h=2"), ("other/dt=1/f", "other/dt=1/", ""), ("noslash", "/", ""), (f"{ROOT}f.parquet", ROOT, ""), (f"{ROOT}a/dt=1/b/f", f"{ROOT}a/dt=1/b/", "dt=1")]
    df = spark.createDataFrame(cases, "k string, d string, p string")
    for r in df.select("*", paths.directory(F.col("k")).alias("gd"), paths.partition_key(F.col("k")).alias("gp")).collect():
        assert (r.gd, r.gp) == (r.d, r.p)


def test_md5_modulo(spark):
    import hashlib

    for n in (2, 3, 7, 10, 1_000_003):
        for r in spark.range(20).select(F.col("id").cast("string").alias("t"), hashing.md5_mod(F.col("id").cast("string"), n).alias("m")).collect():
            assert r.m == int(hashlib.md5(r.t.encode()).hexdigest(), 16) % n


def test_retries_end_in_the_dead_letter_table(spark):
    config = SyncConfig(max_retries=3)
    rows = effective(spark).select(*commit.KEY, "kind", F.lit("RETRY").alias("status"), F.lit("not_visible_yet").alias("reason"))
    spent = retries.schedule(rows.withColumn("visible_at", F.lit(9)), config)
    assert [r.status for r in spent.orderBy("attempt").collect()] == ["RETRY", "RETRY", "DLQ"]
    assert retries.dead_letters(rows, spent).count() == 1
    solved = retries.schedule(rows.withColumn("visible_at", F.lit(2)), config).orderBy("attempt").collect()
    assert [r.status for r in solved] == ["RETRY", "APPLIED"] and all(0 <= r.wait_s <= 2**r.attempt for r in solved)
    wrong = rows.withColumn("status", F.lit("ERROR")).withColumn("reason", F.lit("catalog_fatal"))
    assert retries.dead_letters(wrong, spent.limit(0)).first().attempts == 0


def test_quantiles(spark):
    values = [float(i * 37 % 1000) for i in range(4380)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got, ranked = quantiles.at_ranks(df, "x", {"p95": 0.95, "p99": 0.99, "min": 0.0}), sorted(values)
    assert got == {"p95": ranked[int(0.95 * 4380)], "p99": ranked[int(0.99 * 4380)], "min": ranked[0]}
    assert quantiles.median(df, "x") == (ranked[2189] + ranked[2190]) / 2 and quantiles.median(df.limit(0), "x") is None


def test_quantiles_with_outliers_and_ties(spark):
    rng = np.random.default_rng(5)
    for values in (np.append(rng.uniform(1, 1e9, 30_000), 1e15), np.append(np.full(20_000, 7.0), rng.normal(0, 1, 20_000)), 10.0 ** rng.uniform(-300, 300, 30_000), np.array([-1e308, 1e308] * 9_000)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double").repartition(4)
        ranked, n = np.sort(values), len(values)
        got, places = quantiles.at_ranks(df, "x", {str(q): q for q in (0.0, 0.25, 0.5, 0.95, 0.999)}, buckets=50), (0.0, 0.25, 0.5, 0.95, 0.999)
        assert got == {str(q): ranked[int(q * n)] for q in places}
        assert quantiles.at_places(df, "x", lambda n: {"last": n - 1}, small=10)[1] == {"last": ranked[-1]}


def test_generator(spark):
    space = generator.published_space(spark)
    rows = generator.generate_events(space, 0.001)
    n, objects, partitions = rows.count(), rows.select("object_key").distinct().count(), rows.select(paths.partition_key(F.col("object_key"))).distinct().count()
    assert partitions == 438 and objects == 2190 and 2190 * 1.05 < n < 2190 * 1.15
    assert rows.select("seq").distinct().count() == n
    gone = generator.generate_delete_events(generator.changed_partitions(space, 0.001), 0.5)
    assert gone.select("object_key").distinct().count() == 219 * 5 and {r.op for r in gone.select("op").distinct().collect()} == {DELETED}
    assert generator.SCAN_REQUESTS == generator.scan_requests(space) == 456_616
    assert generator.changed_partitions(space, 0.1).rdd.getNumPartitions() > 1


def test_scripted_epochs(spark):
    from lakesync.plans.registry import catalog_by_epoch

    got = {}
    for r in catalog_by_epoch(generator.scripted_epochs(spark), 4).collect():
        got.setdefault(r.epoch, set()).add(r.partition_key.rsplit("=")[-1])
    assert got == {0: {"boston", "miami", "seattle"}, 1: {"boston", "miami", "seattle"}, 2: {"boston", "miami", "seattle", "bangalore"}, 3: {"boston", "miami", "bangalore"}}


def test_report_keeps_a_result_as_csv(spark, tmp_path):
    from lakesync.operators import metrics

    path = metrics.report(spark.createDataFrame([(0.01, 5)], "f double, n long"), str(tmp_path), "sweep")
    assert [tuple(r) for r in spark.read.option("header", True).csv(path).collect()] == [("0.01", "5")]


def test_hot_keys_are_cut_where_they_were_quiet(spark):
    rows = intents.candidate_intents(envelopes.read(spark, "/root/testdata/sf0.001"))
    for config in (SyncConfig(window=900, grace=10, cap=1800), SyncConfig(window=60, grace=0), SyncConfig(window=0, grace=0)):
        gap = config.window_us + config.grace_us
        columns = [*sessions.KEY, "seq", "sid", "place"]
        whole, cut = (sorted(map(tuple, sessions.assign_sessions(rows, config, hot).select(*columns).collect())) for hot in (None, 2))
        assert len(whole) > 100 and cut == whole
    assert sessions.quiet_runs(rows, gap, 2).agg({"run": "max"}).first()[0] > 1


@pytest.mark.parametrize("window, grace, cap", [(60, 5, 200), (10, 0, 7), (30, 1, 1000), (0.001, 0, 0.5)])
def test_a_key_that_is_never_quiet_is_shared(spark, window, grace, cap):
    config = SyncConfig(window=window, grace=grace, cap=cap)
    draw = np.random.default_rng(5)
    step = np.minimum(draw.exponential(window / 3, 1500), window)
    step[draw.random(1500) < 0.3] = 0
    step[700] = 3 * (window + grace)  # quiet once
    rows = candidates(spark, [(t, ADD_CANDIDATE if draw.random() < 0.6 else DROP_CANDIDATE, "p") for t in np.cumsum(step).tolist()])
    both = rows.unionByName(rows.withColumn("partition_key", F.lit("b=2")).where("seq < 40"))
    got, want = (sessions.assign_sessions(both, config, hot_rows=hot) for hot in (100, None))
    columns = ["partition_key", "seq", "sid", "place"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    starts = want.where(F.col("partition_key") == BOSTON).groupBy("sid").agg(F.min("t_us"), F.count("*").alias("n"))
    cuts = sessions.cuts(both, config, 100).where("cut is not null")
    assert {r.cut for r in cuts.collect()} <= {r[1] for r in starts.collect()} and cuts.count() > min(starts.count(), 10) / 2
    assert {r.partition_key for r in cuts.collect()} == {BOSTON}


def test_next_starts_are_the_least_times_beyond_reach(spark):
    draw = np.random.default_rng(6)
    times = sorted({int(t) for t in draw.integers(0, 5_000, 300)} | {0, 100, 200, 10_000})
    rows = spark.createDataFrame([(TENANT, TABLE, BOSTON, 1, t) for t in times], "tenant_id string, table_fqn string, partition_key string, run long, t_us long")
    got = {r.t_us: r.next_us for r in sessions.next_starts(rows, 100).collect()}
    assert got == {t: min(u for u in times if u > t + 100) for t in times if times[-1] > t + 100}
