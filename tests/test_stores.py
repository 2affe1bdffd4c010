"""A store of files, and a log of notifications with offsets."""

import json

import pytest
from pyspark.sql import functions as F

from lakesync.config import SyncConfig
from lakesync.operators import commit, intents, inventory, sessions
from lakesync.sources import envelopes, eventlog
from lakesync.sources.objectstore import FileStore, FoldedStore, remove_object, write_objects

SF = "/root/testdata/sf0.001"
ROOT = "warehouse/sales/"


def objects(spark, *keys, tenant="a"):
    return spark.createDataFrame([(tenant, k) for k in keys], "tenant_id string, object_key string")


def prefixes(spark, *names, tenant="a"):
    return spark.createDataFrame([(tenant, p) for p in names], "tenant_id string, partition_prefix string")


def effective(spark, *rows):
    """rows: (partition_key, kind, proofs)."""
    full = [("a", "t", key, f"{ROOT}{key}/", kind, proofs, 1) for key, kind, proofs in rows]
    return spark.createDataFrame(full, "tenant_id string, table_fqn string, partition_key string, partition_prefix string, kind string, proof_keys array<string>, n long")


def test_files_answer_as_the_fold_does(spark, tmp_path):
    keys = [f"{ROOT}dt=1/region=2/part-0.parquet", f"{ROOT}dt=1/region=3/_SUCCESS", f"{ROOT}dt=1/.crc-x", f"{ROOT}dt=2/_temporary.orc", f"{ROOT}dt=3/hour=1/_SUCCESS.parquet", f"{ROOT}dt=3/hour=2/x.parquet.crc", "top.csv"]
    live = objects(spark, *keys)
    write_objects(live, str(tmp_path))
    write_objects(live, str(tmp_path))  # again: no error, no change
    files, fold = FileStore(spark, str(tmp_path)), FoldedStore(live)
    asked = prefixes(spark, ROOT, "", *(f"{ROOT}{p}" for p in ("dt=1/", "dt=1/region=2/", "dt=1/region=3/", "dt=2/", "dt=3/", "dt=3/hour=1/", "dt=4/", "dt=1/region=2/part-0.parquet/")))
    want = {(r.partition_prefix, r.non_empty) for r in fold.listed(asked.where("partition_prefix <> ''")).collect()}
    got = {(r.partition_prefix, r.non_empty) for r in files.listed(asked).collect()}
    assert got - {("", True)} == want and (f"{ROOT}dt=3/", True) in got and (f"{ROOT}dt=2/", False) in got
    rows = effective(spark, ("dt=1", "ADD", [keys[0], "x"]), ("dt=2", "ADD", ["x", "y", keys[1]]), ("dt=3", "ADD", ["x", "x"]), ("dt=4", "ADD", []), ("dt=5", "ADD", [f"{ROOT}dt=1", keys[0]]))
    assert {tuple(r) for r in files.heads(rows, commit.KEY).collect()} == {tuple(r) for r in fold.heads(rows, commit.KEY).collect()}
    listed, folders = files.objects(live.select("tenant_id").distinct())
    assert {tuple(r) for r in listed.collect()} == {("a", k) for k in keys} and folders == 10


def test_a_listing_stops_at_the_first_object(spark, tmp_path):
    write_objects(objects(spark, f"{ROOT}dt=1/p.orc", *(f"{ROOT}dt=1/deep={i}/_SUCCESS" for i in range(20))), str(tmp_path))
    files = FileStore(spark, str(tmp_path))
    got = {r.partition_prefix: (r.non_empty, r.folders) for r in files.listings(prefixes(spark, f"{ROOT}dt=1/", f"{ROOT}dt=1/deep=1/", f"{ROOT}dt=9/")).collect()}
    assert got == {f"{ROOT}dt=1/": (True, 1), f"{ROOT}dt=1/deep=1/": (False, 1), f"{ROOT}dt=9/": (False, 1)}


def test_decisions_follow_the_files(spark, tmp_path):
    """Nested partitions, a stale entry, and a file that goes between two flushes."""
    proof = f"{ROOT}dt=1/hour=2/p.parquet"
    write_objects(objects(spark, proof), str(tmp_path))
    known = spark.createDataFrame([("a", "t", "dt=7", f"{ROOT}dt=7/")], "tenant_id string, table_fqn string, partition_key string, location string")
    rows = effective(spark, ("dt=1/hour=2", "ADD", [proof]), ("dt=1", "ADD", ["gone"]), ("dt=7", "ADD", ["gone"]), ("dt=8", "DROP", []))
    outcome = lambda: {r.partition_key: (r.status, r.reason, r.heads, r.lists) for r in commit.apply(rows, known, FileStore(spark, str(tmp_path))).collect()}
    before = outcome()
    assert before == {"dt=1/hour=2": ("APPLIED", None, 1, 0), "dt=1": ("APPLIED", None, 1, 1), "dt=7": ("RETRY", "stale_catalog_entry_cleared", 0, 1), "dt=8": ("NOOP", "not_found", 0, 0)}
    remove_object(str(tmp_path), "a", proof)
    after = outcome()
    assert after["dt=1/hour=2"] == ("RETRY", "not_visible_yet", 1, 1) and after["dt=1"] == ("RETRY", "not_visible_yet", 1, 1)


def test_files_of_events_give_the_same_results(spark, tmp_path):
    rows = envelopes.read(spark, SF)
    live = inventory.live_inventory(intents.kept(rows))
    write_objects(live, str(tmp_path))
    flushed = sessions.reconcile(intents.candidate_intents(rows), SyncConfig())
    none = spark.createDataFrame([], "tenant_id string, table_fqn string, partition_key string, location string")
    columns = [*commit.KEY, "status", "reason", "heads", "lists"]
    a, b = ({tuple(r) for r in commit.apply(flushed, none, s).select(*columns).collect()} for s in (live, FileStore(spark, str(tmp_path))))
    assert a == b and len(a) > 20


def messages(spark, n, first=0):
    return spark.createDataFrame([(i, f"k{i % 7}", str(i)) for i in range(first, first + n)], "seq long, key string, value string")


def test_offsets_and_appends(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert eventlog.ends(path) == {} and eventlog.read(spark, path).count() == 0
    eventlog.append(messages(spark, 100), path, 3, segment=10, span=7)
    eventlog.append(messages(spark, 60, 100), path, 3, segment=10, span=7)
    eventlog.append(messages(spark, 0, 100), path, 3, segment=10)
    got, of_key = {}, {}
    for r in eventlog.read(spark, path).orderBy("seq").collect():
        got.setdefault(r.partition, []).append(r.offset)
        of_key.setdefault(r.key, set()).add(r.partition)
    assert all(v == list(range(1, len(v) + 1)) for v in got.values()) and sum(map(len, got.values())) == 160
    assert all(len(p) == 1 for p in of_key.values()) and eventlog.ends(path) == {p: len(got.get(p, [])) for p in range(3)}
    with pytest.raises(ValueError):
        eventlog.append(messages(spark, 1), path, 2)


def test_batches_restarts_and_lag(spark, tmp_path):
    path = f"{tmp_path}/log"
    eventlog.append(messages(spark, 140), path, 2, segment=8, span=50)
    ends, seen = eventlog.ends(path), 0
    for step in range(1, 4):  # each a run of its own under one checkpoint
        rows, at = eventlog.poll(spark, path, f"{tmp_path}/a", "a", 1, most=15)
        assert at == {p: min(15 * step, n) for p, n in ends.items()}
        assert rows.count() == rows.select("partition", "offset").distinct().count() == sum(at.values())
        seen = sum(at.values())
    lag = {r.partition: r.lag for r in eventlog.lag(spark, path, at).collect()}
    assert sum(lag.values()) == 140 - seen and max(lag.values()) > 0


def test_starts(spark, tmp_path):
    path = f"{tmp_path}/log"
    eventlog.append(messages(spark, 70), path, 2, segment=9)
    ends = eventlog.ends(path)
    none, at = eventlog.poll(spark, path, f"{tmp_path}/end", "end", 1, start="latest")
    assert none.count() == 0
    eventlog.append(messages(spark, 30, 70), path, 2, segment=9)
    rows, at = eventlog.poll(spark, path, f"{tmp_path}/end", "end", 1, start="latest")
    assert {r.seq for r in rows.collect()} == set(range(70, 100)) and at == eventlog.ends(path)
    rows, _ = eventlog.poll(spark, path, f"{tmp_path}/from", "from", 1, start=json.dumps({"0": 5, "1": 11}), most=4)
    assert {(r.partition, r.offset) for r in rows.collect()} == {(p, s + i) for p, s in ((0, 5), (1, 11)) for i in range(1, 5) if s + i <= ends[p] + 30}
    assert rows.where(F.col("offset") <= 5).count() == 0
