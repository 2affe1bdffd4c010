"""Several writers on one log of commits, and latencies as state."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakesync.config import SyncConfig
from lakesync.operators import intents, sessions
from lakesync.plans import registry
from lakesync.sources import generator
from lakesync.streaming import commitlog, worker
from lakesync.streaming.commitlog import KEY, CommitLog
from lakesync.streaming.latency import FirstSeen

FLUSH = "tenant_id string, table_fqn string, partition_key string, partition_prefix string, kind string"


def flush(spark, kind, *keys, tenant="t"):
    return spark.createDataFrame([(tenant, "f", k, f"{k}/", kind) for k in keys], FLUSH)


def decide(rows, known):
    """ADD and DROP without storage."""
    there = known.select(*KEY).withColumn("in_catalog", F.lit(True))
    same = rows.tenant_id.eqNullSafe(there.tenant_id) & (rows.table_fqn == there.table_fqn) & (rows.partition_key == there.partition_key)
    return rows.join(there, same, "left").select(*[rows[c] for c in rows.columns], F.coalesce("in_catalog", F.lit(False)).alias("in_catalog")).withColumn("in_catalog_after", F.col("kind") == "ADD")


def keys(log, version=None):
    return {r.partition_key for r in log.snapshot(version).collect()}


class Raced(CommitLog):
    """Puts what another writer has first, before its own next entry."""

    rival = None

    def put(self, version, entry):
        rival, self.rival = self.rival, None
        if rival:
            rival()
        return super().put(version, entry)


def test_a_place_is_put_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    entry = {"commit": "x", "buckets": [], "writers": {}}
    assert log.last() == -1 and log.snapshot().isEmpty() and log.put(0, entry) and not log.put(0, entry | {"commit": "y"})
    (e,) = log.entries(-1, 0)
    assert e.commit == "x" and log.versions() == [0] and not list((tmp_path / "drafts").glob("[!.]*"))


def test_only_keys_that_clash_are_decided_again(spark, tmp_path):
    first, late, met = CommitLog(spark, str(tmp_path)), Raced(spark, str(tmp_path)), []

    def noted(rows, known):
        met.append({r.partition_key for r in rows.collect()})
        return decide(rows, known)

    first.commit(flush(spark, "ADD", "p=1", "p=2"), decide, "a", 0)
    late.rival = lambda: first.commit(flush(spark, "DROP", "p=1", "p=9"), decide, "a", 1)
    version, results = late.commit(flush(spark, "ADD", "p=1", "p=2", "p=3"), noted, "b", 0)
    assert len(list((tmp_path / "changes").iterdir())) == 3  # what lost its place is gone
    assert version == 2 and met == [{"p=1", "p=2", "p=3"}, {"p=1"}]
    # p=1 was there when it was first decided, and gone when it was put
    assert {r.partition_key: r.in_catalog for r in results.collect()} == {"p=1": False, "p=2": True, "p=3": False}
    assert [keys(first, v) for v in (0, 1, 2)] == [{"p=1", "p=2"}, {"p=2"}, {"p=1", "p=2", "p=3"}]


def test_keys_that_do_not_clash_stand_as_decided(spark, tmp_path):
    log, late, calls = CommitLog(spark, str(tmp_path)), Raced(spark, str(tmp_path)), []
    late.rival = lambda: log.commit(flush(spark, "ADD", "p=1"), decide, "a", 0)
    late.commit(flush(spark, "ADD", "p=2"), lambda rows, known: calls.append(1) or decide(rows, known), "b", 0)
    assert calls == [1] and keys(log) == {"p=1", "p=2"}


def test_a_batch_again_changes_nothing_and_gives_its_results(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    rows = flush(spark, "ADD", "p=1")
    (v, a), _ = log.commit(rows, decide, "a", 0), log.commit(flush(spark, "DROP", "p=1"), decide, "b", 0)
    w, b = log.commit(rows, decide, "a", 0)
    assert v == w == 0 and a.collect() == b.collect() and keys(log) == set() and log.versions() == [0, 1]
    log.commit(rows, decide, "a", 1)
    with pytest.raises(ValueError):
        log.commit(rows, decide, "a", 0)


def test_null_and_empty_tenants_are_two_and_empty_flushes_are_noted(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    log.commit(flush(spark, "ADD", "p=1", tenant=None), decide, "a", 0)
    log.commit(flush(spark, "ADD", "p=1", tenant=""), decide, "a", 1)
    log.commit(flush(spark, "DROP", "p=1", tenant=None), decide, "b", 0)
    assert [r.tenant_id for r in log.snapshot().collect()] == [""]
    assert log.commit(flush(spark, "ADD", "p=1").limit(0), decide, "a", 2)[0] == 3 and log._writers(3) == {"a": [2, 3], "b": [0, 2]}


def test_a_flush_reads_its_buckets_of_whole_versions_and_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commitlog, "WHOLE_EVERY", 2)
    log = CommitLog(spark, str(tmp_path), buckets=16)
    many = [f"p={i}" for i in range(400)]
    for i in range(4):
        log.commit(flush(spark, "ADD", *many[i::4]), decide, "a", i)
    assert log._wholes() == [0, 2] and keys(log) == set(many) and keys(log, 1) == set(many[0::4] + many[1::4])
    own = log.touched(flush(spark, "ADD", "p=7"))
    part = log.snapshot(buckets=own)
    files = {f.split("bucket=")[1].split("/")[0] for f in part.inputFiles()}
    assert files == {str(own[0])} and 0 < part.count() < 100
    assert {r.partition_key for r in part.collect()} == {r.partition_key for r in log.snapshot().where(log.bucket() == own[0]).collect()}


def test_two_workers_retry_on_one_log(spark, tmp_path):
    """Each keeps a queue of its own; an addition that isn't seen yet is retried by the one that has it, after the other has dropped the partition."""
    config, log = SyncConfig(), CommitLog(spark, str(tmp_path / "log"))
    a, b = (worker.Tables(spark, str(tmp_path / n)) for n in "ab")
    added = generator.scripted_epochs(spark).where((F.col("epoch") == 0) & F.col("object_key").contains("boston"))
    flushed = sessions.reconcile(intents.candidate_intents(added), config)
    worker.commit_batch(a, flushed, config, 0, 0.0, log=log, writer="a")  # nothing shows yet
    assert log.snapshot().isEmpty() and a.latest("queue").count() == 1
    worker.note_objects(a, added, 1)
    worker.note_objects(b, added, 0)
    worker.commit_batch(b, flushed, config, 0, 50.0, log=log, writer="b")
    worker.commit_batch(a, flushed.limit(0), config, 1, 100.0, log=log, writer="a")
    assert log.snapshot().count() == 1 and a.latest("queue").isEmpty()
    audit = a.latest("audit").orderBy("at").collect()
    assert [(r.status, r.reason, r.at, r.at_s) for r in audit] == [("RETRY", "not_visible_yet", 0, 0.0), ("NOOP", "already_exists_verified", 1, 100.0)]


def test_no_events(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    assert registry.QUERIES["two_writers_catalog"](spark, str(tmp_path)).count() == 0
    assert {(r.n, r.median) for r in registry.QUERIES["streamed_latency_percentiles"](spark, str(tmp_path)).collect()} == {(0, None)}


# --- latencies --------------------------------------------------------------------------------------------------------


class Value(dict):
    """A value state or a map state, in memory."""

    exists = lambda self: "v" in self
    get = lambda self, *a: self["v"]
    update = lambda self, v: self.__setitem__("v", v)
    getValue = lambda self, k: self[k]
    containsKey = lambda self, k: k in self
    updateValue = lambda self, k, v: self.__setitem__(k, v)


class Handle:
    getValueState = getMapState = lambda self, *a: Value()


def fed(own, *chunks):
    """chunks of rows (tenant, t_us, place, first_us)."""
    frames = [pd.DataFrame([(t, "f", "ADD", at, p, f) for t, at, p, f in rows], columns=["tenant_id", "table_fqn", "kind", "t_us", "place", "first_us"]).astype({"place": "Float64", "first_us": "Float64"}) for rows in chunks]
    return [(r["tenant_id"], r["sid"], r["latency_s"]) for out in own.handleInputRows(("p=1",), iter(frames), None) for r in out.to_dict("records")]


def test_first_seen_is_of_any_tenant_and_never_reset():
    own = FirstSeen()
    own.init(Handle())
    assert fed(own, [("a", 5_000_000, None, None)], [("b", 2_000_000, None, None)]) == []
    assert fed(own, [("a", 9_000_000, 1, 5_000_000), ("a", 8_000_000, None, None)]) == [("a", 1, 7.0)]
    assert fed(own, [("a", 9_000_000, 1, 5_000_000), ("b", 9_000_000, 1, 2_000_000), ("a", 12_000_000, 2, 8_000_000)]) == [("a", 2, 10.0), ("b", 1, 7.0)]


def test_an_outcome_of_a_partition_never_seen_gives_none():
    own = FirstSeen()
    own.init(Handle())
    assert fed(own, [("a", 9, 1, 5)]) == [] and not own.seen.exists()


@pytest.mark.parametrize("ttl_s", [None, 3600])
def test_latencies_of_a_running_worker(spark, tmp_path, ttl_s):
    """Boston's objects arrive, are committed 100 s later, and the batch is committed again: one latency for each partition and tenant."""
    config, tables = SyncConfig(), worker.Tables(spark, str(tmp_path / "job"))
    rows = generator.scripted_epochs(spark).where(F.col("epoch") == 0)
    rows.write.parquet(str(tmp_path / "in"))
    first = {r.partition_key: r.t for r in intents.candidate_intents(rows).groupBy("partition_key").agg(F.min("t_us").alias("t")).collect()}
    now = max(first.values()) / 1e6 + 100
    worker.note_objects(tables, rows, 0)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        worker.commit_batch(tables, sessions.reconcile(intents.candidate_intents(rows), config), config, 0, now)
        run = worker.latency_writer(spark, stream, str(tmp_path / "job"), ttl_s).trigger(**({"availableNow": True} if ttl_s is None else {"once": True})).start()
        assert run.awaitTermination(60)
        got = spark.read.parquet(str(tmp_path / "job" / "latency")).collect()
        assert {r.partition_key: r.latency_s for r in got} == pytest.approx({k: now - t / 1e6 for k, t in first.items()}) and len(got) == len(first) == 3
