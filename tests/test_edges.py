"""Empty tables, null and empty keys, kinds that nobody knows."""

import os

import pytest

from lakesync.config import SyncConfig
from lakesync.operators import sessions
from lakesync.plans import registry
from lakesync.streaming.buffer import SessionBuffer

SF = "/root/testdata/sf0.001"
CONFIG = SyncConfig(window=3600, grace=10)
INTENT = "seq long, t_us long, tenant_id string, table_fqn string, partition_key string, partition_prefix string, kind string, proof string, object_key string"


def intents(spark, rows):
    """rows: (tenant, key, seconds, kind)."""
    each = [(i, int(t * 1e6), tenant, "t", key, f"{key}/", kind, f"{key}/{i}" if kind == "ADD_CANDIDATE" else None, f"{key}/{i}") for i, (tenant, key, t, kind) in enumerate(rows)]
    return spark.createDataFrame(each, INTENT)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(os.path.join(folder, "events.parquet"))
    return folder


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in ("coalescing_ratio", "coalescing_ratio_jitter", "convergence_latency", "drop_sweep", "streamed_sessions")])
def test_no_events(spark, empty_dir, name):
    registry.QUERIES[name](spark, empty_dir).collect()


def test_null_and_empty_keys_are_two_keys(spark):
    rows = intents(spark, [(None, "k=1", t, "ADD_CANDIDATE") for t in range(5)] + [("", "k=1", 10 + t, "ADD_CANDIDATE") for t in range(3)] + [("", None, 20 + t, "ADD_CANDIDATE") for t in range(2)])
    want = [(None, "k=1", 5, 3), ("", None, 2, 2), ("", "k=1", 3, 3)]
    for out in (sessions.effective_intents(sessions.assign_sessions(rows, CONFIG), CONFIG), sessions.reconcile(rows, CONFIG)):
        got = {(r.tenant_id, r.partition_key, r.n, len([p for p in r.proof_keys])) for r in out.collect()}
        assert got == set(want)
    assigned = sessions.assign_sessions(rows, CONFIG).collect()
    assert sorted(r.place for r in assigned) == [1, 1, 1, 2, 2, 2, 3, 3, 4, 5] and {r.sid for r in assigned} == {1}


def test_unknown_kinds_give_no_intent(spark):
    rows = intents(spark, [("a", "k=1", 1, "MERGE"), ("a", "k=2", 1, None), ("a", "k=3", 1, None), ("a", "k=3", 2, "DROP_CANDIDATE"), ("a", "k=4", 1, "MERGE"), ("a", "k=4", 2, "ADD_CANDIDATE"), ("a", "k=4", 3, "DROP_CANDIDATE")])
    for out in (sessions.effective_intents(sessions.assign_sessions(rows, CONFIG), CONFIG), sessions.reconcile(rows, CONFIG)):
        assert {(r.partition_key, r.kind, r.n) for r in out.collect()} == {("k=3", "DROP", 2), ("k=4", "ADD", 3)}


def test_unknown_kinds_in_the_buffer():
    buffer = SessionBuffer(CONFIG)
    state = {"sid": 1, "prefix": "p/", "n": 2, "n_add": 0, "n_drop": 0, "proofs": [], "last_kind": "MERGE", "first_us": 0, "last_us": 5}
    assert buffer._rows(("a", "t", "k=1"), state) == []
    assert buffer._rows(("a", "t", "k=1"), state | {"n_drop": 1})[0]["kind"] == "DROP"
    assert buffer._rows(("a", "t", "k=1"), state | {"n_drop": 1, "n_add": 1})[0]["kind"] == "ADD"
