"""Retries as state, and snapshots read from state."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakesync.config import SyncConfig
from lakesync.functions.hashing import md5_unit
from lakesync.operators import sessions
from lakesync.plans import registry, streamed
from lakesync.streaming.retrying import KEY, RetryQueue

SF = "/root/testdata/sf0.001"


class Held:
    """A list state and a handle of timers, in memory."""

    def __init__(self):
        self.rows, self.timers = [], []

    exists = lambda self: bool(self.rows)
    get = lambda self: iter(self.rows)
    listTimers = lambda self: iter(self.timers)
    getListState = lambda self, *_: self

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    getCurrentProcessingTimeInMs = getCurrentWatermarkInMs = lambda self: self.ms


@pytest.fixture
def queue():
    own = RetryQueue(2, event_time=False)
    own.init(Held())
    return own


def feed(queue, ms, *rows):
    """rows: (status, attempt, failed_s, wait_s)."""
    names = ["partition_prefix", "kind", "proof_keys", "status", "reason", "attempt", "failed_s", "wait_s"]
    frame = pd.DataFrame([("p/", "ADD", ["a"], s, "r", a, f, w) for s, a, f, w in rows], columns=names)
    return [r for out in queue.handleInputRows(("t", "f", "k"), iter([frame]), Clock(ms)) for r in out.to_dict("records")]


def fire(queue, ms):
    return [r for out in queue.handleExpiredTimer(("t", "f", "k"), Clock(ms), None) for r in out.to_dict("records")]


def test_one_timer_for_the_earliest_attempt(queue):
    assert feed(queue, 1000, ("RETRY", 1, 0.0, 5.0), ("RETRY", 1, 1.0, 2.0)) == [] and queue.handle.timers == [3001]
    assert [r["due_s"] for r in fire(queue, 3001)] == [3.0] and queue.handle.timers == [6001]
    assert [(r["due_s"], r["attempt"], r["dead"]) for r in fire(queue, 6001)] == [(5.0, 1, False)]
    assert queue.handle.timers == [] and not queue.waiting.exists() and fire(queue, 9999) == []


def test_what_fails_too_often_or_in_error_is_dead(queue):
    got = feed(queue, 0, ("RETRY", 3, 0.0, 1.0), ("ERROR", 0, 0.0, 0.0))
    assert [r["dead"] for r in got] == [True, True] and {r["attempt"] for r in got} == {0, 3} and queue.handle.timers == []


def test_a_success_or_a_no_op_ends_the_wait(queue):
    for status in ("APPLIED", "NOOP"):
        feed(queue, 0, ("RETRY", 1, 0.0, 4.0))
        assert feed(queue, 10, (status, 0, 1.0, 0.0)) == [] and queue.handle.timers == [] and fire(queue, 10_000) == []


def test_backoff_and_restarts_as_in_the_batch(spark):
    """Five keys through streams that are stopped between all attempts; waits are those of the hash."""
    config = SyncConfig(max_retries=3)
    rows = spark.createDataFrame([("t", "f", f"k={i}", "ADD", "RETRY", "not_visible_yet", i) for i in range(1, 6)] + [("t", "f", "k=9", "ADD", "ERROR", "catalog_fatal", 1)], "tenant_id string, table_fqn string, partition_key string, kind string, status string, reason string, visible_at int")
    fired = streamed.streamed_retries(spark, rows, config).collect()
    due = {(r.partition_key, r.attempt): (r.wait_s, r.due_s) for r in fired if not r.dead}
    assert set(due) == {(f"k={i}", a) for i in range(1, 6) for a in range(1, min(i, 3) + 1)}
    draws = {(r.k, r.a): r.u for r in spark.createDataFrame(list(due), "k string, a int").select("k", "a", md5_unit(F.concat_ws("#", "k", F.col("a").cast("string"))).alias("u")).collect()}
    for (k, a), (wait, at) in due.items():
        assert wait == draws[k, a] * min(2**a, 60) and at == pytest.approx(sum(due[k, b][0] for b in range(1, a + 1)))
    assert {(r.partition_key, r.attempt) for r in fired if r.dead} == {("k=4", 4), ("k=5", 4), ("k=9", 1)}


def test_snapshots_from_state_at_any_time(spark):
    """State holds the session that is open, or was last, of each key: snapshots at the end and later."""
    config = SyncConfig(window=3600, grace=10, cap=7200)
    last = registry._last_us(spark, SF)
    assigned = sessions.assign_sessions(registry._intents(spark, SF), config)
    for now in (last, last + 1_800_000_000):
        got = {tuple(r) for r in streamed.state_snapshot(spark, SF, config, now).collect()}
        assert got == {tuple(r) for r in sessions.buffer_snapshot(assigned, now, config).collect()}
    assert len(KEY) == 3
