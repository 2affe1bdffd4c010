"""Buffered sessions of a key: intents within a quiet window, under a cap, and what they come to.

An intent joins its key's open buffer if it arrives no later than min(last + window, first + cap) + grace, where last and
first are of the buffer; otherwise the buffer has been flushed and a new one opens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesync.config import ADD_CANDIDATE, DROP_CANDIDATE, SyncConfig
from lakesync.scratch import store

KEY = ["tenant_id", "table_fqn", "partition_key"]
#: A key with more intents than this is shared by several tasks.
HOT_ROWS = 5_000_000
#: Bins in the reach of a session, where times of a busy key are looked up.
FINE_BINS = 64


def quiet_sessions(intents: DataFrame, config: SyncConfig) -> DataFrame:
    """Sessions without a cap, by Spark's session window: first_us, last_us, n, n_add, n_drop of each."""
    gap = f"{config.window_us + config.grace_us} microseconds"
    rows = intents.withColumn("t", F.timestamp_micros("t_us"))
    out = rows.groupBy(*KEY, F.session_window("t", gap)).agg(
        F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.count("*").alias("n"),
        F.count_if(F.col("kind") == ADD_CANDIDATE).alias("n_add"), F.count_if(F.col("kind") == DROP_CANDIDATE).alias("n_drop"),
    )
    return out.drop("session_window")


def session_starts(t: np.ndarray, window: int, cap: int, grace: int, last: int | None = None, first: int | None = None) -> tuple[np.ndarray, int]:
    """Which of the sorted times of one key open a session, given the open one's last and first; and the first of the last session."""
    opens = np.zeros(len(t), bool)
    quiet = np.flatnonzero(np.diff(t) > window + grace) + 1
    joins = last is not None and t[0] <= min(last + window, first + cap) + grace
    edges = [0, *quiet.tolist(), len(t)]
    for a, b in zip(edges, edges[1:]):
        at = a
        if a == 0 and joins:
            at = int(np.searchsorted(t[:b], first + cap + grace, side="right"))
        while at < b:  # inside a quiet run only the cap ends a session
            opens[at], first = True, int(t[at])
            at += max(1, int(np.searchsorted(t[at:b], first + cap + grace, side="right")))
    return opens, first


def quiet_runs(intents: DataFrame, gap_us: int, hot_rows: int) -> DataFrame:
    """key, bin, n, low, quiet, run (1, 2, ...) of the keys with more than hot_rows intents: a run begins after a time of quiet that ends any session.

    Bins are as long as that quiet, so no run is quiet within one. Their counts and times combine on the map side; only they are put in order.
    """
    bins = intents.withColumn("bin", _bin(F.col("t_us"), gap_us)).groupBy(*KEY, "bin").agg(F.count("*").alias("n"), F.min("t_us").alias("low"), F.max("t_us").alias("high"))
    key = Window.partitionBy(*KEY)
    hot = bins.withColumn("rows", F.sum("n").over(key)).where(F.col("rows") > hot_rows)
    quiet = F.coalesce(F.col("low") - F.lag("high").over(key.orderBy("bin")) > gap_us, F.lit(True))
    return hot.withColumn("quiet", quiet).select(*KEY, "bin", "n", "low", "quiet", F.sum(F.col("quiet").cast("long")).over(key.orderBy("bin")).alias("run"))


def _bin(time: Column, width_us: int) -> Column:
    return F.floor(time / max(width_us, 1))


def next_starts(times: DataFrame, reach_us: int) -> DataFrame:
    """times (key, run, t_us, each once) with next_us: the first time of the run more than reach_us after; the last ones have none and are left out.

    Times and the moments that ask for them meet in short bins; what a bin does not answer is answered by the least time of the bins after it.
    """
    names, width = [*KEY, "run"], reach_us // FINE_BINS
    asked = times.select(*names, (F.col("t_us") + reach_us).alias("at"), F.lit(None).cast("long").alias("time"))
    points = times.select(*names, F.col("t_us").alias("at"), F.col("t_us").alias("time")).unionByName(asked).withColumn("bin", _bin(F.col("at"), width))
    before = (Window.unboundedPreceding, -1)
    lows = points.groupBy(*names, "bin").agg(F.min("time").alias("low"))
    later = lows.select(*names, "bin", F.min("low").over(Window.partitionBy(*names).orderBy(F.desc("bin")).rowsBetween(*before)).alias("later"))
    # from the latest on, those that ask before the times that they equal
    inside = F.min("time").over(Window.partitionBy(*names, "bin").orderBy(F.desc("at"), F.col("time").isNotNull()).rowsBetween(*before))
    answers = points.withColumn("inside", inside).where(F.col("time").isNull()).join(later, [*names, "bin"])
    return answers.select(*names, (F.col("at") - reach_us).alias("t_us"), F.coalesce("inside", "later").alias("next_us")).where(F.col("next_us").isNotNull())


def busy_starts(intents: DataFrame, runs: DataFrame, config: SyncConfig) -> DataFrame:
    """key, run, t_us of all sessions of runs (key, bin, run): within a run only the cap ends a session, so where the next one starts depends on the start alone.

    That function of the start is composed with itself, round by round, and what has been reached is doubled, so the
    rounds are the logarithm of a run's sessions, and every round is a join by key and time, shared by all tasks.
    """
    names = [*KEY, "run"]
    times = intents.withColumn("bin", _bin(F.col("t_us"), config.window_us + config.grace_us)).join(runs.select(*names, "bin"), [*KEY, "bin"]).select(*names, "t_us").distinct()
    times = store(times, "times")
    jump = store(next_starts(times, config.cap_us + config.grace_us), "jump")
    reached = store(times.groupBy(*names).agg(F.min("t_us").alias("t_us")), "starts")
    while True:
        more = store(reached.join(jump, [*names, "t_us"]).select(*names, F.col("next_us").alias("t_us")), "starts")
        if more.isEmpty():
            return reached
        reached = reached.unionByName(more)
        onward = jump.select(*names, F.col("t_us").alias("next_us"), F.col("next_us").alias("after_us"))
        jump = store(jump.join(onward, [*names, "next_us"]).select(*names, "t_us", F.col("after_us").alias("next_us")), "jump")


def cuts(intents: DataFrame, config: SyncConfig, hot_rows: int) -> DataFrame:
    """key, bin, run, cut of the keys with more than hot_rows intents: rows of a bin are in run, those from cut on (if there is one) in the run after.

    Runs are cut where the key was quiet, and those that still have more than hot_rows intents at the first session that starts in each bin.
    """
    gap = config.window_us + config.grace_us
    runs = store(quiet_runs(intents, gap, hot_rows), "runs")
    busy = runs.groupBy(*KEY, "run").agg(F.sum("n").alias("rows")).where(F.col("rows") > hot_rows).drop("rows")
    cut = F.when(F.col("quiet"), F.col("low"))
    if not busy.isEmpty():
        starts = busy_starts(intents, runs.join(busy, [*KEY, "run"], "left_semi"), config)
        first = starts.groupBy(*KEY, _bin(F.col("t_us"), gap).alias("bin")).agg(F.min("t_us").alias("start"))
        runs, cut = runs.join(first, [*KEY, "bin"], "left"), F.least(cut, F.col("start"))
    so_far = Window.partitionBy(*KEY).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("cut", cut).select(*KEY, "bin", F.count("cut").over(so_far).alias("run"), "cut")


def _number(rows: DataFrame, names: list[str], config: SyncConfig) -> DataFrame:
    """rows with sid and place, numbered within each group of equal names."""
    window, cap, grace = config.window_us, config.cap_us, config.grace_us

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, first, sid, adds = None, None, None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            same = np.ones(batch.num_rows, bool)
            for name in names:
                after, before = batch.column(name)[1:], batch.column(name)[:-1]
                alike = pc.or_(pc.fill_null(pc.equal(after, before), False), pc.and_(pc.is_null(after), pc.is_null(before)))
                same[1:] &= alike.to_numpy(zero_copy_only=False)
            ends = [tuple(batch.column(name)[i].as_py() for name in names) for i in (0, batch.num_rows - 1)]
            same[0] = key == ends[0]
            t, is_add = batch.column("t_us").to_numpy(), np.array(batch.column("kind").to_pylist(), object) == ADD_CANDIDATE
            sids, places = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
            edges = [0, *(np.flatnonzero(~same[1:]) + 1).tolist(), len(t)]
            for a, b in zip(edges, edges[1:]):
                if not same[a]:
                    last, first, sid, adds = None, None, 0, 0
                opens, first = session_starts(t[a:b], window, cap, grace, last, first)
                last = int(t[b - 1])
                sids[a:b] = sid + np.cumsum(opens)
                so_far = np.cumsum(is_add[a:b])
                # additions before the session's start are taken off
                base = np.maximum.accumulate(np.where(opens, so_far - is_add[a:b], -adds))
                places[a:b] = so_far - base
                sid, adds = int(sids[b - 1]), int(so_far[-1] - base[-1])
            key = ends[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sids), pa.array(places)], names=[*batch.schema.names, "sid", "place"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    ordered = rows.repartition(*names).sortWithinPartitions(*names, "t_us", "seq")
    return ordered.mapInArrow(run, f"{schema}, sid long, place long")


def assign_sessions(intents: DataFrame, config: SyncConfig, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """intents with sid (1, 2, ... within each key) and place (1, 2, ... among the session's additions).

    One shuffle by key; each partition is read in order of key and time, and only the open session's three numbers are held
    from one batch to the next, so a key of any size takes bounded memory. If a count shows a key with more than hot_rows
    intents, such keys are cut where they were quiet for longer than any session waits, and if they never were, where sessions
    start under the cap (`cuts`); each run is numbered by itself, and what the runs before it came to is added. What stays in one task is one
    session, or a bin as long as the quiet. A hot key with a null in it is not cut. With hot_rows None keys are not counted.
    """
    if hot_rows is None or intents.groupBy(*KEY).count().where(F.col("count") > hot_rows).isEmpty():
        return _number(intents, KEY, config)
    parts = store(cuts(intents, config, hot_rows), "cuts")
    run = F.coalesce(F.col("run") + F.coalesce((F.col("t_us") >= F.col("cut")).cast("long"), F.lit(0)), F.lit(0))
    marked = intents.withColumn("bin", _bin(F.col("t_us"), config.window_us + config.grace_us)).join(parts, [*KEY, "bin"], "left").withColumn("run", run)
    numbered = store(_number(marked.select(*intents.columns, "run"), [*KEY, "run"], config), "numbered")
    sizes = numbered.where(F.col("run") > 0).groupBy(*KEY, "run").agg(F.max("sid").alias("n"))
    before = sizes.select(*KEY, "run", (F.sum("n").over(Window.partitionBy(*KEY).orderBy("run")) - F.col("n")).alias("before"))
    rows = numbered.join(before, [*KEY, "run"], "left").withColumn("sid", F.col("sid") + F.coalesce("before", F.lit(0)))
    return rows.select(*intents.columns, "sid", "place")


def effective_intents(assigned: DataFrame, config: SyncConfig) -> DataFrame:
    """One row for each session: ADD if any intent adds, DROP if any drops, and none if all are of other kinds; the first proofs in order of arrival, repeats and all."""
    order = F.struct("t_us", "seq")
    any_of = lambda kind: F.bool_or(F.col("kind").eqNullSafe(kind))
    kind = F.when(any_of(ADD_CANDIDATE), "ADD").when(any_of(DROP_CANDIDATE), "DROP")
    proofs = F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == ADD_CANDIDATE) & (F.col("place") <= config.proofs), F.struct("t_us", "seq", "proof")))), lambda p: p["proof"])
    out = assigned.groupBy(*KEY, "sid").agg(
        F.min_by("partition_prefix", order).alias("partition_prefix"), kind.alias("kind"), proofs.alias("proof_keys"),
        F.count("*").alias("n"), F.max_by("kind", order).alias("last_kind"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"),
    )
    return out.where(F.col("kind").isNotNull()).withColumn("flush_us", F.least(F.col("last_us") + config.window_us, F.col("first_us") + config.cap_us))


def flush_order(effective: DataFrame) -> DataFrame:
    """Sessions in the order in which a single buffer would flush them: by time, then key."""
    return effective.orderBy("flush_us", *KEY, "sid")


def reconcile(intents: DataFrame, config: SyncConfig) -> DataFrame:
    """All intents of a key as one session, as when a buffer is flushed by force.

    Counts and times combine on the map side, in numbers only. The proofs are the first few additions of each key: these are dealt into
    that many classes by a hash, and the latest of the classes' first times bounds the times of all proofs, so that only what is not
    after it is put in order (all of a key's additions, if a class has none). A key whose intents neither add nor drop gives no row.
    """
    adds, classes = F.col("kind") == ADD_CANDIDATE, F.pmod(F.xxhash64("t_us", "seq"), F.lit(max(config.proofs, 1)))
    lows = [F.min(F.when(adds & (classes == i), F.col("t_us"))).alias(f"low{i}") for i in range(max(config.proofs, 1))]
    names = [*KEY, "partition_prefix"]
    whole = intents.groupBy(*names).agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == ADD_CANDIDATE).alias("n_add"), F.count_if(F.col("kind") == DROP_CANDIDATE).alias("n_drop"),
        F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), *lows,
    ).where((F.col("n_add") > 0) | (F.col("n_drop") > 0))
    low = [F.col(f"low{i}") for i in range(len(lows))]
    whole = store(whole.withColumn("bound", F.when(reduce(and_, [c.isNotNull() for c in low]), F.array_max(F.array(*low)))), "keys")
    bounds = whole.select(*[F.col(c).alias(f"_{c}") for c in names], "bound")
    near = F.col("bound").isNull() | F.col("t_us").isNull() | (F.col("t_us") <= F.col("bound"))
    early = intents.where(adds).select(*names, "t_us", "seq", "proof").join(bounds, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names])).where(near)
    place = F.row_number().over(Window.partitionBy(*names).orderBy("t_us", "seq"))
    first = early.select(*names, "t_us", "seq", "proof").withColumn("place", place).where(F.col("place") <= config.proofs)
    proofs = first.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "proof"))), lambda p: p["proof"]).alias("proof_keys"))
    same = F.lit(True)
    for name in names:
        same = same & whole[name].eqNullSafe(proofs[name])
    out = whole.join(proofs, same, "left").select(whole["*"], "proof_keys").withColumn("kind", F.when(F.col("n_add") > 0, "ADD").otherwise("DROP"))
    flush = F.least(F.col("last_us") + config.window_us, F.col("first_us") + config.cap_us)
    return out.select(*KEY, "partition_prefix", "kind", F.coalesce("proof_keys", F.array().cast("array<string>")).alias("proof_keys"), "n", "first_us", "last_us", flush.alias("flush_us"))


def buffer_snapshot(assigned: DataFrame, now_us: int, config: SyncConfig) -> DataFrame:
    """Open buffers at a moment: count, seconds to the flush, age, kind of the last intent."""
    arrived = effective_intents(assigned.where(F.col("t_us") <= now_us), config)
    still = arrived.where(F.col("flush_us") > now_us - config.grace_us)
    seconds = lambda us: us / F.lit(1e6)
    return still.select(
        *KEY, F.col("n").alias("count"), seconds(F.greatest(F.col("flush_us") - now_us, F.lit(0))).alias("flush_in"), seconds(F.lit(now_us) - F.col("first_us")).alias("age_s"), F.col("last_kind").alias("kind")
    )
