"""Replays of the events table through the streaming buffer and the worker."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesync.config import SyncConfig
from lakesync.functions.hashing import md5_mod
from lakesync.operators import intents, replay, sessions
from lakesync.scratch import new_path, store
from lakesync.sources import envelopes
from lakesync.streaming import latency, worker
from lakesync.streaming.buffer import SESSION, flushed_sessions, open_buffers
from lakesync.streaming.commitlog import CommitLog
from lakesync.streaming.retrying import DUE, KEY, OUTCOME, due_attempts

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Micro-batches of a replay: so many at least, and more where a batch would have more rows than this.
BATCHES, BATCH_ROWS = 4, 2_000_000


def _in_order(spark: SparkSession, folder: str) -> None:
    """A file stream takes files by their time: give the files of a range-partitioned table times in the order of their ranges."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(f.getPath().getName() for f in files.listStatus(path) if f.getPath().getName().startswith("part-"))
    now = int(time.time() * 1000)
    for i, name in enumerate(parts):
        files.setTimes(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), now - 2_000 * (len(parts) - i) - 60_000, -1)


@contextmanager
def rocks(spark: SparkSession):
    """State in RocksDB, as stateful processors need it."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def _stream_intents(spark: SparkSession, own: DataFrame, folder: str) -> None:
    """Intents as files for a stream: ranges of time, a file for each, in their order."""
    ranges = max(BATCHES, -(-own.count() // BATCH_ROWS))
    own.repartitionByRange(ranges, "t_us").write.parquet(f"{folder}/in")
    _in_order(spark, f"{folder}/in")


def _run_buffer(spark: SparkSession, schema, config: SyncConfig, folder: str) -> None:
    with rocks(spark):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        flushed = flushed_sessions(rows, config).where(F.col("tenant_id") != "end")
        flushed.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def state_snapshot(spark: SparkSession, sf_dir: str, config: SyncConfig, now_us: int) -> DataFrame:
    """The open buffers, read from the state of a stopped query by the state data source: no event is read again."""
    folder = new_path(spark, "stream")
    own = store(intents.candidate_intents(envelopes.read(spark, sf_dir)), "intents")
    _stream_intents(spark, own, folder)
    _run_buffer(spark, own.schema, config, folder)
    return open_buffers(spark, f"{folder}/checkpoint", config, now_us)


def streamed_retries(spark: SparkSession, failures: DataFrame, config: SyncConfig) -> DataFrame:
    """Attempts that came due, and dead letters, of failures (key, kind, status, reason, visible_at: the retry that succeeds).

    The clock is driven: each round feeds the outcomes of the attempts that came due in the round before, and then a tick long after, which
    fires all timers. Each round is a run of its own under one checkpoint, so state and timers outlive the restarts between them.
    """
    folder, empty = new_path(spark, "retries"), F.lit(None)
    failures = store(failures, "failures")
    schema = spark.createDataFrame([], OUTCOME).schema
    outcome = failures.select(*KEY, empty.cast("string").alias("partition_prefix"), "kind", F.array().cast("array<string>").alias("proof_keys"), "status", "reason", F.lit(1).alias("attempt"), F.lit(0.0).alias("failed_s"))
    fired = spark.createDataFrame([], DUE)
    with rocks(spark):
        for turn in range(config.max_retries + 1):
            clock = lambda s: F.timestamp_seconds(F.lit(1_000_000 + 1_000 * turn + s))  # noqa: E731, B023
            outcome.withColumn("clock", clock(0)).write.parquet(f"{folder}/in/turn={turn}a")
            tick = spark.range(1).select(*[F.lit("tick").alias(k) for k in KEY], *[empty.cast(schema[c].dataType).alias(c) for c in ("partition_prefix", "kind", "proof_keys")], F.lit("NOOP").alias("status"), empty.cast("string").alias("reason"), F.lit(0).alias("attempt"), F.lit(0.0).alias("failed_s"))
            tick.withColumn("clock", clock(500)).write.parquet(f"{folder}/in/turn={turn}b")
            rows = spark.readStream.schema(schema).parquet(f"{folder}/in/*")
            due_attempts(rows, config, event_time=True).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
            fired = spark.read.schema(DUE).parquet(f"{folder}/out")
            tried = fired.where(~F.col("dead") & (F.col("attempt") == turn + 1)).join(failures.select(*KEY, "visible_at"), KEY)
            done = F.col("attempt") == F.col("visible_at")
            outcome = tried.select(
                *KEY, "partition_prefix", "kind", "proof_keys", F.when(done, "APPLIED").otherwise("RETRY").alias("status"), "reason", (F.col("attempt") + 1).alias("attempt"), F.col("due_s").alias("failed_s")
            )
    return fired


def streamed_sessions(spark: SparkSession, sf_dir: str, config: SyncConfig) -> DataFrame:
    """All sessions of the events, as the stateful stream flushes them. The intents are written in ranges of time, a file for each, which the
    stream takes one a micro-batch in their order; a last file holds one row from long after, whose watermark flushes what is still open.
    The stream writes Parquet files, which are the result."""
    folder = new_path(spark, "stream")
    own = store(intents.candidate_intents(envelopes.read(spark, sf_dir)), "intents")
    _stream_intents(spark, own, folder)
    end = own.agg(F.max("t_us").alias("t_us")).select(
        F.lit(-1).cast("long").alias("seq"), (F.col("t_us") + 2 * (config.cap_us + config.grace_us)).alias("t_us"), *[F.lit("end").alias(c) for c in ("tenant_id", "table_fqn", "partition_key", "partition_prefix", "kind", "proof", "object_key")]
    )
    end.where(F.col("t_us").isNotNull()).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    _run_buffer(spark, own.schema, config, folder)
    return spark.read.schema(SESSION).parquet(f"{folder}/out")


def streamed_latencies(spark: SparkSession, sf_dir: str, config: SyncConfig) -> DataFrame:
    """Latencies of all applied sessions, by state: arrivals and commits in the order of their times, in ranges of time, a micro-batch each."""
    folder = new_path(spark, "latency")
    own = store(intents.candidate_intents(envelopes.read(spark, sf_dir)), "intents")
    applied = replay.replay(sessions.assign_sessions(own, config), config).withColumn("at_us", F.col("flush_us") + config.grace_us)
    news = store(latency.arrivals(own).unionByName(latency.outcomes(applied, "at_us", "sid", "first_us")), "news")
    _stream_intents(spark, news, folder)
    with rocks(spark):
        rows = spark.readStream.schema(news.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        latency.latencies(rows).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(latency.LATENCY).parquet(f"{folder}/out")


def shared_catalog(spark: SparkSession, sf_dir: str, config: SyncConfig, batches: int = 2) -> DataFrame:
    """The catalog that two writers leave in one log. Keys are dealt to them by md5; a third of the keys goes to both, and in each batch the
    second writer's entry comes after one of the first that it has not seen, so those keys are decided again."""
    rows = envelopes.read(spark, sf_dir)
    first, last = rows.agg(F.min("t_us"), F.max("t_us")).first()
    root = new_path(spark, "writers")
    log = CommitLog(spark, f"{root}/catalog")
    if first is None:
        return log.snapshot().select(*KEY)
    step = (last - first) // batches + 1
    of = md5_mod(F.col("partition_key"), 2)
    both = md5_mod(F.concat(F.lit("both"), F.col("partition_key")), 3) == 0
    tables = [worker.Tables(spark, f"{root}/{name}") for name in ("a", "b")]
    for i in range(batches):
        now = i * config.max_backoff / 2
        news = store(rows.where(F.col("t_us").between(first + i * step, first + (i + 1) * step - 1)), "batch")
        for t in tables:
            worker.note_objects(t, news, i)
        flushed = store(sessions.reconcile(intents.candidate_intents(news), config), "flush")
        mine = [flushed.where((of == w) | both) for w in (0, 1)]
        raced = _Raced(spark, log.folder, before_put=lambda: worker.commit_batch(tables[0], mine[0], config, i, now, log=log, writer="a"))  # noqa: B023
        worker.commit_batch(tables[1], mine[1], config, i, now, log=raced, writer="b")
    nothing = intents.candidate_intents(rows.limit(0))
    for t, writer in zip(tables, "ab"):
        worker.drain(t, nothing, config, batches, now, log=log, writer=writer)
    return log.snapshot().select(*KEY)


class _Raced(CommitLog):
    """A log in which something else is put first, once, just before a writer's own entry."""

    def __init__(self, spark: SparkSession, folder: str, before_put):
        super().__init__(spark, folder)
        self.before_put = before_put

    def put(self, version: int, entry: dict) -> bool:
        rival, self.before_put = self.before_put, None
        if rival:
            rival()
        return super().put(version, entry)


def worker_catalog(spark: SparkSession, sf_dir: str, config: SyncConfig, batches: int = 3) -> DataFrame:
    """The catalog that the worker leaves: batches of events one after the other, each noted, flushed by force and committed, then the drain."""
    rows = envelopes.read(spark, sf_dir)
    first, last = rows.agg(F.min("t_us"), F.max("t_us")).first()
    tables, now = worker.Tables(spark, new_path(spark, "worker")), 0.0
    if first is None:
        return tables.latest("catalog").select("tenant_id", "table_fqn", "partition_key")
    step = (last - first) // batches + 1
    for i in range(batches):
        own = rows.where(F.col("t_us").between(first + i * step, first + (i + 1) * step - 1))
        worker.note_objects(tables, own, i)
        mine = intents.candidate_intents(own)
        if i < batches - 1:
            worker.commit_batch(tables, sessions.reconcile(mine, config), config, i, now)
        else:
            worker.drain(tables, mine, config, i, now)
        now += config.max_backoff / 2  # some retries are due by then, some are not
    return tables.latest("catalog").select("tenant_id", "table_fqn", "partition_key")
