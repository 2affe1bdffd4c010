"""The worker as a streaming job: envelopes, sessions, verified commits, retries and dead letters.

Each micro-batch first notes its objects in the inventory, then commits the sessions that the buffer has flushed, then retries
what is due. A batch writes only what it changes, as a version of its own of each table; every `WHOLE_EVERY`th version is also
written whole, and older ones that no batch can need any more are removed. So a batch costs as much as its rows, a reader joins one whole
version with few changes, and a batch that is run again after a failure overwrites its own version and reads those below it. The
version of the inventory that a batch first read is noted, so that a repeated batch reads it again: repeating a batch changes
nothing. `drain` is the shutdown: open buffers are flushed by force and retries run until the queue is empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesync.config import CREATED, SyncConfig
from lakesync.functions.moments import moment, seq_of, time_of
from lakesync.operators import catalog as catalogs
from lakesync.operators import commit, intents, retries
from lakesync.operators.sessions import reconcile
from lakesync.streaming import latency
from lakesync.streaming.buffer import flushed_sessions
from lakesync.streaming.commitlog import CommitLog

KEY = commit.KEY
_INVENTORY = "tenant_id string, object_key string, live boolean, t_us long, seq long"
_CATALOG = "tenant_id string, table_fqn string, partition_key string, location string, at long, gone boolean"
_QUEUE = "tenant_id string, table_fqn string, partition_key string, partition_prefix string, kind string, proof_keys array<string>, n long, attempt int, retry_at_s double, at long, gone boolean"
_DEAD = "tenant_id string, table_fqn string, partition_key string, kind string, reason string, attempt int"
_AUDIT = "tenant_id string, table_fqn string, partition_key string, kind string, status string, reason string, heads long, lists long, n long, attempt int, at long, at_s double"
#: Of so many versions of a table, one is also written whole.
WHOLE_EVERY = 16


@dataclass
class Tables:
    """Versioned Parquet tables of a job in a folder that driver and executors share.

    States (those with a key) are read as the last row of each key, by `order`, less those that are gone; the others are logs, read as all their rows.
    """

    spark: SparkSession
    folder: str
    kinds: dict = field(default_factory=lambda: {"inventory": _INVENTORY, "catalog": _CATALOG, "queue": _QUEUE, "dead": _DEAD, "audit": _AUDIT})
    keys: dict = field(default_factory=lambda: {"inventory": ["tenant_id", "object_key"], "catalog": KEY, "queue": KEY})
    order: dict = field(default_factory=lambda: {"inventory": ["t_us", "seq"], "catalog": ["at"], "queue": ["at"]})

    def path(self, name: str, version: int) -> str:
        return f"{self.folder}/{name}/v{version}"

    def _files(self, name: str):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return root, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        """The versions that have been written to their end."""
        root, files = self._files(name)
        done = files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(root, "v*/_SUCCESS"))
        return sorted(int(d.getPath().getParent().getName()[1:]) for d in done or [])

    def _read(self, name: str, folder: str, versions: list[int]) -> DataFrame:
        schema = self.kinds[name]
        return self.spark.read.schema(schema).parquet(*[self.path(folder, v) for v in versions]) if versions else self.spark.createDataFrame([], schema)

    def changes(self, name: str, version: int) -> DataFrame:
        """What one version has written."""
        return self._read(name, name, [version])

    def _whole_below(self, name: str, before: int | None) -> int:
        return max((v for v in self.versions(f"{name}-whole") if before is None or v < before), default=-1)

    def _fold(self, name: str, before: int | None, whole: int) -> DataFrame:
        """The last row of each key: those of a whole version that nothing has touched since, and the others folded with the changes."""
        later = [v for v in self.versions(name) if v > whole and (before is None or v < before)]
        base, key = self._read(name, f"{name}-whole", [whole] if whole >= 0 else []), self.keys[name]
        if whole >= 0 and not later:
            return base
        changed = self._read(name, name, later)
        touched = changed.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
        same = F.lit(True)
        for k in key:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        rows = base.join(touched, same, "left_semi").unionByName(changed) if whole >= 0 else changed
        last = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(*self.order[name])).alias("r")).select(*key, "r.*")
        last = last.select(*rows.columns)
        return base.join(touched, same, "left_anti").unionByName(last) if whole >= 0 else last

    def latest(self, name: str, before: int | None = None) -> DataFrame:
        """A table as all versions leave it, or those below one; empty if there is none."""
        if name not in self.keys:
            return self._read(name, name, [v for v in self.versions(name) if before is None or v < before])
        rows = self._fold(name, before, self._whole_below(name, before))
        return rows.where(~F.col("gone")).drop("at", "gone") if "gone" in rows.columns else rows

    def pinned(self, name: str, version: int) -> tuple[DataFrame, int]:
        """A table as a batch read it first, whatever has been written since, and the version below which that was."""
        notes = f"{name}-read-by"
        if version not in self.versions(notes):
            self.spark.createDataFrame([(max(self.versions(name), default=-1),)], "version long").write.mode("overwrite").parquet(self.path(notes, version))
        below = self.spark.read.schema("version long").parquet(self.path(notes, version)).first()[0] + 1
        return self.latest(name, below), below

    def _remove(self, name: str, below: int) -> None:
        _, files = self._files(name)
        for v in self.versions(name):
            if v < below:
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name, v)), True)

    def prune(self, name: str, before: int) -> None:
        """Remove what reading the table as of below a version, or any later one, does not need."""
        whole = self._whole_below(name, before)
        self._remove(name, whole + 1)
        self._remove(f"{name}-whole", whole)

    def write(self, name: str, df: DataFrame, version: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name, version))
        return self.changes(name, version)

    def write_whole(self, name: str, version: int) -> None:
        """If it is that version's turn: the table as it is now, from the whole version before it."""
        if version % WHOLE_EVERY == 0:
            rows = self._fold(name, version + 1, self._whole_below(name, version))
            rows = rows.where(~F.col("gone")) if "gone" in rows.columns else rows
            rows.write.mode("overwrite").parquet(self.path(f"{name}-whole", version))


def note_objects(tables: Tables, envelopes: DataFrame, version: int) -> None:
    """Put the kept events of a batch into the inventory; the later event of an object holds, in order of arrival. A batch that is there is left alone."""
    if version not in tables.versions("inventory"):
        news = intents.kept(envelopes).select("tenant_id", "object_key", (F.col("op") == CREATED).alias("live"), moment(F.col("t_us"), F.col("seq")).alias("at"))
        ends = news.groupBy("tenant_id", "object_key").agg(F.max(F.when(F.col("live"), F.col("at"))).alias("put"), F.max("at").alias("last"))
        last = F.col("last")
        folded = ends.select("tenant_id", "object_key", F.coalesce(F.col("put") == last, F.lit(False)).alias("live"), time_of(last).alias("t_us"), seq_of(last).alias("seq"))
        tables.write("inventory", folded, version)
    if version not in tables.versions("inventory-whole"):
        tables.write_whole("inventory", version)


def one_intent(rows: DataFrame, proofs: int) -> DataFrame:
    """The intents of each key as one: ADD if any adds, with the first proofs of those that do, newest sessions first."""
    adds = F.col("kind") == "ADD"
    of_adds = F.array_sort(F.collect_list(F.when(adds, F.struct("attempt", "proof_keys"))))
    return rows.groupBy(*KEY).agg(
        F.first("partition_prefix").alias("partition_prefix"), F.when(F.bool_or(adds), "ADD").otherwise(F.first("kind")).alias("kind"),
        F.slice(F.flatten(F.transform(of_adds, lambda p: p["proof_keys"])), 1, proofs).alias("proof_keys"), F.sum("n").alias("n"), F.min("attempt").alias("attempt"),
    )


def commit_batch(tables: Tables, sessions: DataFrame, config: SyncConfig, version: int, now_s: float, faults: DataFrame | None = None, log: CommitLog | None = None, writer: str = "") -> DataFrame:
    """Apply flushed sessions and the retries that are due: catalog, queue, dead letters and audit of this version.

    With a log, the catalog is the log's, which several writers share: each has tables of its own for the rest, and reads its keys' buckets only.
    """
    columns = [*KEY, "partition_prefix", "kind", "proof_keys", "n"]
    queue = tables.latest("queue", version)
    fresh = sessions.select(*columns).withColumn("attempt", F.lit(0))
    # one intent for a key: what waits for a retry, due or not, goes with the key's new sessions, and an addition dominates
    early = queue.where(F.col("retry_at_s") > now_s).join(fresh.select(*KEY).distinct(), KEY, "left_semi")
    ready = retries.due(queue, now_s).unionByName(early).select(*columns, "attempt")
    both = one_intent(fresh.unionByName(ready), config.proofs)
    inventory, below = tables.pinned("inventory", version)
    decide = lambda rows, known: commit.apply(rows, known, inventory.where("live"), config.enable_drop, faults)
    results = log.commit(both, decide, writer, version)[1] if log else decide(both, tables.latest("catalog", version)).cache()
    when = [F.lit(version).cast("long").alias("at"), F.lit(now_s).cast("double").alias("at_s")]
    audit = tables.write("audit", results.select(*KEY, "kind", "status", "reason", "heads", "lists", "n", "attempt", *when), version)
    at, gone = F.lit(version).cast("long").alias("at"), F.col("in_catalog") & ~F.col("in_catalog_after")
    tables.write("catalog", results.where(F.col("in_catalog") != F.col("in_catalog_after")).select(*KEY, F.col("partition_prefix").alias("location"), at, gone.alias("gone")), version)
    again, dead = retries.requeue(results, config, now_s)
    waits = again.select(*columns, F.col("attempt").cast("int"), "retry_at_s", at, F.lit(False).alias("gone"))
    settled = ready.join(again.select(*KEY), KEY, "left_anti").select(*columns, "attempt", F.lit(None).cast("double").alias("retry_at_s"), at, F.lit(True).alias("gone"))
    tables.write("queue", waits.unionByName(settled), version)
    tables.write("dead", dead.select(*KEY, "kind", "reason", F.col("attempt").cast("int")), version)
    results.unpersist()
    for name in ("catalog", "queue"):
        tables.write_whole(name, version)
        tables.prune(name, version)
    tables.prune("inventory", below)
    tables._remove("inventory-read-by", version)
    return audit


def drain(tables: Tables, open_intents: DataFrame, config: SyncConfig, version: int, now_s: float, log: CommitLog | None = None, writer: str = "") -> int:
    """Flush what is still buffered by force, then retry whatever waits until nothing does; returns the next free version.

    A round's clock stands past every backoff, so there are max_retries + 1 rounds at most.
    """
    flushed = reconcile(open_intents, config)
    while True:
        commit_batch(tables, flushed, config, version, now_s, log=log, writer=writer)
        version, now_s = version + 1, now_s + config.max_backoff + 1
        if tables.latest("queue").isEmpty():
            return version
        flushed = flushed.limit(0)


def writers(spark: SparkSession, envelopes: DataFrame, folder: str, config: SyncConfig, table: str | None = None, location: str | None = None, event_time: bool = True):
    """The job on a stream of envelopes as two writers to start, inventory and commits. With a table, Spark's catalog follows.

    The inventory is kept by a query of its own on the same source, which runs ahead of the buffer by at least the window.
    """
    tables = Tables(spark, folder)
    flushed = flushed_sessions(intents.candidate_intents(envelopes), config, event_time)

    def commit_sessions(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        now = own.sql("SELECT unix_micros(current_timestamp()) / 1e6 AS now").first().now
        commit_batch(tables, batch, config, batch_id, float(now))
        if table:
            moved = tables.changes("catalog", batch_id).select("partition_key", F.col("gone").alias("in_catalog"), (~F.col("gone")).alias("in_catalog_after"))
            catalogs.sync_table(own, table, moved, location)

    noted = envelopes.writeStream.foreachBatch(lambda batch, i: note_objects(tables, batch, i)).option("checkpointLocation", f"{folder}/checkpoint-inventory").queryName("inventory")
    commits = flushed.writeStream.foreachBatch(commit_sessions).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint-commit").queryName("commit")
    return noted, commits


def latency_writer(spark: SparkSession, envelopes: DataFrame, folder: str, ttl_s: float | None = None):
    """A third writer to start, beside `writers`: latencies of what they apply, from the audit as it grows. A batch that is committed again counts once.

    With a time to live the state goes by the clock, and such a query has batches without data as often as its trigger says: give it an interval, or
    `once`; it never ends by `availableNow`.
    """
    audit = spark.readStream.schema(_AUDIT).parquet(f"{folder}/audit/v*").withColumn("at_us", (F.col("at_s") * 1e6).cast("long"))
    news = latency.arrivals(intents.candidate_intents(envelopes)).unionByName(latency.outcomes(audit, "at_us", "at"))
    out = latency.latencies(news, ttl_s).writeStream.format("parquet").option("path", f"{folder}/latency").outputMode("append")
    return out.option("checkpointLocation", f"{folder}/checkpoint-latency").queryName("latency")
