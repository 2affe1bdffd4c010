"""Queries by name, and the SQL that gives the same rows.

A query takes (spark, sf_dir) and reads the table `events`: as envelopes, as a log of notifications, or as the partitions in which the
experiments generate theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesync.config import ADD_CANDIDATE, CREATED, DELETED, TABLE_ROOT, SyncConfig
from lakesync.functions import paths
from lakesync.functions.hashing import md5_mod
from lakesync.functions.quantiles import summary
from lakesync.operators import catalog, commit, hashtree, intents, inventory, metrics, replay, retries, sessions
from lakesync.plans import sql
from lakesync.plans.streamed import shared_catalog, state_snapshot, streamed_latencies, streamed_retries, streamed_sessions, worker_catalog
from lakesync.scratch import new_path, store
from lakesync.sources import envelopes, eventlog, generator, objectstore

CONFIG = SyncConfig(window=3600, grace=10)
TIGHT = SyncConfig(window=3600, grace=10, cap=7200)
#: The published sweeps. Fixed values.
FRACTIONS = [0.001, 0.01, 0.05, 0.1, 0.5, 1.0]
DROPS = [0.01, 0.05, 0.10, 0.25, 0.50, 1.00]

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intents.candidate_intents(envelopes.read(spark, sf_dir))


def _assigned(spark: SparkSession, sf_dir: str, config: SyncConfig = CONFIG) -> DataFrame:
    return sessions.assign_sessions(_intents(spark, sf_dir), config)


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intents as a table, for what reads them more than once."""
    return store(_intents(spark, sf_dir), "intents")


def _live_of(own: DataFrame) -> DataFrame:
    """The live objects of intents, as a table: lookups read it more than once, and it is small next to what it comes from."""
    return store(inventory.live_inventory(own.withColumn("op", F.when(F.col("kind") == ADD_CANDIDATE, CREATED).otherwise(DELETED))), "live")


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.live_inventory(intents.kept(envelopes.read(spark, sf_dir)))


def _last_us(spark: SparkSession, sf_dir: str) -> int:
    """The time of the last event; 0 if there is none."""
    return envelopes.read(spark, sf_dir).agg(F.max("t_us")).first()[0] or 0


def _key() -> list:
    return [F.col(c) for c in sessions.KEY]


# --- envelopes, verdicts, paths ---------------------------------------------------------------------------------------


@query(sql.EVENT_VERDICTS)
def event_verdicts(spark, sf_dir):
    return metrics.verdict_counts(envelopes.read(spark, sf_dir))


@query(sql.FILTER_ACCOUNTING)
def filter_accounting(spark, sf_dir):
    return metrics.filter_accounting(envelopes.read(spark, sf_dir))


@query(sql.CANDIDATE_INTENTS)
def candidate_intents(spark, sf_dir):
    return _intents(spark, sf_dir).drop("object_key")


@query(sql.ROUTED_INTENTS)
def routed_intents(spark, sf_dir):
    routes = spark.createDataFrame([("warehouse/sales/", "warehouse.sales"), ("warehouse/other/", "warehouse.other"), ("warehouse/", "warehouse.rest")], "table_root string, table_fqn string")
    return intents.routed_intents(envelopes.read(spark, sf_dir), routes).select("seq", "tenant_id", "table_fqn", "partition_key", "partition_prefix", "kind")


@query(sql.OBJECT_PATHS)
def object_paths(spark, sf_dir):
    key = F.col("object_key")
    rows = envelopes.read(spark, sf_dir).select("object_key").distinct()
    return rows.select(key, paths.directory(key).alias("directory"), paths.partition_key(key).alias("partition_key"), paths.basename(key).alias("file_name"), paths.short(key, 24).alias("short"))


# --- log --------------------------------------------------------------------------------------------------------------


def _messages(spark, sf_dir):
    return envelopes.read(spark, sf_dir).select("seq", paths.directory(F.col("object_key")).alias("key"), F.col("object_key").alias("value"))


#: The least offsets a segment of the log. Small, so that small tables have several.
_SEGMENT = 1_000
#: About so many segments a large table has: each is a file or more, and a task of a reader.
_SEGMENTS = 64


def _log(spark, messages, partitions):
    """A log that holds the messages."""
    path = new_path(spark, "log")
    _append(spark, messages, path, partitions)
    return path


def _append(spark, messages, path, partitions):
    messages = store(messages, "messages")  # counted, and read twice by the log
    size = min(eventlog.SEGMENT, max(_SEGMENT, -(-messages.count() // _SEGMENTS)))
    eventlog.append(messages, path, partitions, size, size)


@query(sql.ROUTE_OFFSETS)
def route_offsets(spark, sf_dir):
    """All messages as a stream reads them from the log."""
    path = _log(spark, _messages(spark, sf_dir), 2)
    rows, _ = eventlog.poll(spark, path, new_path(spark, "poll"), "all", 1)
    return rows.select("partition", "offset", "seq", "key")


@query(sql.PARTITION_LAG)
def partition_lag(spark, sf_dir):
    """After three batches of 500 messages a partition at most, with a restart between them; positions are those of the query's progress."""
    path = _log(spark, _messages(spark, sf_dir), 3)
    _, at = eventlog.poll(spark, path, new_path(spark, "poll"), "lagging", 3, most=500)
    return eventlog.lag(spark, path, at)


@query(sql.POLLED_MESSAGES)
def polled_messages(spark, sf_dir):
    """One batch of 25 messages a partition from position 40 on."""
    path = _log(spark, _messages(spark, sf_dir), 3)
    rows, _ = eventlog.poll(spark, path, new_path(spark, "poll"), "polling", 1, start='{"0": 40, "1": 40, "2": 40}', most=25)
    return rows.select("partition", "offset", "value")


@query(sql.RECENT_MESSAGES)
def recent_messages(spark, sf_dir):
    rows = eventlog.read(spark, _log(spark, _messages(spark, sf_dir), 2)).select("partition", "offset", "value")
    return rows.orderBy(F.desc("partition"), F.desc("offset")).limit(20)


@query(sql.EVENT_FEED)
def event_feed(spark, sf_dir):
    """The last 20 events with the number of events that their partition had before."""
    rows = _intents(spark, sf_dir).select("seq", "partition_key", "kind")
    last = F.broadcast(rows.orderBy(F.desc("seq")).limit(20))  # twenty rows; only their keys' events are counted
    earlier = rows.select(F.col("seq").alias("before"), F.col("partition_key").alias("key"))
    met = earlier.join(last, (F.col("key") == F.col("partition_key")) & (F.col("before") <= F.col("seq")))
    return met.groupBy("seq", "partition_key", "kind").agg((F.count("*") - 1).alias("prev_count"))


@query(sql.SOUGHT_POSITIONS)
def sought_positions(spark, sf_dir):
    """A reader starts at the end of a log that holds the events but for one in five, and takes one batch once those have come."""
    messages, later = _messages(spark, sf_dir), F.col("seq") % 5 == 4
    path, folder = _log(spark, messages.where(~later), 3), new_path(spark, "poll")
    eventlog.poll(spark, path, folder, "late", 1, start="latest")
    _append(spark, messages.where(later), path, 3)
    _, at = eventlog.poll(spark, path, folder, "late", 1, start="latest", most=100)
    return eventlog.lag(spark, path, at)


# --- inventory and catalog --------------------------------------------------------------------------------------------


@query(sql.LIVE_INVENTORY)
def live_inventory(spark, sf_dir):
    return _live(spark, sf_dir)


@query(sql.CONVERGED_CATALOG)
def converged_catalog(spark, sf_dir):
    return catalog.converged(_live(spark, sf_dir))


def _prefixes(spark, sf_dir):
    """All partitions' prefixes and the folders above them."""
    own = _intents(spark, sf_dir).select("tenant_id", "partition_prefix").distinct()
    parents = own.select("tenant_id", F.regexp_replace("partition_prefix", "[^/]+/$", "").alias("partition_prefix")).distinct()
    return own.unionByName(parents)


@query(sql.LIST_NONEMPTY)
def list_nonempty(spark, sf_dir):
    return inventory.list_prefixes(_prefixes(spark, sf_dir), _live(spark, sf_dir))


@query(sql.SCAN_REQUESTS)
def scan_requests(spark, sf_dir):
    return inventory.scan_requests(_live(spark, sf_dir))


@query(sql.PURGED_INVENTORY)
def purged_inventory(spark, sf_dir):
    return inventory.purge_prefix(_live(spark, sf_dir), "warehouse/sales/dt=2024-01-0").groupBy("tenant_id").agg(F.count("*").alias("n"))


def _stale_catalog(spark, sf_dir, own=None):
    """A third of all partitions, whatever storage holds of them, and one that never was."""
    own = _intents(spark, sf_dir) if own is None else own
    # written, as the hash of each key would otherwise be taken of each row
    known = store(own.select("tenant_id", "table_fqn", "partition_key", F.col("partition_prefix").alias("location")).distinct(), "known")
    ghost = spark.createDataFrame([("tenant-1", "warehouse.sales", "dt=1999-01-01/region=R000", "warehouse/sales/dt=1999-01-01/region=R000/")], known.schema)
    return known.where(md5_mod(F.col("partition_key"), 3) == 0).unionByName(ghost)


@query(sql.SCAN_REPAIR_DIFF)
def scan_repair_diff(spark, sf_dir):
    return catalog.repair_diff(_stale_catalog(spark, sf_dir), _live(spark, sf_dir))


@query(sql.SCAN_REPAIR_DIFF)
def stored_repair_diff(spark, sf_dir):
    """scan_repair_diff against a whole listing of files, level by level."""
    files = _stored(spark, sf_dir)
    listed, _ = files.objects(_intents(spark, sf_dir).select("tenant_id").distinct(), TABLE_ROOT)
    return catalog.repair_diff(_stale_catalog(spark, sf_dir), listed)


@query(sql.LISTED_FOLDERS)
def listed_folders(spark, sf_dir):
    """Folders that a whole listing opens beside the LIST requests that the flush's decisions make."""
    files = _stored(spark, sf_dir)
    listed, requests = files.objects(_intents(spark, sf_dir).select("tenant_id").distinct(), TABLE_ROOT)
    lists = _flush(spark, sf_dir, storage=files).agg(F.sum("lists")).first()[0] or 0
    return listed.agg(F.count("*").alias("objects")).select("objects", F.lit(requests).cast("long").alias("folders"), F.lit(lists).cast("long").alias("lists"))


def _unequal(spark, sf_dir):
    listed = catalog.converged(_live(spark, sf_dir))
    return hashtree.descend(hashtree.written(hashtree.tree(_stale_catalog(spark, sf_dir))), hashtree.written(hashtree.tree(listed)))


@query(sql.TREE_REPAIR_DIFF)
def tree_repair_diff(spark, sf_dir):
    """What scan_repair_diff would change, found by opening unequal folders only."""
    return hashtree.differences(_unequal(spark, sf_dir))


@query(sql.TREE_REQUESTS)
def tree_requests(spark, sf_dir):
    """Folders that a scan lists, and those that the descent opens."""
    unequal = store(_unequal(spark, sf_dir), "unequal")
    scan = inventory.scan_requests(_live(spark, sf_dir)).withColumnRenamed("requests", "scan")
    changed = hashtree.differences(unequal).groupBy("tenant_id").agg(F.count("*").alias("differences"))
    rows = scan.join(hashtree.requests(unequal), "tenant_id", "left").join(changed, "tenant_id", "left")
    return rows.select("tenant_id", "scan", F.coalesce("requests", F.lit(0)).alias("descent"), F.coalesce("differences", F.lit(0)).alias("differences"))


@query(sql.updated_tree())
def updated_tree(spark, sf_dir):
    """The catalog's tree after a flush, from its tree before and the keys that the flush changed."""
    own = _noted(spark, sf_dir)
    changes = _flush(spark, sf_dir, own=own).where(F.col("in_catalog") != F.col("in_catalog_after")).select(*_key(), F.col("in_catalog_after").alias("added"))
    nodes = hashtree.updated(hashtree.tree(_stale_catalog(spark, sf_dir, own)), changes)
    return nodes.select("tenant_id", "level", "prefix", "n")


# --- sessions ---------------------------------------------------------------------------------------------------------


@query(sql.QUIET_SESSIONS)
def quiet_sessions(spark, sf_dir):
    return sessions.quiet_sessions(_intents(spark, sf_dir), SyncConfig(window=900, grace=10))


def _session_columns(rows: DataFrame) -> DataFrame:
    return rows.select(*_key(), "sid", "kind", "n", "last_kind", "first_us", "last_us", "flush_us")


@query(sql.capped_sessions(3600, 10, 18000))
def capped_sessions(spark, sf_dir):
    return _session_columns(sessions.effective_intents(_assigned(spark, sf_dir), CONFIG))


@query(sql.capped_sessions(3600, 10, 7200))
def tightly_capped_sessions(spark, sf_dir):
    return _session_columns(sessions.effective_intents(_assigned(spark, sf_dir, TIGHT), TIGHT))


@query(sql.capped_sessions(3600, 10, 7200))
def shared_sessions(spark, sf_dir):
    """tightly_capped_sessions with keys of more than 16 intents shared by several tasks."""
    return _session_columns(sessions.effective_intents(sessions.assign_sessions(_noted(spark, sf_dir), TIGHT, hot_rows=16), TIGHT))


@query(sql.EFFECTIVE_INTENTS)
def effective_intents(spark, sf_dir):
    rows = sessions.effective_intents(_assigned(spark, sf_dir), CONFIG)
    return rows.select(*_key(), "sid", "partition_prefix", "kind", F.array_join("proof_keys", ",").alias("proofs"), F.size("proof_keys").cast("long").alias("n_proofs"))


@query(sql.BUFFER_SNAPSHOT)
def buffer_snapshot(spark, sf_dir):
    rows, now = _assigned(spark, sf_dir), _last_us(spark, sf_dir)
    return sessions.buffer_snapshot(rows, now, CONFIG)


@query(sql.BUFFER_SNAPSHOT)
def state_snapshot_query(spark, sf_dir):
    """buffer_snapshot, read from a stream's state."""
    return state_snapshot(spark, sf_dir, CONFIG, _last_us(spark, sf_dir))


QUERIES["state_snapshot"], ORACLES["state_snapshot"] = QUERIES.pop("state_snapshot_query"), ORACLES.pop("state_snapshot_query")


@query(sql.FLUSHED_BETWEEN)
def flushed_between(spark, sf_dir):
    """Keys that were buffered two hours before the end and have been flushed since."""
    rows, now = _assigned(spark, sf_dir), _last_us(spark, sf_dir)
    past, present = (sessions.buffer_snapshot(rows, t, CONFIG) for t in (now - 7_200_000_000, now))
    return catalog.flushed_keys(past, present).select(*_key(), "count")


@query(sql.FLUSH_SEQUENCE)
def flush_sequence(spark, sf_dir):
    """The first hundred sessions that a single buffer would flush."""
    rows = sessions.flush_order(sessions.effective_intents(_assigned(spark, sf_dir), CONFIG)).limit(100)
    return rows.select(*_key(), "sid", "kind", "flush_us")


@query(sql.LAST_FLUSHES)
def last_flushes(spark, sf_dir):
    return catalog.last_flushes(sessions.effective_intents(_assigned(spark, sf_dir), CONFIG), _last_us(spark, sf_dir))


@query(sql.COVERAGE)
def coverage(spark, sf_dir):
    return _intents(spark, sf_dir).groupBy("tenant_id").agg(F.count_distinct("partition_key").alias("partitions"), F.count_distinct("object_key").alias("objects"))


@query(sql.capped_sessions(3600, 10, 18000))
def streamed_sessions_query(spark, sf_dir):
    return _session_columns(streamed_sessions(spark, sf_dir, CONFIG))


QUERIES["streamed_sessions"], ORACLES["streamed_sessions"] = QUERIES.pop("streamed_sessions_query"), ORACLES.pop("streamed_sessions_query")


@query(sql.WORKER_CATALOG)
def worker_catalog_query(spark, sf_dir):
    return worker_catalog(spark, sf_dir, CONFIG)


QUERIES["worker_catalog"], ORACLES["worker_catalog"] = QUERIES.pop("worker_catalog_query"), ORACLES.pop("worker_catalog_query")


@query(sql.WORKER_CATALOG)
def two_writers_catalog(spark, sf_dir):
    return shared_catalog(spark, sf_dir, CONFIG)


# --- verified commit --------------------------------------------------------------------------------------------------


def _stored(spark, sf_dir):
    """The live objects of the events, written as a tree of files."""
    root = new_path(spark, "objects")
    objectstore.write_objects(_live(spark, sf_dir), root)
    return objectstore.FileStore(spark, root)


def _flush(spark, sf_dir, enable_drop=True, faults=None, storage=None, own=None):
    own = _noted(spark, sf_dir) if own is None else own
    effective = sessions.reconcile(own, CONFIG)
    # a share of the keys only deletes: the others would all be additions
    only = F.when(md5_mod(F.concat("tenant_id", "partition_key"), 4) == 1, "DROP").otherwise(F.col("kind"))
    effective = effective.withColumn("proof_keys", F.when(only == "DROP", F.array().cast("array<string>")).otherwise(F.col("proof_keys"))).withColumn("kind", only)
    return commit.apply(effective, _stale_catalog(spark, sf_dir, own), storage or _live_of(own), enable_drop, faults)


def _results(rows):
    return rows.select(*_key(), "kind", "status", F.coalesce("reason", F.lit("")).alias("reason"), "heads", "lists", "in_catalog", "in_catalog_after")


@query(sql.HEAD_PROOFS)
def head_proofs(spark, sf_dir):
    effective = sessions.reconcile(_intents(spark, sf_dir), CONFIG).where(F.col("kind") == "ADD")
    return inventory.head_proofs(effective, _live(spark, sf_dir), sessions.KEY).withColumn("first_hit", F.coalesce("first_hit", F.lit(0)))


@query(sql.HEAD_PROOFS)
def stored_head_proofs(spark, sf_dir):
    """head_proofs asked of files."""
    effective = sessions.reconcile(_intents(spark, sf_dir), CONFIG).where(F.col("kind") == "ADD")
    return _stored(spark, sf_dir).heads(effective, sessions.KEY).withColumn("first_hit", F.coalesce("first_hit", F.lit(0)))


@query(sql.LIST_NONEMPTY)
def stored_list_nonempty(spark, sf_dir):
    """list_nonempty asked of files."""
    return _stored(spark, sf_dir).listed(_prefixes(spark, sf_dir))


@query(sql.commit_decisions(True))
def commit_decisions(spark, sf_dir):
    return _results(_flush(spark, sf_dir))


@query(sql.commit_decisions(True))
def stored_commit_decisions(spark, sf_dir):
    """commit_decisions with HEAD and LIST asked of files."""
    return _results(_flush(spark, sf_dir, storage=_stored(spark, sf_dir)))


@query(sql.commit_decisions(False))
def commit_decisions_no_drop(spark, sf_dir):
    return _results(_flush(spark, sf_dir, enable_drop=False))


def _faulty_flush(spark, sf_dir):
    own = _noted(spark, sf_dir)
    keys = store(own.select("partition_key").distinct(), "keys")
    pick = lambda names, salt: F.element_at(F.array(*map(F.lit, names)), md5_mod(F.concat(F.lit(salt), "partition_key"), len(names)) + 1)
    faults = keys.where(md5_mod(F.concat(F.lit("any"), "partition_key"), 2) == 0).select("partition_key", pick(["head", "list", "create", "drop"], "call").alias("call"), pick(["transient", "fatal"], "error").alias("error"))
    return _flush(spark, sf_dir, faults=faults, own=own)


@query(sql.commit_decisions(True, faults=True))
def commit_with_faults(spark, sf_dir):
    return _results(_faulty_flush(spark, sf_dir))


@query(sql.observed_counts())
def observed_counts(spark, sf_dir):
    """Counters of commit_with_faults, observed while its results are written."""
    results, seen = metrics.observed(_faulty_flush(spark, sf_dir))
    results.write.parquet(new_path(spark, "results"))
    got = seen.get
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{name} long" for name in got))


@query(sql.UNKNOWN_KINDS)
def unknown_kinds(spark, sf_dir):
    """Intents of a kind that nobody knows are errors, and change nothing."""
    own = _noted(spark, sf_dir)
    effective = sessions.reconcile(own, CONFIG).withColumn("kind", F.lit("MERGE"))
    return _results(commit.apply(effective, _stale_catalog(spark, sf_dir, own), _live_of(own)))


@query(sql.outcome_counts())
def outcome_counts(spark, sf_dir):
    return commit.outcome_counts(_flush(spark, sf_dir)).withColumn("reason", F.coalesce("reason", F.lit("")))


@query(sql.catalog_after())
def catalog_after_flush(spark, sf_dir):
    return commit.catalog_after(_stale_catalog(spark, sf_dir), _flush(spark, sf_dir))


@query(sql.request_cost())
def request_cost(spark, sf_dir):
    rows = metrics.request_cost(_flush(spark, sf_dir))
    return rows.select("buffered", "committed", "coalesced", "heads", "lists", *[F.round(c, 6).alias(c) for c in ("alpha_eff", "reduction", "daily_cost")])


@query(sql.session_replay(900, 10, 4500))
def session_replay(spark, sf_dir):
    config = SyncConfig(window=900, grace=10)
    rows = replay.replay(_assigned(spark, sf_dir, config), config)
    return rows.select(*_key(), "sid", "kind", "status", F.coalesce("reason", F.lit("")).alias("reason"))


@query(sql.session_replay(3600, 10, 7200, counts=True))
def replay_counts(spark, sf_dir):
    rows = replay.replay(_assigned(spark, sf_dir, TIGHT), TIGHT)
    return rows.groupBy("kind", "status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def _percentiles(spark, lat):
    lat = store(lat, "latencies")
    out = []
    for name in ("latency_s", "session_s"):
        n, middle, got = summary(lat, name, {"p95": 0.95, "p99": 0.99})
        out.append((name, n, middle, got["p95"], got["p99"]))
    return spark.createDataFrame(out, "measure string, n long, median double, p95 double, p99 double").select("measure", "n", *[F.round(c, 3).alias(c) for c in ("median", "p95", "p99")])


@query(sql.LATENCY_PERCENTILES)
def latency_percentiles(spark, sf_dir):
    own = _intents(spark, sf_dir)
    return _percentiles(spark, replay.latencies(replay.replay(sessions.assign_sessions(own, CONFIG), CONFIG), own, CONFIG))


@query(sql.LATENCY_PERCENTILES)
def streamed_latency_percentiles(spark, sf_dir):
    return _percentiles(spark, streamed_latencies(spark, sf_dir, CONFIG))


# --- retries ----------------------------------------------------------------------------------------------------------


def _attempts(spark, sf_dir):
    rows = _intents(spark, sf_dir).select(*_key()).distinct().withColumn("kind", F.lit("ADD")).withColumn("status", F.lit("RETRY")).withColumn("reason", F.lit("not_visible_yet"))
    return rows.withColumn("visible_at", inventory.attempt_needed(F.col("partition_key"))), CONFIG


@query(sql.RETRY_SCHEDULE)
def retry_schedule(spark, sf_dir):
    rows, config = _attempts(spark, sf_dir)
    return retries.schedule(rows, config).select(*_key(), "attempt", F.round("wait_s", 4).alias("wait_s"), F.round("at_s", 4).alias("at_s"), "status")


@query(sql.DEAD_LETTERS)
def dead_letters(spark, sf_dir):
    rows, config = _attempts(spark, sf_dir)
    return retries.dead_letters(rows, retries.schedule(rows, config))


def _streamed_retries(spark, sf_dir):
    rows, config = _attempts(spark, sf_dir)
    return streamed_retries(spark, rows, config), rows, config


@query(sql.RETRY_SCHEDULE)
def streamed_retry_schedule(spark, sf_dir):
    """retry_schedule as the state's timers fire it."""
    fired, rows, config = _streamed_retries(spark, sf_dir)
    due = fired.where(~F.col("dead")).join(rows.select(*_key(), "visible_at"), sessions.KEY)
    status = F.when(F.col("attempt") == F.col("visible_at"), "APPLIED").when(F.col("attempt") == config.max_retries, "DLQ").otherwise("RETRY")
    return due.select(*_key(), "attempt", F.round("wait_s", 4).alias("wait_s"), F.round("due_s", 4).alias("at_s"), status.alias("status"))


@query(sql.DEAD_LETTERS)
def streamed_dead_letters(spark, sf_dir):
    """dead_letters as the state gives them up."""
    fired, _, _ = _streamed_retries(spark, sf_dir)
    return fired.where("dead").select(*_key(), "kind", "reason", (F.col("attempt") - 1).alias("attempts"))


@query(sql.JITTERED_RETRIES)
def jittered_retries(spark, sf_dir):
    """Additions verified against a storage whose objects come into sight by and by, until they are in or the retries are spent."""
    config = SyncConfig(window=3600, grace=10, max_retries=3)
    own = _noted(spark, sf_dir)
    effective = store(sessions.reconcile(own, config).where(F.col("kind") == "ADD"), "flush")
    rows = retries.attempts_until_settled(effective, metrics._no_catalog(spark), _live_of(own), config, 0.7)
    return rows.select(*_key(), "status", F.coalesce("reason", F.lit("")).alias("reason"), "attempts")


def _space(spark, sf_dir):
    return generator.space(spark.read.parquet(f"{sf_dir}/events.parquet"))


# --- generator and experiments ----------------------------------------------------------------------------------------


@query(sql.GENERATED_EVENTS)
def generated_events(spark, sf_dir):
    """Totals of the generated notifications, and a checksum of their paths."""
    rows = generator.generate_events(_space(spark, sf_dir), 0.1)
    return rows.agg(F.count("*").alias("events"), F.count_distinct("object_key").alias("objects"), F.sum(F.col("t_us") - generator.BASE_US).alias("sum_t_us"), F.sum(md5_mod(F.col("object_key"), 1_000_003)).alias("checksum"))


@query(sql.PARTITION_SPACE)
def partition_space(spark, sf_dir):
    rows = store(_space(spark, sf_dir), "space")
    ends = rows.agg(F.count_distinct("partition_key").alias("partitions"), F.min("partition_key").alias("first"), F.max("partition_key").alias("last"))
    return ends.withColumn("scan_requests", F.lit(generator.scan_requests(rows)).cast("long"))


def coalescing_columns(rows: DataFrame) -> DataFrame:
    return rows.select("f", "delta_p", "raw_events", "coalesced", "committed", "requests", *[F.round(c, 6).alias(c) for c in ("alpha_eff", "reduction", "daily_cost")])


@query(sql.coalescing(FRACTIONS))
def coalescing_ratio(spark, sf_dir):
    return coalescing_columns(metrics.coalescing(_space(spark, sf_dir), FRACTIONS))


@query(sql.coalescing_jitter(FRACTIONS[:4], 0.5))
def coalescing_ratio_jitter(spark, sf_dir):
    rows = metrics.coalescing(_space(spark, sf_dir), FRACTIONS[:4], miss_rate=0.5)
    return rows.select("f", "delta_p", "raw_events", "committed", "requests", F.round("alpha_eff", 6).alias("alpha_eff"))


@query(sql.CONVERGENCE)
def convergence_latency(spark, sf_dir):
    rows = metrics.convergence(_space(spark, sf_dir), [1, 5, 10, 30, 60, 120])
    return rows.select("window_s", "commits", *[F.round(c, 3).alias(c) for c in ("median", "p95", "p99")])


@query(sql.drop_sweep(DROPS))
def drop_sweep(spark, sf_dir):
    return metrics.drop_sweep(_space(spark, sf_dir), DROPS, 0.1).withColumn("daily_cost", F.round("daily_cost", 6))


@query(sql.LATER_EPOCH)
def later_epoch(spark, sf_dir):
    return generator.later_epoch(_space(spark, sf_dir)).select("t_us", "op", "object_key")


@query(sql.SCRIPTED_EPOCHS)
def scripted_epochs(spark, sf_dir):
    """The catalog after each quarter of the events, by number, taken as one micro-batch."""
    rows = envelopes.read(spark, sf_dir)
    most = rows.agg(F.max("seq")).first()[0] or 0
    return catalog_by_epoch(store(rows.withColumn("epoch", F.floor(F.col("seq") * 4 / (most + 1))), "epochs"), 4)


def catalog_by_epoch(rows: DataFrame, epochs: int) -> DataFrame:
    """The catalog after each epoch of envelopes, every epoch flushed by force and committed on what the one before it left."""
    known, out = metrics._no_catalog(rows.sparkSession), None
    # the last operation on each object in each epoch, so that an epoch's storage is folded from these and not from all events before it
    last = store(inventory.last_operations(intents.kept(rows), "epoch"), "operations")
    for epoch in range(epochs):
        live = store(inventory.live_inventory(last.where(F.col("epoch") <= epoch)), "live")
        results = commit.apply(sessions.reconcile(intents.candidate_intents(rows.where(F.col("epoch") == epoch)), CONFIG), known, live)
        known = store(commit.catalog_after(known, results), "catalog")
        now = known.select(F.lit(epoch).alias("epoch"), "tenant_id", "partition_key")
        out = now if out is None else out.unionByName(now)
    return out
