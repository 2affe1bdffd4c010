"""The stream gives what the batch gives, and the catalog of Spark follows."""

import shutil

from pyspark.sql import functions as F

from lakesync.config import SyncConfig
from lakesync.operators import catalog, commit, intents, inventory, sessions
from lakesync.plans.streamed import streamed_sessions
from lakesync.sources import envelopes, generator
from lakesync.streaming.worker import Tables, commit_batch, drain, note_objects

SF = "/root/testdata/sf0.001"
COLUMNS = [*sessions.KEY, "sid", "kind", "n", "last_kind", "first_us", "last_us", "flush_us", "proof_keys", "partition_prefix"]


def test_stream_equals_batch(spark):
    config = SyncConfig(window=3600, grace=10, cap=7200)
    own = intents.candidate_intents(envelopes.read(spark, SF))
    batch = sessions.effective_intents(sessions.assign_sessions(own, config), config).select(*COLUMNS)
    stream = streamed_sessions(spark, SF, config).select(*COLUMNS)
    assert batch.count() > 100 and batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0


def test_worker_over_scripted_epochs_with_a_repeated_batch(spark, tmp_path):
    rows, config, tables, seen = generator.scripted_epochs(spark), SyncConfig(), Tables(spark, str(tmp_path)), []
    for version in (0, 1, 1, 2, 3):  # a batch that is run again changes nothing
        batch = rows.where(F.col("epoch") == version)
        note_objects(tables, batch, version)
        commit_batch(tables, sessions.reconcile(intents.candidate_intents(batch), config), config, version, now_s=1000.0 + version)
        seen.append({r.partition_key.rsplit("=")[-1] for r in tables.latest("catalog").collect()})
    us = {"boston", "miami", "seattle"}
    assert seen == [us, us, us, us | {"bangalore"}, {"boston", "miami", "bangalore"}]
    assert tables.latest("dead").count() == 0 and tables.latest("queue").count() == 0


def test_worker_retries_then_gives_up(spark, tmp_path):
    config, tables = SyncConfig(max_retries=3), Tables(spark, str(tmp_path))
    added = generator.scripted_epochs(spark).where((F.col("epoch") == 0) & F.col("object_key").contains("boston"))
    flushed = sessions.reconcile(intents.candidate_intents(added), config)
    for version in range(6):  # nothing was noted in the inventory, so nothing shows
        commit_batch(tables, flushed if not version else flushed.limit(0), config, version, now_s=100.0 * version)
    (dead,) = tables.latest("dead").collect()
    assert dead.reason == "not_visible_yet" and dead.attempt == 4 and tables.latest("catalog").count() == 0


def test_worker_succeeds_on_a_retry(spark, tmp_path):
    config, tables = SyncConfig(max_retries=3), Tables(spark, str(tmp_path))
    added = generator.scripted_epochs(spark).where((F.col("epoch") == 0) & F.col("object_key").contains("boston"))
    flushed = sessions.reconcile(intents.candidate_intents(added), config)
    commit_batch(tables, flushed, config, 0, now_s=0.0)
    note_objects(tables, added, 1)
    commit_batch(tables, flushed.limit(0), config, 1, now_s=100.0)
    assert tables.latest("catalog").count() == 1 and tables.latest("queue").count() == 0 and tables.latest("dead").count() == 0


def test_catalog_of_spark_follows_and_repair_agrees(spark, tmp_path):
    root = f"{tmp_path}/sales"
    spark.sql("DROP TABLE IF EXISTS sales")
    spark.sql(f"CREATE TABLE sales (x INT, country STRING, city STRING) USING parquet PARTITIONED BY (country, city) LOCATION '{root}'")
    rows, config = generator.scripted_epochs(spark), SyncConfig()
    known = spark.createDataFrame([], "tenant_id string, table_fqn string, partition_key string, location string")
    for epoch in range(4):
        results = commit.apply(sessions.reconcile(intents.candidate_intents(rows.where(F.col("epoch") == epoch)), config), known, inventory.live_inventory(rows.where(F.col("epoch") <= epoch)))
        catalog.sync_table(spark, "sales", results, root)
        catalog.sync_table(spark, "sales", results, root)  # again: no error, no change
        known = spark.createDataFrame(commit.catalog_after(known, results).collect(), known.schema)
    want = {"country=us/city=boston", "country=us/city=miami", "country=india/city=bangalore"}
    assert {r.partition_key for r in catalog.table_partitions(spark, "sales").collect()} == want
    for key in want:
        spark.range(1).select(F.col("id").cast("int").alias("x")).write.mode("overwrite").parquet(f"{root}/{key}")
    shutil.rmtree(f"{root}/country=us/city=seattle", ignore_errors=True)  # ADD PARTITION makes the folder, a drop leaves it
    spark.sql("MSCK REPAIR TABLE sales SYNC PARTITIONS")
    assert {r.partition_key for r in catalog.table_partitions(spark, "sales").collect()} == want
    spark.sql("DROP TABLE sales")


def test_processing_time_flush_needs_no_new_data(spark, tmp_path):
    from lakesync.streaming.buffer import flushed_sessions

    config = SyncConfig(window=0.5, grace=0.2)
    now = spark.sql("SELECT unix_micros(current_timestamp()) AS t").first().t
    rows = spark.createDataFrame([(1, now, "t", "f", "k=1", "r/k=1/", "ADD_CANDIDATE", "p", "p")], "seq long, t_us long, tenant_id string, table_fqn string, partition_key string, partition_prefix string, kind string, proof string, object_key string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = flushed_sessions(source, config, event_time=False).writeStream.format("memory").queryName("flushed").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(40):
            if spark.sql("SELECT * FROM flushed").count():
                break
            query.awaitTermination(1)
        assert spark.sql("SELECT kind, n FROM flushed").collect()[0] == ("ADD", 1)
    finally:
        query.stop()


def test_worker_as_streams(spark, tmp_path):
    """Both queries of the worker over files of envelopes; the catalog is what live objects say."""
    from lakesync.schema import ENVELOPE
    from lakesync.streaming.worker import writers

    rows, config = envelopes.read(spark, SF).where("seq < 400"), SyncConfig(window=900, grace=10)
    rows.where("seq < 200").coalesce(1).write.parquet(f"{tmp_path}/in")
    rows.where("seq >= 200").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    end = rows.agg((F.max("t_us") + 10 * config.cap_us).alias("t_us")).select(F.lit(-1).cast("long").alias("seq"), "t_us", F.lit("end").alias("tenant_id"), F.lit("OBJECT_CREATED").alias("op"), F.lit("warehouse/sales/end=1/x.orc").alias("object_key"))
    end.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for writer in writers(spark, source, f"{tmp_path}/job", config):
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        assert sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators) == 0
    tables = Tables(spark, f"{tmp_path}/job")
    live = catalog.converged(inventory.live_inventory(intents.kept(rows))).select("tenant_id", "partition_key")
    got = tables.latest("catalog").where("tenant_id <> 'end'").select("tenant_id", "partition_key")
    # storage was complete before the first commit, so an emptied partition never shows
    assert got.exceptAll(live).count() == 0 and live.exceptAll(got).count() == 0
    assert tables.latest("audit").count() > 0


def test_a_repeated_batch_reads_the_inventory_that_it_read_before(spark, tmp_path):
    config, tables = SyncConfig(max_retries=3), Tables(spark, str(tmp_path))
    rows = generator.scripted_epochs(spark)
    added = rows.where((F.col("epoch") == 0) & F.col("object_key").contains("seattle"))
    flushed = sessions.reconcile(intents.candidate_intents(added), config)
    note_objects(tables, added, 0)
    once = {tuple(r) for r in commit_batch(tables, flushed, config, 0, now_s=0.0).collect()}
    note_objects(tables, rows.where("epoch = 3"), 1)  # the objects are gone before the batch is run again
    assert {tuple(r) for r in commit_batch(tables, flushed, config, 0, now_s=0.0).collect()} == once
    assert tables.latest("catalog").count() == 1


def test_drain_leaves_nothing_waiting_and_old_versions_go(spark, tmp_path):
    config, tables = SyncConfig(max_retries=2), Tables(spark, str(tmp_path))
    added = generator.scripted_epochs(spark).where("epoch = 0")
    note_objects(tables, added.where(~F.col("object_key").contains("boston")), 0)
    after = drain(tables, intents.candidate_intents(added), config, 0, now_s=0.0)
    assert after == 3 and tables.latest("queue").count() == 0
    assert {r.partition_key for r in tables.latest("catalog").collect()} == {"country=us/city=miami", "country=us/city=seattle"}
    assert [r.partition_key for r in tables.latest("dead").collect()] == ["country=us/city=boston"] and tables.versions("catalog") == [1, 2]


def test_partition_values_with_quotes(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS quoted")
    spark.sql(f"CREATE TABLE quoted (x INT, city STRING) USING parquet PARTITIONED BY (city) LOCATION '{tmp_path}/quoted'")
    names = ["city=o'brien", "city=a\\b", "city=x'); DROP TABLE quoted; --"]
    results = spark.createDataFrame([(n, False, True) for n in names], "partition_key string, in_catalog boolean, in_catalog_after boolean")
    assert catalog.sync_table(spark, "quoted", results, f"{tmp_path}/quoted") == {"added": 3}
    assert catalog.table_partitions(spark, "quoted").count() == 3
    gone = results.select("partition_key", F.lit(True).alias("in_catalog"), F.lit(False).alias("in_catalog_after"))
    assert catalog.sync_table(spark, "quoted", gone, f"{tmp_path}/quoted") == {"dropped": 3} and catalog.table_partitions(spark, "quoted").count() == 0
    spark.sql("DROP TABLE quoted")


def test_changes_and_whole_versions_give_the_same_state(spark, tmp_path, monkeypatch):
    from lakesync.streaming import worker

    monkeypatch.setattr(worker, "WHOLE_EVERY", 2)
    rows, tables = envelopes.read(spark, SF).where("seq < 500"), Tables(spark, str(tmp_path))
    for version in range(4):
        batch = rows.where(F.col("seq").between(125 * version, 125 * version + 124))
        note_objects(tables, batch, version)
        note_objects(tables, batch, version)  # again: no change
        tables.prune("inventory", version)
    want = inventory.live_inventory(intents.kept(rows))
    got = tables.latest("inventory").where("live").select("tenant_id", "object_key")
    assert got.count() == want.count() > 10 and got.exceptAll(want).count() == 0
    assert tables.versions("inventory-whole") == [2] and tables.versions("inventory") == [3]
    early = tables.latest("inventory", 3).where("live").select("tenant_id", "object_key")
    assert early.exceptAll(inventory.live_inventory(intents.kept(rows.where("seq < 375")))).count() == 0


def test_counters_of_a_stream_are_those_of_its_results(spark, tmp_path):
    from lakesync.operators.metrics import observed, outcome_counters

    schema = "status string, heads long, lists long"
    for i, rows in enumerate([[("APPLIED", 1, 0), ("RETRY", 3, 1)], [("NOOP", 2, 0)], [(None, 1, 0), ("ERROR", 0, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).observe("outcomes", *outcome_counters())
    run = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    run.awaitTermination()
    batches = [p.observedMetrics["outcomes"] for p in run.recentProgress if p.numInputRows]
    results, seen = observed(spark.read.schema(schema).parquet(str(tmp_path / "in")))
    results.write.format("noop").mode("overwrite").save()
    assert len(batches) == 3 and seen.get == {"results": 5, "applied": 1, "noop": 1, "retry": 1, "error": 1, "heads": 7, "lists": 2}
    assert {name: sum(b[name] for b in batches) for name in seen.get} == seen.get
    results, seen = observed(spark.createDataFrame([], schema))
    results.write.format("noop").mode("overwrite").save()
    assert set(seen.get.values()) == {0}
