"""The verified commit, set-based: each effective intent against the catalog and storage, in one decision.

A flush has at most one intent for a key, a commit changes no storage and only its own key's entry, so all decisions of a
flush are two joins, the proofs' join and one expression.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesync.operators.inventory import head_proofs, list_prefixes
from lakesync.scratch import store

KEY = ["tenant_id", "table_fqn", "partition_key"]


class Storage(Protocol):
    """What a commit asks of storage."""

    def heads(self, effective: DataFrame, key: list[str]) -> DataFrame:
        """key, first_hit, heads."""

    def listed(self, prefixes: DataFrame) -> DataFrame:
        """prefixes with non_empty."""


_CALLS = ("head", "list", "create", "drop")


def _outcome(status: str, reason: str | None, heads: Column, lists: int | Column) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"), heads.cast("long").alias("heads"), (F.lit(lists) if isinstance(lists, int) else lists).cast("long").alias("lists"))


def decide(rows: DataFrame, enable_drop: bool = True) -> DataFrame:
    """rows (kind, in_catalog, first_hit, heads, non_empty, fault_head/list/create/drop) with status, reason, heads, lists, in_catalog_after.

    Faults are ``transient`` or ``fatal`` (null: none) and hit the first call of their kind.
    """
    there, hit, full, kind = F.col("in_catalog"), F.col("first_hit").isNotNull(), F.col("non_empty"), F.col("kind")
    fault = {c: F.col(f"fault_{c}") for c in _CALLS}
    zero, heads = F.lit(0), F.coalesce("heads", F.lit(0))
    head_fails = fault["head"].isNotNull() & (heads > 0)
    listed = F.when(hit, F.lit(0)).otherwise(F.lit(1))
    created = (
        F.when(fault["create"] == "transient", _outcome("RETRY", "catalog_transient", heads, listed))
        .when(fault["create"] == "fatal", _outcome("ERROR", "catalog_fatal", heads, listed))
        .otherwise(_outcome("APPLIED", None, heads, listed))
    )
    # a stale entry is cleared with a drop of its own, whose faults count like any other's
    cleared = (
        F.when(fault["drop"] == "transient", _outcome("RETRY", "catalog_transient", zero, 1))
        .when(fault["drop"] == "fatal", _outcome("ERROR", "catalog_fatal", zero, 1))
        .otherwise(_outcome("RETRY", "stale_catalog_entry_cleared", zero, 1))
    )
    known = (
        F.when(F.lit(not enable_drop), _outcome("NOOP", "already_exists", zero, 0))
        .when(fault["list"].isNotNull(), _outcome("RETRY", "storage_transient", zero, 1))
        .when(full, _outcome("NOOP", "already_exists_verified", zero, 1))
        .otherwise(cleared)
    )
    new = (
        F.when(head_fails, _outcome("RETRY", "storage_transient", F.lit(1), 0))
        .when(hit, created)
        .when(fault["list"].isNotNull(), _outcome("RETRY", "storage_transient", heads, 1))
        .when(full, created)
        .otherwise(_outcome("RETRY", "not_visible_yet", heads, 1))
    )
    drop = (
        F.when(F.lit(not enable_drop), _outcome("NOOP", "drop_disabled", zero, 0))
        .when(~there, _outcome("NOOP", "not_found", zero, 0))
        .when(fault["list"].isNotNull(), _outcome("RETRY", "storage_transient", zero, 1))
        .when(full, _outcome("NOOP", "still_non_empty", zero, 1))
        .when(fault["drop"] == "transient", _outcome("RETRY", "catalog_transient", zero, 1))
        .when(fault["drop"] == "fatal", _outcome("ERROR", "catalog_fatal", zero, 1))
        .otherwise(_outcome("APPLIED", None, zero, 1))
    )
    result = F.when(kind == "ADD", F.when(there, known).otherwise(new)).when(kind == "DROP", drop).otherwise(_outcome("ERROR", "unknown_kind", zero, 0))
    out = rows.withColumn("result", result).drop("heads").select("*", "result.*").drop("result")
    gone = ((kind == "DROP") & (F.col("status") == "APPLIED")) | (F.col("reason") == "stale_catalog_entry_cleared")
    return out.withColumn("in_catalog_after", F.when((kind == "ADD") & (F.col("status") == "APPLIED"), True).when(F.coalesce(gone, F.lit(False)), False).otherwise(there))


def apply(effective: DataFrame, catalog: DataFrame, inventory: DataFrame | Storage, enable_drop: bool = True, faults: DataFrame | None = None) -> DataFrame:
    """Results of a flush: effective intents with status, reason, heads, lists, in_catalog and in_catalog_after.

    inventory: the live objects, or a storage that answers HEAD and LIST itself. faults: partition_key, call (head, list, create or
    drop), error. Only keys of the flush meet catalog and storage.
    """
    if isinstance(inventory, DataFrame):
        heads_of, listed_of = lambda rows: head_proofs(rows, inventory, KEY), lambda asked: list_prefixes(asked, inventory)
    else:
        heads_of, listed_of = lambda rows: inventory.heads(rows, KEY), inventory.listed
    effective = store(effective, "flush")  # small next to what it comes from, and read by each of the lookups
    rows = effective.join(catalog.select(*KEY).distinct().withColumn("in_catalog", F.lit(True)), KEY, "left").withColumn("in_catalog", F.coalesce("in_catalog", F.lit(False)))
    rows = rows.join(heads_of(effective.where(F.col("kind") == "ADD")), KEY, "left")
    rows = store(rows, "lookups")
    # storage is listed only where a decision asks for it: known keys, drops, and additions without a proof that exists
    asked = rows.where(F.col("in_catalog") | (F.col("kind") != "ADD") | F.col("first_hit").isNull()).select("tenant_id", "partition_prefix").distinct()
    listed = listed_of(asked).where("non_empty")
    rows = rows.join(listed, ["tenant_id", "partition_prefix"], "left").withColumn("non_empty", F.coalesce("non_empty", F.lit(False)))
    if faults is None:
        for call in _CALLS:
            rows = rows.withColumn(f"fault_{call}", F.lit(None).cast("string"))
    else:
        wide = faults.groupBy("partition_key").agg(*[F.max(F.when(F.col("call") == c, F.col("error"))).alias(f"fault_{c}") for c in _CALLS])
        rows = rows.join(wide, "partition_key", "left")
    return decide(rows, enable_drop).drop("first_hit", "non_empty", *[f"fault_{c}" for c in _CALLS])


def catalog_after(catalog: DataFrame, results: DataFrame) -> DataFrame:
    """The catalog once the results have been applied: only keys that the flush touched change."""
    kept = catalog.join(results.where(~F.col("in_catalog_after")), KEY, "left_anti")
    added = results.where(F.col("in_catalog_after") & ~F.col("in_catalog")).select(*KEY, F.col("partition_prefix").alias("location"))
    return kept.select(*KEY, "location").unionByName(added)


def outcome_counts(results: DataFrame) -> DataFrame:
    """Results and requests by kind, status and reason."""
    return results.groupBy("kind", "status", "reason").agg(F.count("*").alias("n"), F.sum("heads").alias("heads"), F.sum("lists").alias("lists"))
