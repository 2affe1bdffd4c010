"""A real store as what verification asks: HEAD and LIST over files, by tasks.

A store is a folder of any file system that pyarrow knows (local, HDFS, S3, GCS), with one tree for each tenant:
`<root>/<tenant_id>/<object_key>`. Nothing is listed on the driver. A whole listing goes down level by level: the folders found at one
level are the work units of the next, dealt out evenly whatever tree they are in. A LIST of one prefix stops at the first object
that counts. HEADs are sent a batch at a time: the first proofs of all rows, then the second proofs of those still without a
hit, and so on, so a row makes as many requests as it needs and no more.

`FileStore` answers what `FoldedStore` answers from a fold of the notifications; the commit takes either.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesync.config import IGNORED_PREFIXES
from lakesync.operators import inventory as folded
from lakesync.scratch import store

_FOUND = "tenant_id string, path string, is_folder boolean"
#: Rows of a batch that are asked together.
_ASKED = 1_000


class FoldedStore:
    """Storage as the notifications leave it: (tenant_id, object_key) of all live objects."""

    def __init__(self, inventory: DataFrame):
        self.inventory = inventory

    def heads(self, effective: DataFrame, key: list[str]) -> DataFrame:
        return folded.head_proofs(effective, self.inventory, key)

    def listed(self, prefixes: DataFrame) -> DataFrame:
        return folded.list_prefixes(prefixes, self.inventory)


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, _ASKED):
            yield batch.slice(low, _ASKED)


def _inside(files, folder: str) -> list:
    """What is directly in a folder: one LIST. Nothing if it is not there, or an object."""
    from pyarrow import fs

    try:
        return files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    except NotADirectoryError:
        return []


def _has_object(files, folder: str) -> tuple[bool, int]:
    """Whether any object that counts is below a folder, and how many folders were listed to know it."""
    from pyarrow import fs

    ahead, asked = [folder], 0
    while ahead:
        asked += 1
        found = _inside(files, ahead.pop())
        if any(f.type == fs.FileType.File and not f.base_name.startswith(IGNORED_PREFIXES) for f in found):
            return True, asked
        ahead += [f.path for f in found if f.type == fs.FileType.Directory]
    return False, asked


class FileStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def heads(self, effective: DataFrame, key: list[str]) -> DataFrame:
        """key, first_hit (place of the first proof that exists, from 1), heads (requests made) of rows (tenant_id, key, proof_keys)."""
        root = self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            files, base = _open(root)
            for batch in _slices(batches):
                tenants, proofs = batch.column("tenant_id").to_pylist(), batch.column("proof_keys").to_pylist()
                hit: list[int | None] = [None] * len(proofs)
                asked = [0] * len(proofs)
                for place in range(max(map(len, proofs), default=0)):
                    rows = [i for i, p in enumerate(proofs) if hit[i] is None and place < len(p)]
                    for i, info in zip(rows, files.get_file_info([f"{base}/{tenants[i]}/{proofs[i][place]}" for i in rows])):
                        asked[i] += 1
                        if info.type == fs.FileType.File:
                            hit[i] = place + 1
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), pa.array(hit, pa.int64()), pa.array(asked, pa.int64())], names=[*key, "first_hit", "heads"])

        rows = effective.where(F.size("proof_keys") > 0).select(*dict.fromkeys(["tenant_id", *key]), "proof_keys")
        kinds = ", ".join(f"{k} {effective.schema[k].dataType.simpleString()}" for k in key)
        return rows.mapInArrow(run, f"{kinds}, first_hit long, heads long")

    def listed(self, prefixes: DataFrame) -> DataFrame:
        """prefixes (tenant_id, partition_prefix, ...) with non_empty."""
        return self.listings(prefixes).drop("folders")

    def listings(self, prefixes: DataFrame) -> DataFrame:
        """prefixes with non_empty, and folders: how many were listed to know it."""
        root = self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, base = _open(root)
            for batch in _slices(batches):
                found = [_has_object(files, f"{base}/{t}/{p}".rstrip("/")) for t, p in zip(batch.column("tenant_id").to_pylist(), batch.column("partition_prefix").to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f for f, _ in found], pa.bool_()), pa.array([n for _, n in found], pa.int64())], names=[*batch.schema.names, "non_empty", "folders"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema.fields)
        return prefixes.mapInArrow(run, f"{kinds}, non_empty boolean, folders long")

    def level(self, folders: DataFrame) -> DataFrame:
        """tenant_id, path, is_folder of what is directly in the folders (tenant_id, path); paths have no root, and folders end in a slash."""
        root = self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            files, base = _open(root)
            for batch in _slices(batches):
                rows = []
                for tenant, path in zip(batch.column("tenant_id").to_pylist(), batch.column("path").to_pylist()):
                    for f in _inside(files, f"{base}/{tenant}/{path}".rstrip("/")):
                        folder = f.type == fs.FileType.Directory
                        rows.append((tenant, f"{path}{f.base_name}{'/' * folder}", folder))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, (pa.string(), pa.string(), pa.bool_()))], names=["tenant_id", "path", "is_folder"])

        return folders.repartition("path").mapInArrow(run, _FOUND)

    def objects(self, tenants: DataFrame, prefix: str = "") -> tuple[DataFrame, int]:
        """tenant_id, object_key of all objects below a prefix of the tenants' trees, and the number of folders listed."""
        ahead, out, requests = tenants.select("tenant_id", F.lit(prefix).alias("path")).distinct(), None, 0
        while True:
            found = store(self.level(ahead), "level")
            requests += ahead.count()
            files = found.where(~F.col("is_folder")).select("tenant_id", F.col("path").alias("object_key"))
            out = files if out is None else out.unionByName(files)
            ahead = found.where("is_folder").select("tenant_id", "path")
            if ahead.isEmpty():
                return out, requests


def write_objects(inventory: DataFrame, root: str) -> None:
    """Make the objects (tenant_id, object_key) as empty files. Doing it again changes nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(root)
        for batch in batches:
            for tenant, key in zip(batch.column("tenant_id").to_pylist(), batch.column("object_key").to_pylist()):
                path = f"{base}/{tenant}/{key}"
                files.create_dir(path.rpartition("/")[0], recursive=True)
                files.open_output_stream(path).close()
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    inventory.select("tenant_id", "object_key").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def remove_object(root: str, tenant: str, key: str) -> None:
    files, base = _open(root)
    files.delete_file(f"{base}/{tenant}/{key}")
