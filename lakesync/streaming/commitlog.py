"""One catalog for several writers: a log of commits, in which each place is taken by one writer only.

A writer decides its flush against the catalog as some version left it, writes what changes as Parquet, and puts an entry at the next
place of the log, which succeeds only if nobody else has. A writer that comes too late looks at what the others have changed since: keys of
its flush that are not among those stand as decided, the others are decided again on the newer catalog. So two writers give what they would give one after
the other, and one of those that compete always succeeds.

Keys are dealt into buckets by their md5. Changes and whole versions lie in a folder for each bucket, so a flush reads the buckets of
its own keys only. The number of buckets is fixed when a log is made; it should be so large that a flush has keys in few of them.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesync.functions.hashing import md5_mod
from lakesync.scratch import store

KEY = ["tenant_id", "table_fqn", "partition_key"]
_ROW = "tenant_id string, table_fqn string, partition_key string, location string, gone boolean"
_ENTRY = "version long, commit string, buckets array<int>, writers map<string, array<long>>"
#: Of so many versions, one is also written whole.
WHOLE_EVERY = 16

#: Results of a flush (in_catalog, in_catalog_after) from its intents and the catalog.
Decide = Callable[[DataFrame, DataFrame], DataFrame]


def _same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the key, where two nulls are one."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in KEY]).distinct()
    same = F.lit(True)
    for k in KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(other, same, how)


@dataclass
class CommitLog:
    spark: SparkSession
    folder: str
    buckets: int = 64

    # --- entries ------------------------------------------------------------------------------------------------------

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, pattern: str, of: Callable) -> list[int]:
        path, files = self._path(pattern)
        return sorted(int(of(f.getPath())) for f in files.globStatus(path) or [])

    def versions(self) -> list[int]:
        return self._numbers("log/*.json", lambda p: p.getName().removesuffix(".json"))

    def last(self) -> int:
        """The newest version; -1 of an empty log."""
        return max(self.versions(), default=-1)

    def entries(self, above: int, upto: int) -> list:
        """The entries of versions above one and up to another: file names, buckets and writers, no rows."""
        paths = [f"{self.folder}/log/{v:020d}.json" for v in range(above + 1, upto + 1)]
        return sorted(self.spark.read.schema(_ENTRY).json(paths).collect(), key=lambda e: e.version) if paths else []

    def put(self, version: int, entry: dict) -> bool:
        """Put an entry at a place that nobody has; whether that is so. HDFS renames onto no file that is there; on a local disk a hard link does the same."""
        target, files = self._path(f"log/{version:020d}.json")
        draft, _ = self._path(f"drafts/{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(entry | {"version": version}).encode()))
        out.close()
        files.mkdirs(target.getParent())
        try:
            if files.getScheme() == "file":
                os.link(*[urlparse(p.toString()).path for p in (draft, target)])
            else:
                context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
                none = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                context.rename(draft, target, none)
        except Exception:
            if not files.exists(target):
                raise
            return False
        finally:
            files.delete(draft, False)
        return True

    # --- rows ---------------------------------------------------------------------------------------------------------

    def bucket(self) -> Column:
        return md5_mod(F.concat_ws("#", *[F.coalesce(k, F.lit("")) for k in KEY]), self.buckets)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows' keys; as many as there are buckets at most."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def _wholes(self) -> list[int]:
        return self._numbers("whole/version=*/_SUCCESS", lambda p: p.getParent().getName().removeprefix("version="))

    def changes(self, above: int, upto: int, buckets: list[int] | None = None) -> DataFrame:
        """What versions above one and up to another have changed, with the version (at), of some buckets or all."""
        places, paths = {}, []
        for e in self.entries(above, upto):
            places[e.commit] = e.version
            paths += [f"{self.folder}/changes/commit={e.commit}/bucket={b}" for b in e.buckets if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], f"{_ROW}, at long")
        rows = self.spark.read.schema(f"{_ROW}, commit string, bucket int").option("basePath", f"{self.folder}/changes").parquet(*paths)
        at = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])
        return rows.withColumn("at", at[F.col("commit")].cast("long")).drop("commit", "bucket")

    def snapshot(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The catalog as a version leaves it (the newest if none is given), of some buckets or all: key and location."""
        version = self.last() if version is None else version
        whole = max((v for v in self._wholes() if v <= version), default=-1)
        rows = self.changes(whole, version, buckets)
        folder = f"{self.folder}/whole/version={whole}"
        there = self._numbers(f"whole/version={whole}/bucket=*", lambda p: p.getName().removeprefix("bucket=")) if whole >= 0 else []
        if paths := [f"{folder}/bucket={b}" for b in there if buckets is None or b in buckets]:
            base = self.spark.read.schema(f"{_ROW}, bucket int").option("basePath", folder).parquet(*paths)
            rows = rows.unionByName(base.drop("bucket").withColumn("at", F.lit(whole).cast("long")))
        latest = rows.groupBy(*KEY).agg(F.max_by(F.struct("location", "gone"), "at").alias("r")).where(~F.col("r.gone"))
        return latest.select(*KEY, "r.location")

    def write_whole(self, version: int) -> None:
        rows = self.snapshot(version).withColumn("gone", F.lit(False)).withColumn("bucket", self.bucket())
        rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/whole/version={version}")

    def _write(self, results: DataFrame) -> dict:
        """The changes of results as files of a commit; nothing is seen of them before its entry is put."""
        moved = results.where(F.col("in_catalog") != F.col("in_catalog_after"))
        rows = moved.select(*KEY, F.col("partition_prefix").alias("location"), (~F.col("in_catalog_after")).alias("gone"), self.bucket().alias("bucket"))
        commit = uuid.uuid4().hex
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/changes/commit={commit}")
        return {"commit": commit, "buckets": self.touched(moved)}

    # --- commits ------------------------------------------------------------------------------------------------------

    def commit(self, intents: DataFrame, decide: Decide, writer: str, batch: int) -> tuple[int, DataFrame]:
        """Decide a flush of at most one intent for each key and put its changes into the log: the version, and the results.

        A batch that its writer has put already is not put again; its results are those of the catalog that it met.
        """
        intents = store(intents, "flush")
        own, base = self.touched(intents), self.last()
        done = self._writers(base).get(writer)
        if done and done[0] >= batch:
            if done[0] > batch:
                raise ValueError(f"writer {writer} has put batch {done[0]} already, this is {batch}")
            return done[1], store(decide(intents, self.snapshot(done[1] - 1, own)), "results")
        results = store(decide(intents, self.snapshot(base, own)), "results")
        written = self._write(results)
        while True:
            version = base + 1
            if self.put(version, written | {"writers": self._writers(base) | {writer: [batch, version]}}):
                if version % WHOLE_EVERY == 0:
                    self.write_whole(version)
                return version, results
            newest = self.last()
            clash = store(_same(intents, self.changes(base, newest, own), "left_semi"), "clash")
            if not clash.isEmpty():
                again = decide(clash, self.snapshot(newest, self.touched(clash)))
                results = store(_same(results, clash, "left_anti").unionByName(again), "results")
                lost, files = self._path(f"changes/commit={written['commit']}")
                written = self._write(results)
                files.delete(lost, True)
            base = newest

    def _writers(self, version: int) -> dict[str, list[int]]:
        """For each writer its last batch, and the version that it was put at, as of a version."""
        return {w: list(b) for w, b in self.entries(version - 1, version)[0].writers.items()} if version >= 0 else {}
