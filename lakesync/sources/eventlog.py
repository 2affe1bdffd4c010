"""A partitioned log of notifications as files, and a streaming source with offsets over it.

`append` routes messages by the md5 of their key, gives each partition's messages the offsets after its last one, and writes them
in segments of a fixed number of offsets; a manifest entry, written last, makes the append visible. Appending is by one writer.
An append that failed leaves no entry, and doing it again overwrites its files.

The source `notifications` reads a log as a stream: its offsets are those of the partitions, each segment that a micro-batch needs is a
task of its own, and `maxOffsetsPerPartition` bounds a batch. `startingOffsets` is `earliest`, `latest` or JSON of a
position for each partition, and counts only for a new query; afterwards Spark's checkpoint decides. The planned end of the last
batch is kept under the reader's name in the log, as admission needs it after a restart. `lag` reads positions from the progress of a query.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from lakesync.functions.hashing import md5_mod
from lakesync.scratch import store

SCHEMA = "partition int, offset long, seq long, key string, value string"
_COLUMNS = [field.split()[0] for field in SCHEMA.split(", ")]
SEGMENT = 1_000_000


def numbered(messages: DataFrame, partitions: int, span: int = 1_000_000) -> DataFrame:
    """messages (seq, key, ...) with partition (md5 of the key) and offset (1, 2, 3 ... by seq in each partition).

    A partition's rows are numbered in spans of seq, and each span starts where those before it end, so a log with few
    partitions is still numbered by many tasks.
    """
    routed = messages.withColumn("partition", md5_mod(F.col("key"), partitions)).withColumn("span", F.floor(F.col("seq") / span))
    sizes = routed.groupBy("partition", "span").agg(F.count("*").alias("n"))
    before = sizes.select("partition", "span", (F.sum("n").over(Window.partitionBy("partition").orderBy("span")) - F.col("n")).alias("before"))
    placed = routed.withColumn("r", F.row_number().over(Window.partitionBy("partition", "span").orderBy("seq")))
    return placed.join(before, ["partition", "span"]).withColumn("offset", F.col("before") + F.col("r")).drop("span", "before", "r")


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def manifest(path: str) -> list[dict]:
    """append, partition, first, end, segment of all appends: as many entries as appends times partitions."""
    from pyarrow import fs

    files, base = _folder(path)
    found = files.get_file_info(fs.FileSelector(f"{base}/manifest", allow_not_found=True))
    out = []
    for f in sorted(found, key=lambda f: f.base_name):
        with files.open_input_stream(f.path) as stream:
            out += json.loads(stream.read())
    return out


def ends(path: str) -> dict[int, int]:
    """The last offset of each partition."""
    out: dict[int, int] = {}
    for entry in manifest(path):
        out[entry["partition"]] = max(out.get(entry["partition"], 0), entry["end"])
    return out


def append(messages: DataFrame, path: str, partitions: int, segment: int = SEGMENT, span: int = 1_000_000) -> None:
    """Write messages (seq, key, value) behind what the log holds. The number of partitions stays what it was."""
    spark = messages.sparkSession
    before, number = ends(path), len({e["append"] for e in manifest(path)})
    if before and set(before) != set(range(partitions)):
        raise ValueError("a log keeps its number of partitions")
    first = F.element_at(F.lit([before.get(p, 0) for p in range(partitions)]), F.col("partition") + 1)
    rows = numbered(messages, partitions, span).withColumn("offset", F.col("offset") + first).select("partition", "offset", "seq", "key", "value")
    rows.withColumns({"p": F.col("partition"), "s": F.floor((F.col("offset") - 1) / segment)}).write.partitionBy("p", "s").mode("overwrite").parquet(f"{path}/appends/append={number}")
    held = spark.read.schema(SCHEMA).parquet(f"{path}/appends/append={number}").groupBy("partition").agg(F.max("offset").alias("end")).collect()  # a row a partition
    reached = before | {r.partition: r.end for r in held}
    entries = [{"append": number, "partition": p, "first": before.get(p, 0) + 1, "end": reached.get(p, 0), "segment": segment} for p in range(partitions)]
    files, base = _folder(path)
    files.create_dir(f"{base}/manifest", recursive=True)
    with files.open_output_stream(f"{base}/manifest/{number:08d}.json") as out:
        out.write(json.dumps(entries).encode())


def read(spark: SparkSession, path: str) -> DataFrame:
    """All visible messages of a log."""
    numbers = sorted({e["append"] for e in manifest(path)})
    folders = [f"{path}/appends/append={n}" for n in numbers]
    if not folders:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("basePath", f"{path}/appends").parquet(*folders).select(*_COLUMNS)


@dataclass
class Segment(InputPartition):
    """The offsets from low to high of one segment's files."""

    folder: str
    low: int
    high: int


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.name = options["path"], options.get("reader", "reader")
        self.start = options.get("startingOffsets", "earliest")
        self.most = int(options.get("maxOffsetsPerPartition", 0)) or None
        self.at: dict[str, int] | None = None

    def _note(self) -> str:
        return f"{_folder(self.path)[1]}/readers/{self.name}.json"

    def initialOffset(self) -> dict:
        last = ends(self.path)
        if self.start == "earliest":
            start = dict.fromkeys(last, 0)
        elif self.start == "latest":
            start = last
        else:
            start = {p: int(json.loads(self.start).get(str(p), 0)) for p in last}
        self.at = {str(p): n for p, n in start.items()}
        self._keep(self.at)
        return self.at

    def latestOffset(self) -> dict:
        if self.at is None:
            from pyarrow import fs

            files = _folder(self.path)[0]
            if files.get_file_info(self._note()).type == fs.FileType.File:
                with files.open_input_stream(self._note()) as f:
                    self.at = json.loads(f.read())
            else:
                self.initialOffset()
        last = ends(self.path)
        reach = lambda p, end: end if self.most is None else min(end, self.at.get(str(p), 0) + self.most)
        self.at = {str(p): max(reach(p, end), self.at.get(str(p), 0)) for p, end in sorted(last.items())}
        return self.at

    def _keep(self, at: dict) -> None:
        files = _folder(self.path)[0]
        files.create_dir(self._note().rpartition("/")[0], recursive=True)
        with files.open_output_stream(self._note()) as out:
            out.write(json.dumps(at).encode())

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        self._keep(end)
        self.at = {p: max(n, (self.at or {}).get(p, 0)) for p, n in end.items()}
        out = []
        for e in manifest(self.path):
            low = max(e["first"], start.get(str(e["partition"]), 0) + 1)
            high = min(e["end"], end.get(str(e["partition"]), 0))
            for s in range((low - 1) // e["segment"], (high - 1) // e["segment"] + 1) if low <= high else ():
                out.append(Segment(f"{self.path}/appends/append={e['append']}/p={e['partition']}/s={s}", low, high))
        return out

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        files, folder = _folder(partition.folder)
        rows = ds.dataset(folder, filesystem=files, format="parquet", exclude_invalid_files=False)
        offset = ds.field("offset")
        for batch in rows.to_batches(columns=_COLUMNS, filter=(offset >= partition.low) & (offset <= partition.high)):
            if batch.num_rows:
                yield batch


class NotificationSource(DataSource):
    """Options: path, reader, startingOffsets, maxOffsetsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "notifications"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options)


def stream(spark: SparkSession, path: str, reader: str, start: str = "earliest", most: int | None = None) -> DataFrame:
    spark.dataSource.register(NotificationSource)
    rows = spark.readStream.format("notifications").option("path", path).option("reader", reader).option("startingOffsets", start)
    return (rows.option("maxOffsetsPerPartition", most) if most else rows).load()


def positions(query: StreamingQuery) -> dict[int, int]:
    """Where a query has got to in each partition, by its own progress."""
    told = [json.loads(p.json)["sources"][0]["endOffset"] for p in query.recentProgress]
    at = next((e for e in reversed(told) if e), {})
    return {int(p): int(n) for p, n in (json.loads(at) if isinstance(at, str) else at).items()}


def lag(spark: SparkSession, path: str, at: dict[int, int]) -> DataFrame:
    """partition, produced, position, lag."""
    rows = [(p, end, at.get(p, 0), end - at.get(p, 0)) for p, end in sorted(ends(path).items())]
    return spark.createDataFrame(rows, "partition int, produced long, position long, lag long")


def poll(spark: SparkSession, path: str, folder: str, reader: str, batches: int, start: str = "earliest", most: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """The messages that a query under this checkpoint reads in so many more micro-batches, and its positions then.

    Each batch is a run of its own, so a batch more is a restart more.
    """
    at: dict[int, int] = {}
    for _ in range(batches):
        query = stream(spark, path, reader, start, most).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        at = positions(query) or at
    return spark.read.schema(SCHEMA).parquet(f"{folder}/out"), at
