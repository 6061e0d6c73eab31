"""A topic landed as files: partitions, gapless offsets, consumer groups, read by Spark without a broker.

``path/log/partition=N/`` holds Parquet segments of (offset, key, value, timestamp); ``path/groups/NAME.json`` the offsets
that a consumer group has finished. The data source ``topic_log`` has a batch and a stream reader. Each segment that holds
wanted offsets is one Spark partition, and only its footer is looked at on the driver. Offsets of a stream are ``{partition:
next offset}``, so a query resumes from its checkpoint, and a new query of the same group from what the group finished.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tamis.functions.scalars import col
from tamis.operators.ordered import number_rows
from tamis.sources.tables import Schema, decode_messages

FORMAT = "topic_log"
MESSAGE = "`key` string, `value` string, `partition` int, `offset` bigint, `timestamp` timestamp"


def _system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class Segment(InputPartition):
    def __init__(self, path: str, partition: int, low: int, high: int):
        self.path, self.partition, self.low, self.high = path, partition, low, high


class Log:
    """Segments of a topic and their offsets, from the footers; a segment never changes, so each is looked at once."""

    def __init__(self, path: str):
        self.path = path
        self.known: dict[str, tuple[int, int, int]] = {}

    def refresh(self) -> dict[int, int]:
        """Next offset of every partition."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, base = _system(self.path)
        for info in system.get_file_info(fs.FileSelector(f"{base}/log", recursive=True, allow_not_found=True)):
            folder, name = posixpath.split(info.path)
            if info.path in self.known or not name.endswith(".parquet") or name.startswith((".", "_")) or "/_temporary" in info.path:
                continue
            meta = pq.read_metadata(info.path, filesystem=system)
            at = meta.schema.to_arrow_schema().get_field_index("offset")
            stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
            if stats:
                self.known[info.path] = int(folder.rsplit("=", 1)[1]), min(s.min for s in stats), max(s.max for s in stats)
        ends: dict[int, int] = {}
        for partition, _, last in self.known.values():
            ends[partition] = max(ends.get(partition, 0), last + 1)
        return ends

    def segments(self, start: dict[int, int], end: dict[int, int]) -> list[Segment]:
        out = []
        for path, (partition, first, last) in sorted(self.known.items()):
            low, high = max(first, start.get(partition, 0)), min(last + 1, end.get(partition, 0))
            if low < high:
                out.append(Segment(path, partition, low, high))
        return out


def _messages(root: str, part: Segment | None) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    if part is None:  # Spark asks once where there is no partition
        return

    system, _ = _system(root)
    with system.open_input_file(part.path) as file:
        for batch in pq.ParquetFile(file).iter_batches(batch_size=8192, columns=["key", "value", "offset", "timestamp"]):
            offsets = batch.column("offset")
            batch = batch.filter(pc.and_(pc.greater_equal(offsets, part.low), pc.less(offsets, part.high)))
            if batch.num_rows:
                stamps = batch.column("timestamp").cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))
                columns = [batch.column("key"), batch.column("value"), pa.array([part.partition] * batch.num_rows, pa.int32()), batch.column("offset"), stamps]
                yield pa.RecordBatch.from_arrays(columns, ["key", "value", "partition", "offset", "timestamp"])


def _as_numbers(offsets: dict) -> dict[int, int]:
    return {int(k): int(v) for k, v in offsets.items()}


def finished(path: str, group: str) -> dict[int, int] | None:
    """Next offset per partition that a consumer group has not finished, or None for a new group."""
    from pyarrow import fs

    system, base = _system(path)
    name = f"{base}/groups/{group}.json"
    if system.get_file_info(name).type == fs.FileType.NotFound:
        return None
    with system.open_input_file(name) as file:
        return _as_numbers(json.loads(file.read()))


def finish(path: str, group: str, offsets: dict[int, int]) -> None:
    """Record what a group has finished; a partition never goes back. Readers see the old or the new record."""
    system, base = _system(path)
    before = finished(path, group) or {}
    merged = {str(p): max(offsets.get(p, 0), before.get(p, 0)) for p in sorted({*offsets, *before})}
    system.create_dir(f"{base}/groups", recursive=True)
    with system.open_output_stream(f"{base}/groups/.{group}") as out:
        out.write(json.dumps(merged).encode())
    system.move(f"{base}/groups/.{group}", f"{base}/groups/{group}.json")


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Segment]:
        log = Log(self.path)
        return log.segments({}, log.refresh())

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return _messages(self.path, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, group: str | None, from_beginning: bool):
        self.path, self.group, self.from_beginning, self.log = path, group, from_beginning, Log(path)

    def initialOffset(self) -> dict:
        done = finished(self.path, self.group) if self.group else None
        start = done if done is not None else {} if self.from_beginning else self.log.refresh()
        return {str(k): v for k, v in start.items()}

    def latestOffset(self) -> dict:
        return {str(k): v for k, v in sorted(self.log.refresh().items())}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        if not self.log.known:  # a restarted query plans from its checkpoint before it looks for more
            self.log.refresh()
        return self.log.segments(_as_numbers(start), _as_numbers(end))

    def commit(self, end: dict) -> None:
        if self.group:
            finish(self.path, self.group, _as_numbers(end))

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return _messages(self.path, partition)


class TopicLog(DataSource):
    """Options: path; group and fromBeginning for streams. A new group starts at the end unless fromBeginning is true."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MESSAGE

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], self.options.get("group"), self.options.get("frombeginning", "false").lower() == "true")


def append(rows: DataFrame, path: str, key: str, time_field: str, partitions: int = 4) -> None:
    """Append rows as JSON messages: a key always goes to the same partition, in the order of time."""
    names = [c for c in rows.columns if c != key]
    ends = Log(path).refresh()
    base = F.create_map(*[F.lit(x) for p in range(partitions) for x in (p, ends.get(p, 0))])
    sent = rows.select(
        col(key).cast("string").alias("key"),
        F.to_json(F.struct(*[col(n) for n in names])).alias("value"),
        F.pmod(F.xxhash64(col(key).cast("string")), F.lit(partitions)).cast("int").alias("partition"),
        col(time_field).cast("timestamp_ntz").alias("timestamp"),
    )
    numbered = number_rows(sent, ["partition"], ["timestamp"], "nth")
    placed = numbered.withColumn("offset", F.col("nth") - 1 + F.element_at(base, F.col("partition"))).drop("nth")
    placed.write.mode("append").partitionBy("partition").parquet(f"{path}/log")


def _source(spark: SparkSession) -> None:
    spark.dataSource.register(TopicLog)


def log_batch(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """All messages so far, decoded; a batch read always starts at the beginning."""
    _source(spark)
    return decode_messages(spark.read.format(FORMAT).option("path", path).load(), schema)


def log_stream(spark: SparkSession, path: str, group: str | None = None, from_beginning: bool = False) -> DataFrame:
    """Messages as they come, with partition and offset."""
    _source(spark)
    reader = spark.readStream.format(FORMAT).option("path", path).option("fromBeginning", str(from_beginning).lower())
    return (reader.option("group", group) if group else reader).load()


def consume(path: str, group: str, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A step for ``foreachBatch``: the group's offsets are recorded once ``write`` has done its work."""

    def step(batch: DataFrame, epoch: int) -> None:
        write(batch, epoch)
        ends = batch.groupBy("partition").agg(F.max("offset").alias("last")).collect()  # a row per partition of the topic
        finish(path, group, {r["partition"]: r["last"] + 1 for r in ends})

    return step
