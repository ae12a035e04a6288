"""An append-only JSON log with whole commits: batch and streaming writers, a reader, and a buffered recorder.

Each task writes a file of its own; the driver then names the files of the
attempts that succeeded in one commit, by a rename. A reader sees the files of
commits only, so a task tried again writes nothing twice, and a write that
fails leaves nothing to be seen. A stream's batch is committed under the
stream's name and its number, and once only.

Files are opened by the file system of the path's scheme, in tasks and driver.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage

SCHEMA = "commit string, file string, pos bigint, value string"
_COMMITS = "_commits"
#: Lines of a batch that the reader hands to Spark.
_BATCH = 10_000


def _opened(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def commits(path: str) -> list[tuple[str, list[tuple[str, int]]]]:
    """(name, files with their lines) of the whole commits of a log, in order of their names."""
    from pyarrow import fs

    store, at = _opened(path)
    out = []
    for f in store.get_file_info(fs.FileSelector(f"{at}/{_COMMITS}", allow_not_found=True)):
        if f.base_name.endswith(".json"):
            with store.open_input_stream(f.path) as s:
                out.append((f.base_name[: -len(".json")], [(n, k) for n, k in json.loads(s.read())["files"]]))
    return sorted(out)


@dataclass
class Written(WriterCommitMessage):
    """The file that an attempt of a task wrote, and its lines."""

    file: str
    lines: int


class _Writer:
    """What the batch and the streaming writer have in common."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = _opened(self.path)
        store.create_dir(at, recursive=True)
        name, lines = f"part-{uuid.uuid4().hex}.jsonl", 0
        with store.open_output_stream(f"{at}/{name}") as out:
            for b in iterator:
                said = [v.encode() for v in b.column(0).to_pylist() if v is not None]
                if said:
                    out.write(b"\n".join(said) + b"\n")
                    lines += len(said)
        return Written(name, lines)

    def _commit(self, messages: list[Written | None], name: str) -> None:
        from pyarrow import fs

        store, at = _opened(self.path)
        whole = f"{at}/{_COMMITS}/{name}.json"
        if store.get_file_info(whole).type != fs.FileType.NotFound:  # the batch was committed before a restart
            self._remove(messages)
            return
        store.create_dir(f"{at}/{_COMMITS}", recursive=True)
        part = f"{whole}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(json.dumps({"files": [(m.file, m.lines) for m in messages if m is not None and m.lines]}).encode())
        store.move(part, whole)
        self._remove([m for m in messages if m is not None and not m.lines])

    def _remove(self, messages: list[Written | None]) -> None:
        store, at = _opened(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{at}/{m.file}")


class BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._commit(messages, f"{time.time_ns():020d}-{uuid.uuid4().hex}")

    def abort(self, messages: list[Written | None]) -> None:
        self._remove(messages)


class StreamWriter(_Writer, DataSourceStreamArrowWriter):
    """A batch is known by the stream's name; its number makes the order, behind commits of before the stream's first."""

    def __init__(self, path: str, name: str):
        super().__init__(path)
        self.name = name

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._commit(messages, f"{self.name}-{batchId:012d}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._remove(messages)


@dataclass
class LogFile(InputPartition):
    commit: str
    file: str


class Reader(DataSourceReader):
    """A partition for each file of the commits that are whole when the scan begins."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [LogFile(name, file) for name, files in commits(self.path) for file, _ in files] or [LogFile("", "")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, at = _opened(self.path)
        with store.open_input_stream(f"{at}/{partition.file}") as raw:
            done, rest = 0, b""
            while True:
                got = raw.read(1 << 22)
                lines = (rest + got).split(b"\n")
                rest = lines.pop()
                for k in range(0, len(lines), _BATCH):
                    part = [x.decode() for x in lines[k : k + _BATCH]]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([partition.commit] * n), pa.array([partition.file] * n), pa.array(range(done, done + n), pa.int64()), pa.array(part)], ["commit", "file", "pos", "value"])
                    done += n
                if not got:
                    return


class CommitLog(DataSource):
    """format("commit_log"): writes one string column, reads (commit, file, pos, value)."""

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return SCHEMA

    def _path(self, schema: T.StructType | None = None) -> str:
        if schema is not None and [f.dataType for f in schema] != [T.StringType()]:
            raise ValueError("a commit log takes one string column")
        return self.options["path"]

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self._path())

    def writer(self, schema: T.StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("a commit log is only appended to")
        return BatchWriter(self._path(schema))

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(self._path(schema), self.options.get("stream", "stream"))


def _lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def append(df: DataFrame, path: str) -> None:
    """The rows as JSON lines, in one commit."""
    df.sparkSession.dataSource.register(CommitLog)
    _lines(df).write.format("commit_log").mode("append").save(path)


def append_stream(stream: DataFrame, path: str, checkpoint: str, name: str):
    """Each micro-batch as one commit; what is there is written and the query ends."""
    stream.sparkSession.dataSource.register(CommitLog)
    return _lines(stream).writeStream.format("commit_log").option("stream", name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """(commit, file, pos, value) of all whole commits, or the values' fields in place of value."""
    spark.dataSource.register(CommitLog)
    rows = spark.read.format("commit_log").load(path)
    return rows if schema is None else rows.select("commit", "file", "pos", F.from_json("value", schema).alias("v")).select("commit", "file", "pos", "v.*")


class Recorder:
    """A buffered log of metrics: rows wait in the driver and are written as one commit, every so many rows or seconds.

    Used as a context, it writes the rest at the end, also after an error. At
    most `rows` wait; those are lost if the driver dies before they are written.
    """

    def __init__(self, spark: SparkSession, path: str, rows: int = 1000, seconds: float = 30.0):
        self.spark, self.path, self.rows, self.seconds = spark, path, rows, seconds
        self.waiting: list[tuple[int, str, float, int]] = []
        self.since = time.monotonic()
        self.count = 0

    def record(self, step: int, **metrics: float) -> None:
        for name, value in metrics.items():
            self.waiting.append((step, name, float(value), self.count))
        self.count += 1
        if len(self.waiting) >= self.rows or time.monotonic() - self.since >= self.seconds:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            rows = self.spark.createDataFrame(self.waiting, "step bigint, name string, value double, seq bigint").coalesce(1)
            append(rows, self.path)
        self.waiting, self.since = [], time.monotonic()

    def __enter__(self) -> Recorder:
        return self

    def __exit__(self, *error) -> None:
        self.flush()


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """(step, name, value) of a recorder's log; of a step that was recorded again, the last."""
    rows = read(spark, path, "step bigint, name string, value double, seq bigint")
    return rows.groupBy("step", "name").agg(F.max_by("value", F.struct("commit", "seq")).alias("value"))
