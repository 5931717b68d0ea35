"""A topic in a shared folder: a sink that publishes every batch once, and its readers (SNK24, SRC26).

It stands where a message broker would, with the contract that matters: readers
see whole batches in order, and a batch that is repeated after a crash is
published once.  Publishing has two phases.  Tasks write their messages to files
under ``data`` that no reader looks at; when all are done, the driver puts their
names into ``log/<batch>.json`` by a rename.  If that name is there already the
batch has been published, and the repeated files are removed.  Readers follow the
log alone; a stream's offset is the number of batches it has read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from strandline.sources.fastq import filesystem

SCHEMA = "key string, value string, batch long"
_KINDS = pa.schema([("key", pa.string()), ("value", pa.string())])


def _log(path: str) -> list[int]:
    """The published batches, in order."""
    where, at = filesystem(path)
    found = where.get_file_info(pafs.FileSelector(f"{at}/log", allow_not_found=True))
    return sorted(int(x.base_name.removesuffix(".json")) for x in found if x.base_name.endswith(".json"))


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    rows: int


class _Writer(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, at = filesystem(self.path)
        file, rows, out = f"data/{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if len(batch):
                if out is None:
                    where.create_dir(f"{at}/data", recursive=True)
                    out = pq.ParquetWriter(f"{at}/{file}", _KINDS, filesystem=where)
                out.write_batch(batch.select(["key", "value"]).cast(_KINDS))
                rows += len(batch)
        if out is None:
            return _Written(None, 0)
        out.close()
        return _Written(file, rows)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        where, at = filesystem(self.path)
        files = {m.file: m.rows for m in messages if m and m.file}
        if batchId in _log(self.path):
            self.abort(messages, batchId)
            return
        where.create_dir(f"{at}/log", recursive=True)
        staged = f"{at}/log/.{batchId}-{uuid.uuid4().hex}"
        with where.open_output_stream(staged) as out:
            out.write(json.dumps(files).encode())
        where.move(staged, f"{at}/log/{batchId}.json")

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        where, at = filesystem(self.path)
        for m in messages:
            if m and m.file:
                where.delete_file(f"{at}/{m.file}")


class _File(InputPartition):
    def __init__(self, path: str, batch: int):
        self.path, self.batch = path, batch


def _files(path: str, batches: list[int]) -> list[InputPartition]:
    where, at = filesystem(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    out: list[InputPartition] = []
    for n in batches:
        with where.open_input_stream(f"{at}/log/{n}.json") as text:
            out += [_File(f"{head}{at}/{f}", n) for f in json.loads(text.read())]
    return out


def _read(part: _File) -> Iterator[pa.RecordBatch]:
    where, at = filesystem(part.path)
    with where.open_input_file(at) as file:
        for batch in pq.ParquetFile(file).iter_batches():
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part.batch] * len(batch), pa.int64())], ["key", "value", "batch"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return _files(self.path, _log(self.path)) or [_File("", -1)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from _read(partition)


class _StreamReader(DataSourceStreamReader):
    """From the first batch on; batches are numbered by the query that publishes them."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        return {"batch": max(_log(self.path), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _files(self.path, [n for n in _log(self.path) if start["batch"] < n <= end["batch"]])

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        yield from _read(partition)


class TopicSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)

    def streamWriter(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def messages(rows: DataFrame, key: str) -> DataFrame:
    """(key, value): every row as JSON under its key."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def publish(rows: DataFrame, path: str, key: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """SNK24: a stream's rows into the topic at ``path``, each batch once, whatever is repeated after a crash."""
    rows.sparkSession.dataSource.register(TopicSource)
    writer = messages(rows, key).writeStream.format("topic").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def consume(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """SRC26: the topic's messages as rows of ``schema``, from the first on, with the batch each came in."""
    spark.dataSource.register(TopicSource)
    reader = spark.readStream if stream else spark.read
    raw = reader.format("topic").option("path", path).load()
    return raw.select("batch", F.from_json("value", schema).alias("m")).select("batch", "m.*")
