"""Small helpers that every operator of this subpackage uses."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.storage import file_system, shared_folder

#: Words are runs of anything but these six characters and the space.
SPACE_CLASS = r"[\x20\x09-\x0D]"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, _UPPER, _UPPER.lower())


#: Rows of a few numbers that one file of a small table holds.
ROWS_PER_FILE = 200_000
#: Bytes that one file of another table holds.
FILE_BYTES = 64 << 20


shared_dir = shared_folder


def files_for(spark: SparkSession, rows: int) -> int:
    """Files for ``rows`` small rows: one per ``ROWS_PER_FILE``, and at least one per core where each gets a thousand."""
    return max(1, -(-rows // ROWS_PER_FILE), min(spark.sparkContext.defaultParallelism, rows // 1000))


def written(df: DataFrame, name: str, rows: int | None = None, size: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives executors.

    ``rows`` bounds the number of rows of a table whose rows are a few numbers,
    ``size`` the bytes of one whose rows are not.  Such rows are dealt over as many
    files as the bound asks for by a shuffle of their own, so what is above keeps
    all its tasks and a hundred tiny partitions do not become a hundred files.
    """
    path = shared_dir(df.sparkSession, name)
    if size is not None:
        rows = size * ROWS_PER_FILE // FILE_BYTES
    if rows is not None:
        df = df.repartition(files_for(df.sparkSession, rows))
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._written_path = path
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those that ``keep`` takes out: their readers must be done by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        discard(*_SCRATCH.pop())


def keep(table: DataFrame) -> DataFrame:
    """``table``, left to the scratch around this one, or to the session."""
    mine = _SCRATCH.pop()
    mine[:] = [t for t in mine if t is not table]
    if _SCRATCH:
        _SCRATCH[-1].append(table)
    _SCRATCH.append(mine)
    return table


#: A table of up to so many bytes may be sent to every task.
BROADCAST_BYTES = 32 << 20


def sent(df: DataFrame, rows: int, each: int = 64) -> DataFrame:
    """``df``, whose ``rows`` of ``each`` bytes have been counted, marked to be sent to every task if they are few.

    Else the join is left to a shuffle of both sides.
    """
    return F.broadcast(df) if rows * each <= BROADCAST_BYTES else df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` whose readers are all done."""
    for df in tables:
        fs, hadoop = file_system(df.sparkSession, df._written_path)
        fs.delete(hadoop, True)


def table_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate for ``df``: the size of its files for a plain scan, without a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def slices(batch: pa.RecordBatch, column: int, rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of up to ``rows`` rows and about ``size`` bytes of one column's texts; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(batch):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(start, stop - start)
        start = stop
