"""FASTQ as a Spark data source, batch and stream (SRC01-SRC05, SM01, SM10).

``spark.read.format("fastq")`` gives a row per record: file, ordinal, header,
seq, qual and reason.  Records that are not whole and well formed have a reason
and go to no read table (``reads`` and ``rejects``).

``scan`` cuts files above ``split`` bytes into byte ranges, a task each.  A range
owns the records whose first line starts in it and reads on to their end.  Which
lines start a record follows from the number of lines before the range: a first
pass counts line ends per range, and their prefix sums give each range its first
line, so records and ordinals are those of a reader of the whole file, whatever
is broken in it.  Without ordinals the first pass is left out: a record then
starts at the first line with ``@`` whose next but one has ``+``, which no quality
line passes, since a sequence never starts with ``+``.  Block-gzipped files are cut
at blocks; any other gzipped file is one task, read as a stream.  A task reads
several small files or ranges one after the other, ``SPLIT_BYTES`` in all, so tasks
are as many as the bytes need, not as there are ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, islice, takewhile

import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from strandline.storage import shared_folder

SCHEMA = "file string, ordinal long, header string, seq string, qual string, reason string"
_CHUNK = 1 << 20
_ROWS = 10_000
#: Bytes that are read at once beyond a range, for the end of its last record, and that opening a file or range counts for.
_BEYOND = 1 << 16
#: Bytes of a file that one task reads.
SPLIT_BYTES = 64 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    scheme, _, rest = path.partition("://")
    if not rest:
        return pafs.LocalFileSystem(), path.removeprefix("file:")
    return pafs.FileSystem.from_uri({"s3a": "s3"}.get(scheme, scheme) + "://" + rest)


def _infos(path: str) -> list[tuple[str, int]]:
    """(file, size) at a path: itself, or those below a folder, in order, without names that start with a dot or underscore."""
    out = []
    for one in path.split(","):
        where, at = filesystem(one)
        head = one[: len(one) - len(at)] if one.endswith(at) else ""
        info = where.get_file_info(at)
        if info.type == pafs.FileType.Directory:
            below = where.get_file_info(pafs.FileSelector(at, recursive=True))
            own = [x for x in below if x.is_file and not any(n[0] in "._" for n in x.path[len(at) :].strip("/").split("/"))]
            out += sorted((head + x.path, x.size) for x in own)
        else:
            out.append((one, info.size or 0))
    return out


def listed(path: str) -> list[str]:
    """The files at a path."""
    return [f for f, _ in _infos(path)]


# bytes, lines and records of a range


class _Range(InputPartition):
    """The bytes ``start`` to ``stop`` of a file, to its end if there is no ``stop``; ``first`` numbers the first line that starts after ``start``."""

    def __init__(self, path: str, start: int = 0, stop: int | None = None, kind: str = "whole", first: int | None = None, size: int = 0):
        self.path, self.start, self.stop, self.kind, self.first, self.size = path, start, stop, kind, first, size


class _Pack(InputPartition):
    """The ranges that one task reads."""

    def __init__(self, ranges: list[_Range]):
        self.ranges = ranges


_BLOCK = b"\x1f\x8b\x08\x04"
_LONGEST_BLOCK = 1 << 16


def _block_size(head: bytes) -> int | None:
    """The size of the gzip block that starts here, if it states one."""
    if head[:4] != _BLOCK or len(head) < 12:
        return None
    extra, i = head[12 : 12 + int.from_bytes(head[10:12], "little")], 0
    while i + 4 <= len(extra):
        size = int.from_bytes(extra[i + 2 : i + 4], "little")
        if extra[i : i + 2] == b"BC" and size == 2:
            return int.from_bytes(extra[i + 4 : i + 6], "little") + 1
        i += 4 + size
    return None


def _first_block(file: pa.NativeFile, start: int, size: int) -> int:
    """Where the first block from ``start`` on begins: its stated size leads to another one, or to the end."""
    window = file.read_at(2 * _LONGEST_BLOCK, start)
    at = window.find(_BLOCK)
    while at >= 0:
        n = _block_size(window[at : at + 512])
        if n and (start + at + n == size or file.read_at(4, start + at + n) == _BLOCK):
            return start + at
        at = window.find(_BLOCK, at + 1)
    return size


def _kind(path: str) -> str:
    where, at = filesystem(path)
    with where.open_input_file(at) as file:
        head = file.read_at(512, 0)
    return "plain" if head[:2] != b"\x1f\x8b" else "blocks" if _block_size(head) else "whole"


def _inflated(stream: pa.NativeFile) -> Iterator[bytes]:
    data = stream.read(_CHUNK)
    inflate = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None
    while data:
        if inflate is None:
            yield data
        else:
            yield inflate.decompress(data)
            while inflate.eof and inflate.unused_data:
                data, inflate = inflate.unused_data, zlib.decompressobj(31)
                yield inflate.decompress(data)
        data = stream.read(_CHUNK)


def _chunks(part: _Range) -> Iterator[tuple[bool, bytes]]:
    """The text from the range's start on, and whether it is inside; it goes on beyond the range for who reads on."""
    where, at = filesystem(part.path)
    if part.kind == "whole":
        with where.open_input_stream(at, compression=None) as stream:
            for data in _inflated(stream):
                yield True, data
        return
    with where.open_input_file(at) as file:
        size, here = file.size(), part.start
        if part.kind == "blocks":
            here = _first_block(file, here, size)
            while here < size:
                data = file.read_at(_LONGEST_BLOCK, here)
                n = _block_size(data[:512])
                if n is None:
                    raise ValueError(f"no gzip block at byte {here} of {part.path}")
                yield here < part.stop, zlib.decompress(data[:n], 31)
                here += n
        while here < size:
            data = file.read_at(min(_CHUNK, part.stop - here) if here < part.stop else min(_CHUNK, _BEYOND), here)
            yield here < part.stop, data
            here += len(data)


def _lines(part: _Range) -> Iterator[tuple[bytes, bool]]:
    """The lines that start after the range's start (the first of a file too), and whether that is in it; one at its very end is."""
    skip, at, inside, rest = part.start > 0, 0, 0, b""
    for own, data in _chunks(part):
        inside += len(data) * own
        *whole, rest = (rest + data).split(b"\n")
        for line in whole:
            if skip:
                skip = False
            else:
                yield line, at <= inside
            at += len(line) + 1
    if rest and not skip:
        yield rest, at <= inside


def _record(four: list[bytes]) -> tuple[str, str, str, str | None]:
    """(header, seq, qual, reason) of four lines, or of what is left at the end; reason is null for a good record."""
    lines = [x.decode("ascii", "replace").rstrip("\r") for x in four]
    if len(lines) < 4:
        lines += [""] * (4 - len(lines))
        return lines[0].removeprefix("@"), lines[1], lines[3], "truncated"
    head, seq, plus, qual = lines
    reason = None
    if not head.startswith("@"):
        reason = "header"
    elif not plus.startswith("+"):
        reason = "separator"
    elif len(seq) != len(qual):
        reason = "quality length"
    return head.removeprefix("@"), seq, qual, reason


def _lead(lines: list[bytes]) -> int:
    """How many of a range's first lines end the record before."""
    starts = (i for i in range(min(4, len(lines) - 2)) if lines[i][:1] == b"@" and lines[i + 2][:1] == b"+")
    return next(starts, len(lines))


def _numbered(part: _Range) -> Iterator[tuple[int | None, list[bytes]]]:
    """(ordinal, lines) of the records that start in the range."""
    lines, first = _lines(part), part.first
    if first is None and part.start:
        seen = list(islice(lines, 6))
        kept, ordinal = chain(seen[_lead([x for x, _ in seen]) :], lines), None
    else:
        ordinal = -(-(first or 0) // 4)
        kept = islice(lines, 4 * ordinal - (first or 0), None)
    numbered = part.first is not None or not part.stop
    while four := [*islice(kept, 4)]:
        if not four[0][1]:
            return
        texts = [x for x, _ in four]
        if len(texts) == 4 or any(x.strip() for x in texts):
            yield (ordinal if numbered else None), texts
        ordinal = None if ordinal is None else ordinal + 1


def records(lines: Iterator[bytes]) -> Iterator[tuple[str, str, str, str | None]]:
    """(header, seq, qual, reason) of every four lines; reason is null for a good record."""
    while four := [*islice(lines, 4)]:
        if len(four) == 4 or any(x.strip() for x in four):
            yield _record(four)


def _read(part: _Range) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    size = 0
    for ordinal, four in _numbered(part):
        rows.append((part.path, ordinal, *_record(four)))
        size += sum(map(len, four))
        if len(rows) == _ROWS or size >= 8 * _CHUNK:
            yield batch()
            rows.clear()
            size = 0
    if rows:
        yield batch()


# the sources


def _ranges(path: str, split: int) -> list[_Range]:
    """A range for every small or gzipped file, several for the others."""
    out = []
    for file, size in _infos(path):
        kind = _kind(file) if size > split > 0 else "whole"
        cuts = range(0, size, split) if kind != "whole" else ()
        out += [_Range(file, a, min(size, a + split), kind, size=min(split, size - a)) for a in cuts] or [_Range(file, size=size)]
    return out


def _packed(ranges: list[_Range], split: int, tasks: int) -> list[InputPartition]:
    """Neighbouring ranges put together for about ``tasks`` tasks, for more where these would read above SPLIT_BYTES; 0: a task each."""
    if not tasks:
        return [_Pack([r]) for r in ranges]
    weights = [r.size + min(split, _BEYOND) for r in ranges]
    most, held, packs = min(SPLIT_BYTES, sum(weights) // tasks), 0, []
    for r, weight in zip(ranges, weights, strict=True):
        if not packs or held + weight > most:
            packs.append([])
            held = 0
        packs[-1].append(r)
        held += weight
    return [_Pack(p) for p in packs]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split, self.lines = options["path"], int(options.get("split", 0)), options.get("lines")
        self.tasks = int(options.get("tasks", 0))

    def partitions(self) -> list[InputPartition]:
        out = _ranges(self.path, self.split)
        if self.lines:  # a row per range
            where, at = filesystem(self.lines)
            counted = pads.dataset(at, filesystem=where, format="parquet").to_table().to_pydict()
            ends = {(f, a): n for f, a, n in zip(counted["file"], counted["start"], counted["ends"], strict=True)}
            before = 0
            for part in (p for p in out if p.kind != "whole"):
                part.first = before + 1 if part.start else 0
                before = (before if part.start else 0) + ends[part.path, part.start]
        return _packed(out, self.split, self.tasks)

    def read(self, partition: _Pack) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges:
            yield from _read(part)


class _LineReader(DataSourceReader):
    """(file, start, ends): the line ends of each range of the files that have several."""

    def __init__(self, options: dict):
        self.path, self.split, self.tasks = options["path"], int(options["split"]), int(options["tasks"])

    def partitions(self) -> list[InputPartition]:
        return _packed([p for p in _ranges(self.path, self.split) if p.kind != "whole"], self.split, self.tasks) or [_Pack([])]

    def read(self, partition: _Pack) -> Iterator[pa.RecordBatch]:
        ends = []
        for part in partition.ranges:
            inside = takewhile(lambda x: x[0], _chunks(part))
            ends.append(sum(data.count(b"\n") for _, data in inside))
        row = [[p.path for p in partition.ranges], [p.start for p in partition.ranges], ends]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "start", "ends"])


class _LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq_lines"

    def schema(self) -> str:
        return "file string, start long, ends long"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options)


class _StreamReader(DataSourceStreamReader):
    """New files of a folder; the offset names the files seen, so a late file is read wherever its name sorts.

    Offsets grow with the folder's file names: move read files away where a folder lives for long.
    """

    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        return {"files": listed(self.path)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        seen = set(start["files"])
        return [_Range(f) for f in end["files"] if f not in seen]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        yield from _read(partition)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)
    spark.dataSource.register(_LineSource)


def scan(spark: SparkSession, path: str, split: int = SPLIT_BYTES, ordinals: bool = True) -> DataFrame:
    """SRC02: the records of all files at ``path``, those above ``split`` bytes read by several tasks.

    Ordinals cost such files a pass that counts lines; without them the column is null there.
    """
    register(spark)
    tasks = 8 * spark.sparkContext.defaultParallelism
    reader = spark.read.format("fastq").option("split", split).option("tasks", tasks)
    if ordinals and any(size > split for _, size in _infos(path)):
        lines = shared_folder(spark, "fastq-lines")
        spark.read.format("fastq_lines").option("split", split).option("tasks", tasks).load(path).write.parquet(lines)
        reader = reader.option("lines", lines)
    return reader.load(path)


def stream(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("fastq").load(path)


def reads(scanned: DataFrame) -> DataFrame:
    """SRC02: the good records."""
    return scanned.where("reason IS NULL").drop("reason")


def rejects(scanned: DataFrame) -> DataFrame:
    return scanned.where("reason IS NOT NULL")


def read_name(header: Column) -> Column:
    """SRC03: the name that mates share: up to a blank, without /1 or /2."""
    return F.regexp_replace(F.regexp_extract(header, r"^\S*", 0), "/[12]$", "")


def pairs(r1: DataFrame, r2: DataFrame, by: Column | None = None) -> DataFrame:
    """SRC01: records of two scans joined by ordinal, up to the shorter one; ``same_name`` tells whether names agree.

    Where the scans have several files, ``by`` says from ``file`` which of them belong together.
    """
    own = [] if by is None else [by.alias("sample")]
    side = lambda d, n: d.select(*own, "ordinal", *(F.col(c).alias(f"{c}_{n}") for c in ("header", "seq", "qual")))
    both = side(reads(r1), 1).join(side(reads(r2), 2), ["sample"] * len(own) + ["ordinal"]).withColumnRenamed("ordinal", "pair_id")
    return both.withColumn("same_name", read_name(F.col("header_1")) == read_name(F.col("header_2")))


def long_form(paired: DataFrame) -> DataFrame:
    """(pair_id, mate, header, seq, qual) with two rows per pair."""
    mate = lambda n: paired.select("pair_id", F.lit(n).alias("mate"), *(F.col(f"{c}_{n}").alias(c) for c in ("header", "seq", "qual")))
    return mate(1).unionByName(mate(2))


def is_fastq(path: str) -> bool:
    """SRC04: whether the first line starts with @, in a gzipped file too."""
    first, _ = next(_lines(_Range(path)), (b"", True))
    return first.startswith(b"@")


def checked(scanned: DataFrame) -> DataFrame:
    """SRC04: (file, is_fastq, records, rejected) of every file that has a record, counted where it is read."""
    starts = F.coalesce(F.bool_or((F.col("ordinal") == 0) & ~F.col("reason").eqNullSafe("header")), F.lit(False))
    return scanned.groupBy("file").agg(starts.alias("is_fastq"), F.count("*").alias("records"), F.count("reason").alias("rejected"))


def lines_of(header: Column, seq: Column, qual: Column) -> Column:
    """A record's four lines as one text, as a text file of rows needs it."""
    return F.concat_ws("\n", F.concat(F.lit("@"), header), seq, F.lit("+"), qual)
