"""Deterministic sharded WARC writer and reader.

Records are sorted by page id and digest inside shards of neighbouring records.
A shard's bounds are exact quantiles of the bytes to write: a running sum over
the sorted records tells each its shard, whatever the ids look like, and the
number of shards follows from the bytes alone, so the same pages make the same
files under any session settings.  A task writes one shard: it streams its
sorted records into gzip members, one per record, starts a new file when the
compressed size passes ``roll_bytes``, and writes every header and digest anew
from the bytes at hand.

Commit: files are written under temporary names that no other attempt uses; the
names that successful tasks report are a table in the shared folder (the
manifest); then each is moved to its final name, which may be repeated safely,
and the manifest is written beside the files last.  Files of lost attempts are
in no manifest and go with the temporary folder.

Payload dedup: of records with equal payloads of at least ``MIN_REVISIT`` bytes
the one with the largest page id is a response, others revisit it.

Defined results: a null html is an empty payload; a null url an empty target; a
null page id sorts first and never wins against another id; records that tie
for the largest id (repeated rows) are all responses; a very long payload is a
record like any other, which its task holds once; extra columns are not read; an
empty table makes no file.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import files_for, scratch, shared_dir, written

MIN_REVISIT = 1000
#: At most so many shards, whose bounds every task knows (about 50 bytes each).
MAX_SHARDS = 65_536
MAX_SHARD_BYTES = 256 << 20
ROLL_BYTES = 64 << 20
LEVEL = 5

#: Fixed values of the WARC format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"

_FILE = "shard long, part int, temporary string, name string, records long, bytes long, sha1 string"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a folder's address, and the path there."""
    scheme, _, rest = uri.partition("://")
    if not rest:
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + "://" + rest)


def _base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _record(kind: str, name: str, date: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    digest = hashlib.sha1(block).hexdigest()
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), *fields]
    head += [("WARC-Block-Digest", _base32(digest)), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + CRLF + block + CRLF + CRLF


def _name(page_id: int | None, copy: int) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{copy}>"


def _clean(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def page_record(page_id: int | None, copy: int, url: str, payload: bytes, kind: str, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", _base32(hashlib.sha1(payload).hexdigest()))]
    if page_id is not None:
        fields.append(("WARC-X-Page-ID", str(page_id)))
    fields.append(("Content-Type", "application/http; msgtype=response"))
    if kind == "revisit":
        fields += [("WARC-Refers-To", _name(refers_to, 0)), ("WARC-Profile", PROFILE)]
    return _record(kind, _name(page_id, copy), date, fields, http + (payload if kind == "response" else b""))


class _Roller:
    """Files of one shard, each under a temporary name until it is committed."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, date: str):
        self.fs, self.path = filesystem(folder)
        self.folder, self.shard, self.roll_bytes, self.date = folder, shard, roll_bytes, date
        self.part, self.out, self.rows = 0, None, []

    def _open(self) -> None:
        self.name = f"shard-{self.shard:08d}-{self.part:05d}.warc.gz"
        self.temporary = f"_tmp/{self.name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.path}/_tmp", recursive=True)
        self.out = self.fs.open_output_stream(f"{self.path}/{self.temporary}", compression=None)
        self.size, self.records, self.digest = 0, 0, hashlib.sha1()
        info = f"software: strandline\r\nformat: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
        self._put(_record("warcinfo", f"<urn:x-file:{self.name}>", self.date, [("Content-Type", "application/warc-fields")], info))

    def _put(self, record: bytes) -> None:
        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = squeeze.compress(record) + squeeze.flush()
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)

    def add(self, record: bytes) -> None:
        if self.out is None:
            self._open()
        self._put(record)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.shard, self.part, self.temporary, self.name, self.records, self.size, self.digest.hexdigest()))
            self.part, self.out = self.part + 1, None


def _write_shards(folder: str, roll_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, decision, copy, rows = None, None, 0, []

        def flush(done: _Roller | None):
            if done:
                done.close()
                rows.extend(done.rows)

        for batch in batches:
            for at in range(0, len(batch), 256):
                for r in batch.slice(at, 256).to_pylist():
                    if roller is None or roller.shard != r["shard"]:
                        flush(roller)
                        roller = _Roller(folder, r["shard"], roll_bytes, date)
                    if r["row"] == 0:
                        decision, copy = r, 0
                        continue
                    payload = (r["html"] or "").encode()
                    if decision["page_id"] != r["page_id"] or decision["digest"] != r["digest"]:
                        raise ValueError("a record came without its decision")
                    roller.add(
                        page_record(r["page_id"], copy, r["url"] or "", payload, decision["kind"], decision["refers_to"], date)
                    )
                    copy += 1
        flush(roller)
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            names = [c.split()[0] for c in _FILE.split(", ")]
            cols = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _commit(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                new = f"{path}/{r['name']}"
                info = where.get_file_info(new)
                if info.type == pafs.FileType.NotFound or info.size != r["bytes"]:
                    where.move(f"{path}/{r['temporary']}", new)
            yield batch

    return run


def _decided(pages: DataFrame) -> DataFrame:
    """Small columns of every page: page_id, digest, size."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha2(html, 256)).alias("digest"), F.octet_length(html).cast("long").alias("size")
    )


def shard_count(total: int, shard_bytes: int | None = None) -> int:
    """Shards for ``total`` bytes: they grow with its square root up to ``MAX_SHARD_BYTES``, and beyond where there are too many."""
    each = shard_bytes or min(MAX_SHARD_BYTES, math.isqrt(total << 20))
    return max(1, min(MAX_SHARDS, -(-total // max(1, each))))


def _sharded(each: DataFrame, rows: int, shard_bytes: int | None) -> tuple[DataFrame, list, int]:
    """``each`` with its shard, the first (page id, digest) of each shard, and the number of shards."""
    cost = F.col("cost") * F.col("n")
    ranged = each.repartitionByRange(files_for(each.sparkSession, rows), "page_id", "digest").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "decisions")
    sums = sorted((r.part, r.bytes) for r in ranged.groupBy("part").agg(F.sum(cost).alias("bytes")).collect())  # a row per file
    ends = np.cumsum([0] + [b for _, b in sums]).tolist()
    total = ends[-1]
    shards = shard_count(total, shard_bytes)
    base = each.sparkSession.createDataFrame([(p, e) for (p, _), e in zip(sums, ends, strict=False)], "part int, base long")
    before = Window.partitionBy("part").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(cost).over(before), F.lit(0)) + F.col("base")
    shard = F.floor(at * F.lit(shards) / F.lit(max(1, total)).cast("decimal(20,0)")).cast("int")
    out = written(ranged.join(F.broadcast(base), "part").withColumn("shard", shard).drop("part", "base"), "shards")
    first = out.groupBy("shard").agg(F.min(F.struct("page_id", "digest")).alias("k")).collect()  # at most MAX_SHARDS rows
    return out, sorted((r.shard, r.k.page_id, bytes(r.k.digest)) for r in first), shards


def _shard_of(first: list):
    """A function of (page id, digest) that finds the shard among the ``first`` keys."""
    least = -(1 << 63)
    numbers = np.array([s for s, _, _ in first], np.int32)
    keys = [(least if p is None else p, d) for _, p, d in first]
    ids = np.array([p for p, _ in keys], np.int64)

    @F.pandas_udf("int")
    def shard(page_id: pd.Series, digest: pd.Series) -> pd.Series:
        x = np.array([least if v is None or v != v else int(v) for v in page_id], np.int64) if page_id.dtype != np.int64 else page_id.to_numpy()
        i = np.searchsorted(ids, x, "right") - 1
        # where shards start inside one page id, the digest decides
        for k in np.nonzero(ids[np.maximum(i, 0)] == x)[0].tolist():
            i[k] = bisect.bisect_right(keys, (int(x[k]), bytes(digest.iloc[k]))) - 1
        return pd.Series(numbers[np.maximum(i, 0)])

    return shard


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int | None = None, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives of ``pages`` in ``folder``; returns the manifest, a row per file."""
    spark = pages.sparkSession
    with scratch():
        small = written(_decided(pages), "pages")
        rows = small.count()
        each = small.groupBy("page_id", "digest", "size").agg(F.count("*").alias("n"))
        top = each.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("top"))
        each = each.join(top, "digest", "left")
        again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
        each = each.select(
            "page_id", "digest", "n", F.when(again, "revisit").otherwise("response").alias("kind"),
            F.when(again, F.col("top")).alias("refers_to"), (F.when(again, 0).otherwise(F.col("size")) + 600).alias("cost"),
        )
        each, first, shards = _sharded(each, rows, shard_bytes)
        lean = each.select(
            "shard", "page_id", "digest", F.lit(0).alias("row"), "kind", "refers_to",
            F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"),
        )
        html = F.coalesce(F.col("html"), F.lit(""))
        full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.unhex(F.sha2(html, 256)).alias("digest"))
        full = full.select(
            _shard_of(first)("page_id", "digest").alias("shard"), "page_id", "digest", F.lit(1).alias("row"),
            F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("refers_to"), "url", "html",
        )
        parts = lean.unionByName(full).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "row", "url")
        made = written(parts.withColumn("shard", F.col("shard").cast("long")).mapInArrow(_write_shards(folder, roll_bytes, date), _FILE), "warc-files", shards)
        done = made.repartition(max(1, made.count())).mapInArrow(_commit(folder), _FILE)
        done.drop("temporary").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


# reading


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The content of each gzip member."""
    data = stream.read(chunk)
    while data:
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if not data:
                raise ValueError("the archive ends inside a member")
            out.append(inflate.decompress(data))
            data = inflate.unused_data if inflate.eof else stream.read(chunk)
        yield b"".join(out)
        data = data or stream.read(chunk)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields and block; raises if the length or the block's digest is wrong."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != CRLF + CRLF or _base32(hashlib.sha1(rest[:n]).hexdigest()) != fields["WARC-Block-Digest"]:
        raise ValueError(f"bad record {fields.get('WARC-Record-ID')}")
    return fields, rest[:n]


def _page_of(fields: dict[str, str], block: bytes) -> tuple | None:
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(CRLF) if x.startswith(b"Content-Length"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"bad payload in {fields['WARC-Record-ID']}")
    page = fields.get("WARC-X-Page-ID")
    refers = fields["WARC-Refers-To"].split(":")[2] if kind == "revisit" else None
    return int(page) if page is not None else None, size, digest, kind, int(refers) if refers else None, fields["WARC-Target-URI"]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every page record of the archives that the manifest names, each checked."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    files = manifest.select("name", "sha1").repartition(max(1, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = filesystem(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in _RECORD.split(", ")]
        for batch in batches:
            for f in batch.to_pylist():
                rows = []
                with where.open_input_stream(f"{path}/{f['name']}", compression=None) as stream:
                    for member in _members(stream):
                        if row := _page_of(*parse(member)):
                            rows.append((*row, f["name"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(run, _RECORD)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` and read them back."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder)
