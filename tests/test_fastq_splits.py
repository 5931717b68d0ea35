"""FASTQ files read in ranges give the records and ordinals of one reader."""

import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandline.sources import fastq


def text(rng, n, broken):
    """Records whose quality lines start with @ and + as often as not; some torn, some with other line ends."""
    out = []
    for i in range(n):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 5, 30, 400])))
        qual = "".join(rng.choice("@+I#") for _ in seq)
        head, plus = f"@r{i}", rng.choice(["+", "+x"])
        if broken and rng.random() < 0.2:
            head, plus, qual = rng.choice([("r", plus, qual), (head, "-", qual), (head, plus, qual + "I"), ("", "", "")])
        out += [head, seq, plus, qual]
    if broken:
        out = out[: len(out) - rng.randint(0, 3)]
    return rng.choice(["\n", "\r\n"] if broken else ["\n"]).join(out) + rng.choice(["", "\n", "\n\n"] if broken else ["\n"])


def blocks(data, size):
    """Block gzip: members that state their own size, and an empty one at the end."""
    out = b""
    for i in range(0, len(data) + size, size):
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        raw = data[i : i + size]
        body = deflate.compress(raw) + deflate.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
        out += head + body + struct.pack("<II", zlib.crc32(raw), len(raw))
    return out


def whole(path):
    return [(o, *fastq._record(four)) for o, four in fastq._numbered(fastq._Range(str(path)))]


def by_ranges(path, split, with_lines=True):
    parts, before, out = fastq._ranges(str(path), split), 0, []
    for p in parts:
        if with_lines and p.kind != "whole":
            p.first = before + 1 if p.start else 0
            before += sum(d.count(b"\n") for own, d in fastq._chunks(p) if own)
        out += [(o, *fastq._record(four)) for o, four in fastq._numbered(p)]
    return len(parts), out


@pytest.mark.parametrize("seed", range(12))
def test_ranges_of_plain_files(tmp_path, monkeypatch, seed):
    monkeypatch.setattr(fastq, "_CHUNK", 97)
    rng = random.Random(seed)
    path = tmp_path / "x.fastq"
    path.write_bytes(text(rng, 40, seed % 2 == 1).encode())
    want = whole(path)
    assert len(want) > 30
    for split in (1, 2, 7, 50, 333, 1000, 10**6):
        n, got = by_ranges(path, split)
        assert got == want and (n > 1) == (split < path.stat().st_size)


@pytest.mark.parametrize("seed", range(6))
def test_ranges_of_block_gzip(tmp_path, seed):
    rng = random.Random(seed)
    path, plain = tmp_path / "x.fastq.gz", text(rng, 60, seed % 2 == 1).encode()
    path.write_bytes(blocks(plain, rng.choice([50, 200, 1000])))
    want = whole(path)
    assert want == [(i, *r) for i, r in enumerate(fastq.records(iter(plain.removesuffix(b"\n").split(b"\n"))))]
    for split in (40, 150, 700, 5000):
        n, got = by_ranges(path, split)
        assert got == want and n == max(1, -(-path.stat().st_size // split))


@pytest.mark.parametrize("seed", range(6))
def test_ranges_find_records_without_counts(tmp_path, seed):
    """Good files need no pass for the lines: quality lines with @ and + mislead nobody."""
    path = tmp_path / "x.fastq"
    path.write_bytes(text(random.Random(seed), 50, False).encode())
    want = [r[1:] for r in whole(path)]
    for split in (1, 3, 40, 500):
        assert [r[1:] for r in by_ranges(path, split, False)[1]] == want


def test_other_gzip_is_one_range(tmp_path):
    path = tmp_path / "x.fastq.gz"
    path.write_bytes(gzip.compress(text(random.Random(1), 50, False).encode()))
    n, got = by_ranges(path, 100)
    assert n == 1 and got == whole(path)


def test_many_tasks_read_one_file(spark, tmp_path):
    rng = random.Random(9)
    folder = tmp_path / "in" / "lane=1"
    folder.mkdir(parents=True)
    (folder / "a.fastq").write_bytes(text(rng, 2000, True).encode())
    (folder / "b.fastq.gz").write_bytes(blocks(text(rng, 500, True).encode(), 900))
    (folder / "c.fastq").write_bytes(b"@x\nA\n+\n!\n")
    (folder / "_SUCCESS").write_bytes(b"")
    df = fastq.scan(spark, str(tmp_path / "in"), split=5000)
    assert df.rdd.getNumPartitions() > 20
    got = {(r.file, r.ordinal): r[2:] for r in df.collect()}
    want = {(str(f), r[0]): r[1:] for f in sorted(folder.glob("*.fastq*")) for r in whole(f)}
    assert {k: tuple(v) for k, v in got.items()} == want
    counts = {r.file: (r.is_fastq, r.records, r.rejected) for r in fastq.checked(df).collect()}
    assert counts == {str(f): (fastq.is_fastq(str(f)), len(x := whole(f)), sum(r[4] is not None for r in x)) for f in folder.glob("*.fastq*")}
    bare = fastq.scan(spark, str(folder / "a.fastq"), split=5000, ordinals=False)
    assert bare.where("ordinal IS NOT NULL").count() == 0


def test_tasks_are_as_many_as_bytes_need(spark, tmp_path):
    """Ten times the ranges are no more tasks, the pass that counts lines included, and the same records."""
    rng = random.Random(5)
    (tmp_path / "a.fastq").write_bytes(text(rng, 300, True).encode())
    for i in range(100):
        (tmp_path / f"small{i:03}.fastq").write_bytes(text(rng, 1, False).encode())
    want = sorted((str(f), *r) for f in tmp_path.glob("*.fastq") for r in whole(f))
    for split in (2000, 200):
        df = fastq.scan(spark, str(tmp_path), split=split)
        assert sorted(map(tuple, df.collect()), key=lambda r: r[:2]) == want
        assert len(fastq._ranges(str(tmp_path), split)) > 100 and df.rdd.getNumPartitions() <= 16 * spark.sparkContext.defaultParallelism


def test_packs_hold_every_range_once(monkeypatch):
    monkeypatch.setattr(fastq, "SPLIT_BYTES", 1000)
    ranges = [fastq._Range("x", size=n) for n in (10, 900, 5, 5, 3000, 0, 400)]
    for tasks, most in ((0, 7), (1, 6), (3, 6), (100, 7)):
        packs = fastq._packed(ranges, 20, tasks)
        assert [r for p in packs for r in p.ranges] == ranges and len(packs) <= most
    assert fastq._packed([], 20, 4) == []


def test_pairs_of_many_files(spark, tmp_path):
    for lane in (1, 2):
        for mate in (1, 2):
            (tmp_path / f"s{lane}_{mate}.fastq").write_text("".join(f"@l{lane}r{i}/{mate}\nAC\n+\nII\n" for i in range(40 * lane)))
    lane = F.regexp_extract("file", r"(s\d+)_[12]\.fastq$", 1)
    one, two = (fastq.scan(spark, ",".join(str(tmp_path / f"s{x}_{m}.fastq") for x in (1, 2)), split=200) for m in (1, 2))
    both = fastq.pairs(one, two, lane)
    assert both.count() == 120 and both.where("NOT same_name").count() == 0
