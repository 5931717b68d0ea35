"""FM index of reference shards and maximal exact matches by backward search (GR18).

``build`` turns references into shards of about ``SHARD_BASES`` bases in the tasks
that read them.  A shard's row holds its text's Burrows-Wheeler transform, counts
of each base at every ``BLOCK`` places of it, and the suffix array's entries of
every ``SAMPLE``-th base of the text.

``maximal_matches`` finds the stretches of a read that some reference holds and that
would be in none if they were one base longer on either side, whatever their length.  From each
base of all reads of a block a search goes backwards at once, a base a step, as
long as the shard has what it has read.  Shards are sent in groups of
``SENT_BYTES``, a pass over the reads for each, which are dealt anew over tasks by their
bases; what one shard finds inside a longer stretch of another of its group is left out
where it is found, and of another group at the end, per read, so results do not depend
on shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.storage import written

SHARD_BASES = 1 << 20
#: Bytes of shards that go to every task at once; a shard has about three bytes a base.
SENT_BYTES = 32 << 20
BLOCK, SAMPLE = 32, 8
#: Bases of reads that are searched at once.
READ_BASES = 1 << 17
#: Bases of reads for each task.
TASK_BASES = 1 << 19
#: 0 ends the text, 1 to 4 are the bases, 5 is anything else and parts references.
_CODE = np.full(256, 5, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(1, 5)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the text's suffixes in order, by ranks of prefixes of twice the length each round."""
    rank, have = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(len(text), np.int64)
        after[: len(text) - have] = rank[have:] + 1
        key = rank * (len(text) + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        have *= 2
        if rank[order[-1]] == len(text) - 1 or have >= len(text):
            return order


def index_of(text: np.ndarray) -> dict[str, np.ndarray]:
    """The index of codes without the end mark."""
    text = np.append(text, np.uint8(0))
    order = suffix_array(text)
    bwt = text[order - 1]  # the base before the first is the end mark
    whole = len(bwt) // BLOCK
    blocks = np.zeros((whole + 1, 6), np.int32)
    for c in range(6):
        blocks[1:, c] = (bwt[: whole * BLOCK].reshape(whole, BLOCK) == c).sum(axis=1).cumsum()
    rows = np.flatnonzero(order % SAMPLE == 0)
    return {"bwt": bwt, "blocks": blocks, "rows": rows.astype(np.int32), "places": order[rows].astype(np.int32)}


class Shard:
    """A row of the index, ready to be searched."""

    def __init__(self, row: dict):
        self.bwt = np.frombuffer(row["bwt"], np.uint8)
        self.blocks = np.frombuffer(row["blocks"], np.int32).reshape(-1, 6)
        self.rows, self.places = (np.frombuffer(row[c], np.int32) for c in ("rows", "places"))
        self.refs, self.starts = row["refs"], np.array(row["starts"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.bwt, minlength=6))])
        wide = np.append(self.bwt, np.full(BLOCK - len(self.bwt) % BLOCK, 9, np.uint8))
        # a bit for each letter of a block, the first lowest
        self.bits = np.stack([np.packbits(wide == c, bitorder="little").view("<u4") for c in range(6)], axis=1).ravel()
        self.counts = self.blocks.ravel()

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the transform's first ``i`` letters are ``c``."""
        at = i // BLOCK * 6 + c
        before = (np.uint32(1) << (i % BLOCK).astype(np.uint32)) - np.uint32(1)
        return self.counts[at].astype(np.int64) + np.bitwise_count(self.bits[at] & before)

    def longest(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each base: the length of the longest match that ends there, and its rows."""
        n = len(codes)
        low, high, size = np.zeros(n, np.int64), np.full(n, len(self.bwt), np.int64), np.zeros(n, np.int64)
        going = np.flatnonzero(codes < 5)
        while len(going):
            c = codes[going - size[going]].astype(np.int64)
            a, b = self.first[c] + self.rank(c, low[going]), self.first[c] + self.rank(c, high[going])
            on = a < b
            going, a, b = going[on], a[on], b[on]
            low[going], high[going] = a, b
            size[going] += 1
            at = going - size[going]
            going = going[(at >= 0) & (codes[np.maximum(at, 0)] < 5)]
        return size, low, high

    def located(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the rows' suffixes begin: backwards to the next sampled base."""
        out, left, row = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.astype(np.int64)
        for steps in range(SAMPLE):
            at = np.minimum(np.searchsorted(self.rows, row), len(self.rows) - 1)
            hit = self.rows[at] == row
            out[left[hit]] = self.places[at[hit]] + steps
            left, row = left[~hit], row[~hit]
            if not len(left):
                break
            c = self.bwt[row].astype(np.int64)
            row = self.first[c] + self.rank(c, row)
        return out


_ROW = {"refs": pa.list_(pa.int64()), "starts": pa.list_(pa.int64()), "bwt": pa.binary(), "blocks": pa.binary(), "rows": pa.binary(), "places": pa.binary()}


def build(references: DataFrame, key: str = "ref_id", seq: str = "seq", shard_bases: int = SHARD_BASES) -> DataFrame:
    """GR18: the index, a written row per shard; keys are unique whole numbers, and a longer reference is a shard of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs: list[int] = []
        texts: list[bytes] = []

        def row() -> pa.RecordBatch:
            starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1].tolist()
            index = index_of(_CODE[np.frombuffer(b"|".join(texts), np.uint8)])
            cells = [refs, starts, *(index[c].tobytes() for c in ("bwt", "blocks", "rows", "places"))]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(cells, _ROW.values(), strict=True)], list(_ROW))

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if texts and sum(map(len, texts)) + len(t) > shard_bases:
                    yield row()
                    refs, texts = [], []
                refs.append(k)
                texts.append(t.encode())
        if texts:
            yield row()

    known = references.where(F.length(seq) > 0).select(F.col(key).cast("long").alias("key"), seq)
    return written(known.mapInArrow(run, "refs array<bigint>, starts array<bigint>, bwt binary, blocks binary, rows binary, places binary"), "fm-index")


def _found(reads: DataFrame, shards: list[dict], key: str, seq: str, least: int) -> DataFrame:
    shipped = reads.sparkSession.sparkContext.broadcast(shards)
    names, kind = ["q", "length", "ref_id", "t"], reads.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Shard(row) for row in shipped.value]
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < len(batch):
                before = size[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(size, before + READ_BASES, "right")))
                texts = [(t or "").encode() for t in batch.column(1).slice(start, stop - start).to_pylist()]
                begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
                codes = _CODE[np.frombuffer(b"|".join(texts), np.uint8)]
                best, kept = np.zeros(len(codes), np.int64), []
                for i, shard in enumerate(own):
                    n, low, high = shard.longest(codes)
                    best = np.maximum(best, n)
                    end = np.flatnonzero((n >= least) & (n == best))
                    kept.append((i, end, n[end], low[end], high[end]))
                    if sum(len(k[1]) for k in kept) > 4 * len(codes):  # some are shorter than what a later shard has
                        kept = [(j, *(x[k[1] == best[k[0]]] for x in k)) for j, *k in kept]
                first = np.arange(len(best)) - best + 1
                maximal = (best >= least) & (np.append(first[1:], len(best) + 1) > first)
                for i, end, n, low, high in kept:
                    shard, on = own[i], maximal[end] & (n == best[end])
                    end, low, many = end[on], low[on], (high - low)[on]
                    of = np.repeat(end, many)
                    row = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
                    text = shard.located(row)
                    ref = np.searchsorted(shard.starts, text, "right") - 1
                    read = np.searchsorted(begin, first[of], "right") - 1
                    refs = pa.array(shard.refs, pa.int64()).take(pa.array(ref))
                    cells = [batch.column(0).take(pa.array(read + start)), pa.array(first[of] - begin[read]), pa.array(best[of]), refs, pa.array(text - shard.starts[ref])]
                    yield pa.RecordBatch.from_arrays(cells, [key, *names])
                start = stop

    return reads.select(key, seq).mapInArrow(run, f"{key} {kind}, q long, length long, ref_id long, t long")


def maximal_matches(reads: DataFrame, index: DataFrame, key: str = "read_id", seq: str = "seq", least: int = 20) -> DataFrame:
    """(read, q, length, ref_id, t): every place of every maximal match of ``least`` bases and more; read ids are unique."""
    sizes = [(r["n"], r["start"]) for r in index.select(sum(F.length(c) for c in ("bwt", "blocks", "rows", "places")).alias("n"), F.col("refs")[0].alias("start")).collect()]
    groups: list[list[int]] = []
    held = SENT_BYTES + 1
    for n, start in sorted(sizes, key=lambda x: (x[1] is None, x[1])):  # a row per shard
        if held + n > SENT_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(start)
        held += n
    bases = reads.agg(F.sum(F.length(seq))).head()[0] or 0
    reads = reads.select(key, seq).repartition(max(reads.sparkSession.sparkContext.defaultParallelism, bases // TASK_BASES), key)
    passes = []
    for group in groups:
        shards = [r.asDict() for r in index.where(F.col("refs")[0].isin(group)).collect()]  # of at most SENT_BYTES, or one shard
        passes.append(_found(reads, shards, key, seq, least))
    if not passes:
        return _found(reads.where("false"), [], key, seq, least)
    if len(passes) == 1:
        return passes[0]
    found = written(reduce(DataFrame.unionByName, passes), "matches")
    # a stretch inside a longer one is maximal in its own group only
    end = F.col("q") + F.col("length")
    furthest = F.max("_end").over(Window.partitionBy(key).orderBy(F.asc("q"), F.desc("_end")).rowsBetween(Window.unboundedPreceding, -1))
    spans = found.select(key, "q", "length").distinct().withColumn("_end", end).withColumn("_furthest", furthest)
    kept = spans.where(F.col("_furthest").isNull() | (F.col("_furthest") < F.col("_end"))).select(key, "q", "length")
    return found.join(kept, [key, "q", "length"])
