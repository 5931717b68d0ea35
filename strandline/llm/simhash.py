"""SimHash near-duplicates through a Gray-order hierarchical index.

A document's fingerprint has a bit set where more than half of its shingle
hashes have it.  Fingerprints within ``radius`` bits are linked, and linked
documents form a component.

The search: with b blocks, two fingerprints at most r bits apart agree on b - r
of them, so each distinct fingerprint goes to one bucket for every choice of
b - r blocks, keyed by those bits.  Inside a bucket the fingerprints are sorted
by Gray rank, where neighbours share long bit patterns; nodes over runs of
neighbours factor out the bits that all below them share, and a pair of nodes
whose shared bits already differ in more than r places is dropped with all that
is below, differences being accumulated from the root down.  Links are folded
into classes as they are found, so no bucket's pairs are ever held at once.

``survivors`` wants links by similarity, for which 64 bits are too few: its
documents have several words of fingerprint from independent mixes of the same
shingle hashes, each word's blocks key tables of their own, and a link is one
of two neighbouring words.  The number of tables and the radii follow from the
similarity and the recall asked for; every removal is verified on shingle sets.

Scale: rows with equal fingerprints are one before anything moves; buckets of
more than ``HOT_BUCKET`` fingerprints are dealt anew by further blocks of bits, and
what is hot after that is parted into blocks of rows each pair of which meets in
a task, all of which is exact; a task reports a bucket's links as stars, never as
all pairs.

Defined results: null and empty texts and texts without a word have fingerprint
zero; very long texts are hashed whole, their bits counted piece by piece; ties
(a bit set in exactly half of the hashes) are not set; a component's id is its
smallest non-null id; repeated rows share a component; extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import discard, keep, scratch, sent, slices, written
from strandline.llm.components import components

SEED = 42
HOT_BUCKET = 20_000
#: How often a hot bucket is dealt anew by further bits before its rows are parted in blocks.
FINER = 2
#: Rows of a bucket of ``survivors`` beyond which the whole bucket is one group of candidates.
HOT_CANDIDATES = 2_000
LEAF, FAN = 16, 8
_PENDING = 40_000
#: Node pairs that are opened at once.
_PAIRS = 4096


# fingerprints


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of each run of ``size`` words; of the whole sequence where there are fewer."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=False)]


#: For each byte its eight bits, one to a byte of a word, so that 255 words can be summed without a carry.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def bit_counts(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each run's hashes have each of the 64 bits: runs of ``counts`` from ``starts``, none empty."""
    parts = -(-counts // 255)
    ahead = np.cumsum(parts) - parts
    first = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(ahead, parts))
    lanes = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], first, axis=0)
    return np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64), ahead, axis=0, dtype=np.int64)


def _word(hashes: np.ndarray, word: int) -> np.ndarray:
    """The hashes that stand behind one word of a fingerprint; word 0 has the shingle hashes themselves."""
    if not word:
        return hashes
    h = hashes ^ np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _majority(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.packbits((2 * sums > counts[:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(text: bytes, size: int, words: int = 1) -> np.ndarray:
    """A text's fingerprint, ``words`` words, its hashes counted piece by piece."""
    hashes = np.array(shingle_hashes(text, size), np.uint64)
    out = np.zeros(words, np.uint64)
    for w in range(words if len(hashes) else 0):
        total = np.zeros((1, 64), np.int64)
        for i in range(0, len(hashes), _PENDING):
            part = hashes[i : i + _PENDING]
            total += bit_counts(_word(part, w), np.array([0]), np.array([len(part)]))
        out[w] = _majority(total, np.array([len(hashes)]))[0]
    return out


def _fingerprint_batch(texts: list[bytes], size: int, words: int = 1) -> np.ndarray:
    """A row of ``words`` words for each text."""
    out = np.zeros((len(texts), words), np.uint64)
    pending: list[int] = []
    where, starts = [], []

    def flush() -> None:
        if where:
            counts, hashes, at = np.diff([*starts, len(pending)]), np.array(pending, np.uint64), np.array(starts)
            for w in range(words):
                out[where, w] = _majority(bit_counts(_word(hashes, w), at, counts), counts)
        pending.clear(), where.clear(), starts.clear()

    for i, text in enumerate(texts):
        if len(text) > 8 * _PENDING:
            out[i] = fingerprint(text, size, words)
            continue
        if hashes := shingle_hashes(text, size):
            where.append(i)
            starts.append(len(pending))
            pending.extend(hashes)
            if len(pending) >= _PENDING:
                flush()
    flush()
    return out


def fingerprints(docs: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text", words: int = 1) -> DataFrame:
    """(key, fp): fp is the fingerprint's 64 bits as a long, or with more ``words`` an array of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = [(x or "").encode() for x in part.column(1).to_pylist()]
                fps = pa.array(_fingerprint_batch(texts, size, words).view(np.int64).ravel())
                if words > 1:
                    fps = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * words), fps)
                yield pa.RecordBatch.from_arrays([part.column(0), fps], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, fp " + ("long" if words == 1 else "array<bigint>"))


# the index


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a word in the binary-reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """Hierarchies over the fingerprints of many buckets, each in Gray order, for links within a radius.

    A leaf is a run of up to ``LEAF`` neighbours, an upper node a run of up to
    ``FAN`` nodes; a node holds the mask of bits that all below it share and
    their pattern.  All buckets are searched at once, level by level.
    """

    def __init__(self, fps: np.ndarray, bucket: np.ndarray | None = None):
        bucket = np.zeros(len(fps), np.int64) if bucket is None else bucket
        self.order = np.lexsort((gray_rank(fps), bucket))
        self.fps, of = fps[self.order], bucket[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # mask, pattern, first child and one more
        ones, zeros, fan = self.fps, ~self.fps, LEAF
        while True:
            edges = np.concatenate([[0], np.nonzero(np.diff(of))[0] + 1, [len(of)]])
            sizes = np.diff(edges)
            runs = -(-sizes // fan)
            first = np.repeat(edges[:-1], runs) + (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)) * fan
            ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
            self.levels.append((ones | zeros, ones, np.append(first, len(of))))
            of, fan = of[first], FAN
            if runs.max() <= FAN:
                break
        # pairs of top nodes within a bucket
        edges = np.concatenate([[0], np.nonzero(np.diff(of))[0] + 1])
        ends = np.append(edges[1:], len(of))
        n = np.repeat(ends - edges, ends - edges) - (np.arange(len(of)) - np.repeat(edges, ends - edges))
        self.a = np.repeat(np.arange(len(of)), n)
        self.b = self.a + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places in ``fps`` as given, of one bucket, at most ``radius`` bits apart, a bounded number at a time."""
        top = len(self.levels) - 1
        mask, pattern, _ = self.levels[top]
        a, b = self.a, self.b
        seen = mask[a] & mask[b]
        apart = np.bitwise_count((pattern[a] ^ pattern[b]) & seen).astype(np.int64)
        near = apart <= radius
        stack = [(top, a[near], b[near], apart[near], seen[near])]
        while stack:
            level, a, b, apart, seen = stack.pop()
            if len(a) > _PAIRS:
                half = len(a) // 2
                stack.append((level, a[:half], b[:half], apart[:half], seen[:half]))
                stack.append((level, a[half:], b[half:], apart[half:], seen[half:]))
                continue
            if not len(a):
                continue
            ca, cb, of = self._children(level, a, b)
            if level:
                mask, pattern, _ = self.levels[level - 1]
                both = mask[ca] & mask[cb]
                further = np.bitwise_count((pattern[ca] ^ pattern[cb]) & both & ~seen[of]).astype(np.int64)
                total = apart[of] + further
                near = total <= radius
                stack.append((level - 1, ca[near], cb[near], total[near], both[near]))
            else:
                near = (ca < cb) & (np.bitwise_count(self.fps[ca] ^ self.fps[cb]) <= radius)
                yield self.order[ca[near]], self.order[cb[near]]

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = self.levels[level][2]
        na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
        n = na * nb
        of = np.repeat(np.arange(len(a)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ca, cb = first[a][of] + k // nb[of], first[b][of] + k % nb[of]
        fine = ca <= cb
        return ca[fine], cb[fine], of[fine]


class Classes:
    """Classes of ``n`` places, each named by its smallest, that grow by pairs."""

    def __init__(self, n: int):
        self.label, self.added = np.arange(n), 0

    def _root(self, x: np.ndarray) -> np.ndarray:
        x = self.label[x]
        while ((up := self.label[x]) != x).any():
            x = up
        return x

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self._root(i), self._root(j)
            apart = i != j
            i, j = np.minimum(i[apart], j[apart]), np.maximum(i[apart], j[apart])
            np.minimum.at(self.label, j, i)
        self.added += 1
        if self.added % 64 == 0:
            self.label = self._root(self.label)

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, root) for each place that is not its class's smallest."""
        label = self._root(self.label)
        moved = np.nonzero(label != np.arange(len(label)))[0]
        return moved, label[moved]


def bucket_links(bucket: np.ndarray, fps: np.ndarray, radius: int, beside: np.ndarray | None = None, both: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) places that star-link what shares a bucket and is at most ``radius`` apart.

    With ``beside``, a second word of each, also at most ``both`` apart in the two words together.
    """
    crowd = np.nonzero(np.bincount(bucket)[bucket] > 1)[0]
    classes = Classes(len(fps))
    if len(crowd):
        for i, j in GrayIndex(fps[crowd], bucket[crowd]).links(radius):
            i, j = crowd[i], crowd[j]
            if beside is not None:
                apart = np.bitwise_count(fps[i] ^ fps[j]).astype(np.int64) + np.bitwise_count(beside[i] ^ beside[j])
                i, j = i[apart <= both], j[apart <= both]
            classes.add(i, j)
    return classes.stars()


def _masks(bits: list[int], blocks: int, agree: int) -> list[int]:
    """Masks over ``bits``: every choice of ``agree`` out of ``blocks`` even runs."""
    runs = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), blocks)]
    return [sum(c) for c in combinations(runs, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucket_runs(batches: Iterator[pa.RecordBatch], names: int, rows: int = 200_000) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(bucket numbers, columns) of whole buckets; rows come sorted by their first ``names`` columns, which name the bucket."""
    held: list[list[np.ndarray]] = []
    n = 0

    def joined() -> tuple[np.ndarray, list[np.ndarray]]:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns[:names]], axis=0)
        return new, columns

    for batch in batches:
        held.append([np.array(c.to_numpy(zero_copy_only=False), np.int64) for c in batch.columns])
        n += len(batch)
        if n >= rows:
            new, columns = joined()
            cut = int(np.nonzero(new)[0][-1])
            held, n = [[c[cut:] for c in columns]], len(new) - cut
            # a bucket of more than a run is read on until it is twice as long
            rows = max(rows, 2 * n)
            if cut:
                yield np.cumsum(new[:cut]), [c[:cut] for c in columns]
    if held:
        new, columns = joined()
        yield np.cumsum(new), columns


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _links_in(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (_, _, _, fp) in _bucket_runs(batches, 3):
            member, root = bucket_links(bucket, fp.view(np.uint64), radius)
            yield _pairs(fp[member], fp[root])

    return run


def _dealt(fps: DataFrame, masks: list[int]) -> DataFrame:
    each = F.explode(F.array(*(F.lit(_signed(m)) for m in masks)))
    return fps.select("fp", each.alias("mask")).withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))


def _hot(keyed: DataFrame, hot_bucket: int, rows: int | None) -> DataFrame:
    """(mask, bits, blocks) of the buckets with too many rows for a task."""
    counts = keyed.groupBy("mask", "bits").agg(F.ceil(F.count("*") / hot_bucket).alias("blocks")).where("blocks > 1")
    return written(counts, "hot-buckets", None if rows is None else rows // hot_bucket)


def _split_hot(keyed: DataFrame, masks: list[int], radius: int, hot_bucket: int, rows: int | None) -> DataFrame:
    """``keyed`` with ``part`` 0, hot buckets dealt anew.

    ``FINER`` times by further blocks of the free bits, which is exact and parts
    what merely shares the first block; a bucket that stays hot holds fingerprints
    that are alike, and its rows are parted in blocks, each pair of which meets.
    """
    done = keyed.limit(0).select("fp", "mask", "bits", F.lit(0).cast("long").alias("part"))
    for last in [False] * FINER + [True]:
        hot = _hot(keyed, hot_bucket, rows)
        if hot.isEmpty():
            break
        done = done.unionByName(keyed.join(hot, ["mask", "bits"], "left_anti").select("fp", "mask", "bits", F.lit(0).cast("long").alias("part")))
        crowd = keyed.join(hot, ["mask", "bits"])
        if last:
            own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
            met = crowd.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
            part = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other") + 1
            return done.unionByName(met.select("fp", "mask", "bits", part.alias("part")))
        finer = {}
        for m in masks:
            free = [b for b in range(64) if not m >> b & 1]
            finer[m] = [m | x for x in _masks(free, radius + 1, 1)] if len(free) > radius else [m]
        masks = sorted({x for xs in finer.values() for x in xs})
        pairs = [x for m, xs in finer.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(x)) for x in xs)))]
        crowd = crowd.select("fp", F.explode(F.element_at(F.create_map(*pairs), F.col("mask"))).alias("mask"))
        # a table, so that the next round's plan does not hold this one's
        keyed = written(crowd.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask"))), "hot-rows")
    return done.unionByName(keyed.select("fp", "mask", "bits", F.lit(0).cast("long").alias("part")))


def links(fps: DataFrame, radius: int = 3, agree: int = 1, hot_bucket: int = HOT_BUCKET, rows: int | None = None) -> DataFrame:
    """Distinct fingerprints (fp) -> (u, v) links that join all within ``radius`` bits.

    ``agree`` blocks out of ``radius + agree`` key a bucket: more make smaller
    buckets and more of them.  ``rows`` bounds the fingerprints where it is known.
    """
    masks = _masks(list(range(64)), radius + agree, agree)
    keyed = _split_hot(_dealt(fps, masks), masks, radius, hot_bucket, rows and rows * len(masks))
    parts = keyed.repartition("mask", "bits", "part").sortWithinPartitions("mask", "bits", "part")
    return parts.select("mask", "bits", "part", "fp").mapInArrow(_links_in(radius), "u long, v long")


def clusters(prints: DataFrame, radius: int = 3, agree: int = 1, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(key, fp) -> (fp, component_id, n): the smallest key reached from each fingerprint, and its rows."""
    rows = prints.count()
    fps = written(prints.groupBy("fp").agg(F.min("key").alias("low"), F.count("*").alias("n")), "fingerprints", rows)
    near = written(components(links(fps.select("fp"), radius, agree, hot_bucket, rows), rows), "members", rows)
    tied = fps.join(near, fps.fp == near.node).select("fp", "root", "low")
    # a table, so that the join shuffles both sides and a large component's partition can be split
    least = written(tied.groupBy("root").agg(F.min("low").alias("component_id")), "least", rows)
    tied = tied.select("fp", "root").join(least, "root").select(F.col("fp").alias("node"), "component_id")
    return fps.join(tied, fps.fp == tied.node, "left").select("fp", F.coalesce("component_id", "low").alias("component_id"), "n")


# near duplicates by similarity


class Plan:
    """Tables and radii for links of documents whose shingle sets are at least ``similarity`` alike.

    A bit of two fingerprints differs with probability acos(c) / pi at a cosine c
    of 2s / (1 + s), the cosine of equally large sets of Jaccard similarity s.
    A table is keyed by ``bits`` bits of a word; there are so many that a pair
    meets in one with probability ``recall``, and the radii let all but one pair
    in about a hundred pass.  Keys lengthen with the logarithm of the number of
    documents, which keeps chance buckets at no more than 256.
    """

    def __init__(self, rows: int, similarity: float, recall: float):
        differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
        self.bits = min(32, max(16, math.ceil(math.log2(max(rows, 1))) - 8))
        meet = (1 - differ) ** self.bits
        self.tables = math.ceil(math.log(1 - recall) / math.log(1 - meet)) if 0 < meet < 1 else 1
        self.per_word = 64 // self.bits
        self.words = max(2, -(-self.tables // self.per_word))
        most = lambda n: math.ceil(n * differ + 2.4 * math.sqrt(n * differ * (1 - differ)))
        self.radius, self.both = most(64 - self.bits), most(128 - self.bits)

    def dealt(self, prints: DataFrame) -> DataFrame:
        """(uid, fp) -> a row per table: bucket (table and key bits), fp, beside, uid."""
        each = prints.select("uid", "fp", F.explode(F.sequence(F.lit(0), F.lit(self.tables - 1))).alias("table"))
        word = F.floor(F.col("table") / self.per_word).cast("int")
        each = each.withColumn("a", F.element_at("fp", word + 1)).withColumn("beside", F.element_at("fp", (word + 1) % self.words + 1))
        of = F.lit(None).cast("long")
        for k in range(self.per_word):
            of = F.when(F.col("table") % self.per_word == k, F.shiftrightunsigned("a", k * self.bits)).otherwise(of)
        bits = of.bitwiseAND(F.lit((1 << self.bits) - 1))
        bucket = F.shiftleft(F.col("table").cast("long"), 32).bitwiseOR(bits)
        return each.select(bucket.alias("bucket"), F.col("a").alias("fp"), "beside", "uid")


def _candidates_in(radius: int, both: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (_, fp, beside, uid) in _bucket_runs(batches, 1):
            member, root = bucket_links(bucket, fp.view(np.uint64), radius, beside.view(np.uint64), both)
            yield _pairs(uid[member], uid[root])

    return run


def candidates(prints: DataFrame, plan: Plan, rows: int, hot: int = HOT_CANDIDATES) -> DataFrame:
    """(uid, fp words), distinct in fp -> (u, v) links of what may be alike.

    A bucket of more than ``hot`` rows is linked as a whole, each row to the
    smallest: more candidates than its pairs within the radius, never fewer.
    """
    keyed = plan.dealt(prints)
    crowds = keyed.groupBy("bucket").count().where(F.col("count") > hot).drop("count")
    crowds = written(crowds, "hot-buckets", rows * plan.tables // hot)
    # every hot bucket has more than ``hot`` rows, so there are few of them
    few = sent(crowds, rows * plan.tables // hot)
    parts = keyed.join(few, "bucket", "left_anti").repartition("bucket").sortWithinPartitions("bucket")
    found = parts.select("bucket", "fp", "beside", "uid").mapInArrow(_candidates_in(plan.radius, plan.both), "u long, v long")
    whole = keyed.join(few, "bucket").select("bucket", "uid")
    roots = written(whole.groupBy("bucket").agg(F.min("uid").alias("root")), "hot-roots", rows * plan.tables // hot)
    return found.unionByName(whole.join(sent(roots, rows * plan.tables // hot), "bucket").select(F.col("uid").alias("u"), F.col("root").alias("v")))


def _hashed(size: int):
    """(key, first, text) -> (key, first, hashes): a text's distinct shingle hashes, sorted, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                sets = [np.unique(np.array(shingle_hashes((x or "").encode(), size), np.uint64)) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in sets], pa.binary())], ["key", "first", "hashes"])

    return run


class ShingleSets:
    """Sorted shingle sets, and which of them have a Jaccard similarity of ``least`` with another set."""

    def __init__(self, sets: list[np.ndarray], least: float):
        self.least, self.sizes = least, np.array([len(x) for x in sets], np.int64)
        of = np.repeat(np.arange(len(sets)), self.sizes)
        every = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.hashes, self.of = every[order], of[order]

    def like(self, other: np.ndarray) -> np.ndarray:
        low, high = (np.searchsorted(self.hashes, other, side) for side in ("left", "right"))
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(self.of[at], minlength=len(self.sizes))
        return shared >= self.least * (len(other) + self.sizes - shared)


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]


def _settled(least: float):
    """A group's rows in order of key, each with whether it stays: one like a row that stays does not."""

    def run(table: pa.Table) -> pa.Table:
        keys = table["key"].combine_chunks()
        order = np.lexsort((keys.field("h").to_numpy(), keys.field("id").to_numpy()))
        table = table.take(pa.array(order))
        sets = _sets(table)
        index, stays = ShingleSets(sets, least), np.zeros(len(sets), bool)
        for i, own in enumerate(sets):
            stays[i] = not (index.like(own) & stays).any()
        return pa.table({"key": table["key"], "first": table["first"], "hashes": table["hashes"], "stays": pa.array(stays)})

    return run


def _unlike(least: float):
    """The left group's rows that are like none of the right group's."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        index = ShingleSets(_sets(right), least)
        far = [not index.like(own).any() for own in _sets(left)]
        return left.filter(pa.array(far, pa.bool_()))

    return run


#: Blocks may grow to so many times the rows and bytes of a small component.
MOST_LOAD = 32


def _blocks(crowd: DataFrame, rows: int, size: int, turn: int) -> DataFrame:
    """``crowd`` with ``block``, its row's part of the component in this turn, and ``blocks``, their number.

    A component of up to ``rows`` rows and ``size`` bytes is one block; blocks
    grow with the square root of a component of more than eight, up to
    ``MOST_LOAD`` such blocks.  A block is a random part of its component.
    """
    load = F.greatest(F.count("*") / rows, F.sum(F.length("hashes")) / size)
    blocks = F.greatest(F.lit(1.0), load / MOST_LOAD, F.least(load, F.sqrt(8 * load)))
    sizes = written(crowd.groupBy("first").agg(F.ceil(blocks).cast("int").alias("blocks")), "block-counts")
    block = F.pmod(F.xxhash64("key", F.lit(turn)), F.col("blocks")).cast("int")
    # few components, or a join that adaptive execution can split: no component meets in one task for its number of blocks
    return crowd.join(sent(sizes, sizes.count()), "first").select("key", "first", "hashes", block.alias("block"))


def _dropped(crowd: DataFrame, least: float, rows: int, size: int) -> DataFrame:
    """(key, first, hashes) -> (key) of the rows that are like a row of their component that stays.

    Each turn settles one block of every component, in order of key, takes from
    the others what is like the block's survivors, and parts what is left into
    blocks anew.  The block is a random part of what is left, so of a group of
    like rows that is large beside it some row is in it and takes all the others:
    the turns of a component of near copies do not grow with it, and only one of
    rows that are no copies after all takes a turn for each of its blocks.  No
    task ever holds more than two blocks.
    """
    several = written(crowd.groupBy("first").count().where(F.col("count") > 1).select("first"), "components")
    crowd = crowd.join(sent(several, several.count()), "first").select("key", "first", "hashes")
    left = start = written(crowd, "several")
    held, turn = left.agg(F.sum(F.length("hashes") + 32)).head()[0] or 0, 0
    kinds = "key struct<id:bigint,h:bigint>, first bigint, hashes binary"
    stay: list[DataFrame] = []
    while held:
        dealt = written(_blocks(left, rows, size, turn), "blocks", size=held)
        done = dealt.where("block = 0").select("key", "first", "hashes").groupBy("first").applyInArrow(_settled(least), kinds + ", stays boolean")
        done = written(done.where("stays").drop("stays"), "settled", size=held)
        stay.append(done.select("key"))
        if len(stay) == 8:
            stay = [written(reduce(DataFrame.unionByName, stay), "stay")]
        later = dealt.where("block > 0")
        against = done.join(later.select("first", "block").distinct(), "first").select(F.col("first").alias("of"), F.col("block").alias("at"), "hashes")
        after = later.groupBy("first", "block").cogroup(against.groupBy("of", "at")).applyInArrow(_unlike(least), kinds + ", block int")
        after = written(after.drop("block"), "later", size=held)
        discard(dealt)
        if turn:
            discard(left)
        left, turn = after, turn + 1
        held = left.agg(F.sum(F.length("hashes") + 32)).head()[0] or 0
    every = start.select("key")
    return every.join(reduce(DataFrame.unionByName, stay), "key", "left_anti") if stay else every.limit(0)


def _uid(key: str) -> Column:
    """A key as one long; two keys with the same one are candidates of each other, which the sets then deny."""
    return F.xxhash64(F.col(f"{key}.id"), F.col(f"{key}.h"))


def groups(docs: DataFrame, size: int, similarity: float, recall: float) -> tuple[DataFrame, DataFrame, int]:
    """(key) of every row, (node, root) of every key that may be like another, and the number of rows."""
    rows = docs.count()
    plan = Plan(rows, similarity, recall)
    prints = written(fingerprints(docs, size, "_key", "_text", plan.words), "prints")
    each = prints.select(_uid("key").alias("uid"), "fp")
    same = written(each.groupBy("fp").agg(F.min("uid").alias("uid"), F.max("uid").alias("last")), "fingerprints")
    several = same.where("uid <> last").select("fp", F.col("uid").alias("v"))
    twins = each.join(several, "fp").select(F.col("uid").alias("u"), "v")
    found = components(candidates(same.select("uid", "fp"), plan, rows).unionByName(twins), rows)
    return prints.select("key"), found, rows


def survivors(
    docs: DataFrame, size: int = 5, similarity: float = 0.8, recall: float = 0.93, block_rows: int = 512, block_bytes: int = 1 << 22
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    ``Plan`` finds candidates; the rows of a component of candidates are taken in
    order of id (then text hash), and one goes if its shingle set is at least
    ``similarity`` like that of a row that stays: of two rows of a component that
    are so alike never both stay, and a chain of links or a chance agreement of
    fingerprints costs no document.  A component of more than ``block_rows`` rows
    or ``block_bytes`` of hashes is taken block by block.

    Defined results: of repeated rows one stays, and one of all texts without a
    word, nulls among them; null ids come last in the order; very long texts are
    compared whole; extra columns stay as they are.
    """
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("h"))
    keyed = docs.select(F.struct("*").alias("_row"), key.alias("_key"), F.col("text").alias("_text"))
    with scratch():
        keys, found, rows = groups(keyed, size, similarity, recall)
        members = written(found.select("node", F.col("root").alias("first")), "members", rows)
        texts = keyed.select(F.col("_key").alias("key"), _uid("_key").alias("node"), F.col("_text").alias("text"))
        crowd = texts.join(sent(members, members.count()), "node").select("key", "first", "text")
        crowd = crowd.mapInArrow(_hashed(size), "key struct<id:bigint,h:bigint>, first bigint, hashes binary").dropDuplicates(["key"])
        gone = _dropped(written(crowd, "crowd"), similarity, block_rows, block_bytes)
        again = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        marks = gone.select("key", F.lit(True).alias("drop")).unionByName(again.select("key", F.lit(False).alias("drop")))
        marks = keep(written(marks.groupBy("key").agg(F.max("drop").alias("drop")), "marks", rows))
    told = keyed.join(sent(marks, marks.count()), keyed._key == marks.key, "left")
    single = told.where("drop IS NULL").select("_row.*")
    return single.unionByName(told.where("NOT drop").dropDuplicates(["_key"]).select("_row.*"))


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3, agree: int = 1) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = written(fingerprints(docs, size), "prints")
    with scratch():
        # as a table of its own, so that the join below is one that adaptive execution can split
        found = keep(written(clusters(prints, radius, agree).select("fp", "component_id"), "clusters", prints.count()))
    return prints.join(found, "fp").select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
