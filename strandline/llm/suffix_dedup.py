"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte is removed if a string of ``SPAN`` bytes that covers it also starts
somewhere else in the corpus, in the same document too.  Sorting the suffixes
at every byte would move twenty times the corpus, so the sort is confined to
where a repeat is possible:

1. Texts are packed, compressed, into rows of a table in the shared folder.
2. Winnowing picks anchors: of every ``WINDOW`` neighbouring strings of
   ``CORE`` = SPAN - WINDOW + 1 bytes the one with the least hash.  Equal
   strings of SPAN bytes hold an anchor at the same place, so a string that
   repeats has an anchor whose core repeats.  A core's *region* is all that the
   strings assigned to it can cover.  A pack's anchors with equal cores and
   regions, byte for byte, are one *entry* that knows whether it is there twice.
3. The entries' core hashes meet in buckets.  A core seen once is done: equal
   bytes have equal hashes, so nothing is lost.  Nothing is removed by a hash.
4. The regions of all other cores travel as bytes, one copy per entry.  The
   suffixes after the core and the reversed prefixes before it are merge sorted
   within the core's group.  Two suffixes are compared by binary search for
   their common extension over prefix polynomial hashes, so in logarithmic time;
   afterwards the cores, and every neighbour's extension and order, are verified
   byte by byte, and a collision has the bytes themselves sorted.  The order's
   classes at each depth tell which SPAN-byte strings around the core are shared.
5. Every pack gets a mask of shared strings for each of its entries, by the
   entry's number there, and cuts its texts.

Scale: packs and buckets grow with the square root of the corpus, from 8 and 4 MB
to 512 and 256 MB of text, so that a row between a pack and a bucket stays worth
its overhead.  A hot core, with more than ``HOT_CORE`` entries, is dealt anew by
the hash of each whole string around it; its strings then meet in buckets, travel
and are sorted and verified like any region.  Two joins move the compressed packs
(four where a core is hot); nothing goes to the driver but the corpus size and
whether hot cores exist.

Defined results: a null text counts as empty; texts under SPAN bytes stay whole;
very long texts are a pack of their own; ties need no rule, since all copies of a
string go; repeated rows repeat each other and lose all; extra columns are not
read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import sent, table_bytes, written

SPAN = 200
WINDOW = 64
CORE = SPAN - WINDOW + 1
SIDE = WINDOW - 1
REGION = SPAN + SIDE
HOT_CORE = 50_000
PACK_BYTES, MAX_PACK_BYTES = 8 << 20, 512 << 20
#: Regions that are sorted at once, but for a single core's.
_SORTED = 20_000
_SECTION = 1 << 17
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_VERDICT = "pack long, bucket int, ask binary, hot binary"
_ENTRY = "bucket int, pack long, core binary, twice binary"
_REGION = "bucket int, pack long, core binary, before binary, size binary, twice binary, data binary"


# prefix polynomial hashes modulo 2**64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to ``n`` at least."""
    if base not in _TABLES or len(_TABLES[base][0]) <= n:
        size = max(n, _SECTION + 4 * SPAN)
        _TABLES[base] = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
    return _TABLES[base]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class PrefixHash:
    """Hash of any substring of ``buf`` in constant time."""

    def __init__(self, buf: np.ndarray, base: int = _BASES[0]):
        power, self.inverse = _tables(base, len(buf))
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        terms = self.sums[1:]
        terms[:] = buf
        terms += np.uint64(1)
        terms *= power[: len(buf)]
        np.cumsum(terms, out=terms)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


# anchors


def _slide(a: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """``best`` of every ``width`` neighbours, by doubling."""
    n = 1
    while 2 * n <= width:
        a = best(a[:-n], a[n:])
        n *= 2
    return best(a[: len(a) - (width - n)], a[width - n :]) if n < width else a


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(place, core hash, region start, region end, region hash) section by section.

    ``starts`` and ``ends`` bound the texts in ``buf``; nothing crosses them.
    """
    for s in range(0, len(buf), _SECTION):
        lo, hi = max(0, s - SIDE), min(len(buf), s + _SECTION + SIDE + CORE)
        n = hi - lo - CORE + 1
        if n < 1:
            continue
        one, two = (PrefixHash(buf[lo:hi], b) for b in _BASES)
        at = np.arange(n)
        h = mixed(one.of(at, at + CORE))
        first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
        for e in ends[first:last].tolist():
            h[max(0, e - lo - CORE + 1) : max(0, e - lo)] = _NONE
        pad = np.full(SIDE, _NONE)
        low = _slide(np.concatenate([pad, h, pad]), WINDOW, np.minimum)
        chosen = np.nonzero((_slide(low, WINDOW, np.maximum) == h) & (h != _NONE))[0]
        place = chosen + lo
        inside = (place >= s) & (place < s + _SECTION)
        chosen, place = chosen[inside], place[inside]
        if not len(place):
            continue
        text = np.searchsorted(starts, place, "right") - 1
        a, b = np.maximum(place - SIDE, starts[text]), np.minimum(place + SPAN, ends[text])
        long_ = b - a >= SPAN
        chosen, place, a, b = chosen[long_], place[long_], a[long_], b[long_]
        shape = (place - a).astype(np.uint64) << np.uint64(32) | (b - place).astype(np.uint64)
        region = mixed(two.of(a - lo, b - lo) + mixed(shape))
        yield place, h[chosen], a, b, region


# packs


def pack_size(docs: DataFrame) -> int:
    """Bytes of text per pack, from the optimizer's size estimate: about 8 KB for each pack there will be."""
    return min(MAX_PACK_BYTES, max(PACK_BYTES, math.isqrt(table_bytes(docs) << 13)))


def packs(docs: DataFrame, pack_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of about ``pack_bytes`` of texts: pack, keys, lengths, size, data (compressed)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        name = TaskContext.get().partitionId() << 32
        keys, texts, size = [], [], 0
        key_type = None

        def full():
            nonlocal keys, texts, size, name
            lengths = np.array([len(t) for t in texts], "<i8").tobytes()
            row = [[name], pa.array([keys], pa.list_(key_type)), [lengths], [size], [squeeze.compress(b"".join(texts))]]
            name, keys, texts, size = name + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["pack", "keys", "lengths", "size", "data"])

        for batch in batches:
            key_type = batch.schema.types[0]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (t.as_py() or "").encode()
                keys.append(k)
                texts.append(raw)
                size += len(raw)
                if size >= pack_bytes:
                    yield full()
        if texts:
            yield full()

    schema = f"pack long, keys array<{kind}>, lengths binary, size long, data binary"
    return written(docs.select(key, text).mapInArrow(run, schema), "packs")


def _opened(lengths: bytes, size: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A pack's bytes and the bounds of its texts that are not empty."""
    n = np.frombuffer(lengths, "<i8")
    ends = np.cumsum(n)
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, size)) if size else b""
    return np.frombuffer(raw, np.uint8), (ends - n)[n > 0], ends[n > 0]


# entries


def _equal(buf: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the ``n`` bytes (up to REGION) at x and at y are the same, byte by byte."""
    out = np.zeros(len(x), bool)
    if not len(x):
        return out
    padded = np.concatenate([buf, np.zeros(REGION, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, REGION)
    cols = np.arange(REGION)
    for i in range(0, len(x), 4096):
        part = slice(i, i + 4096)
        out[part] = ((rows[x[part]] == rows[y[part]]) | (cols >= n[part, None])).all(axis=1)
    return out


class Entries:
    """A pack's anchors, folded where core and region are equal bytes, in an order that only its bytes decide.

    ``of`` numbers each anchor's entry; ``at``, ``core`` and ``twice`` give an
    entry's first anchor, its core's hash and whether it has more of them.
    """

    def __init__(self, buf: np.ndarray, place: np.ndarray, core: np.ndarray, a: np.ndarray, n: np.ndarray, region: np.ndarray, buckets: int):
        self.place, self.a, self.n = place, a, n
        order = np.lexsort((region, core))
        same = np.zeros(len(order), bool)
        i, j = order[1:], order[:-1]
        like = np.nonzero((core[i] == core[j]) & (region[i] == region[j]) & (n[i] == n[j]) & (place[i] - a[i] == place[j] - a[j]))[0]
        same[like + 1] = _equal(buf, a[i[like]], a[j[like]], n[i[like]])
        first = np.nonzero(~same)[0]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(~same) - 1
        self.at = order[first]
        self.core = core[self.at]
        self.twice = np.diff(np.append(first, len(order))) > 1
        bucket = (self.core % np.uint64(buckets)).astype(np.int64)
        self.by = np.argsort(bucket, kind="stable")
        self.ids, cuts = np.unique(bucket[self.by], return_index=True)
        self.cuts = np.append(cuts, len(self.by))

    def buckets(self) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, its entries)."""
        for b, s, e in zip(self.ids.tolist(), self.cuts[:-1], self.cuts[1:], strict=True):
            yield b, self.by[s:e]

    def chosen(self, bucket: int, bits: bytes) -> np.ndarray:
        """The entries of a bucket whose bit is set."""
        k = int(np.searchsorted(self.ids, bucket))
        mine = self.by[self.cuts[k] : self.cuts[k + 1]]
        return mine[_flags(bits, len(mine))]


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def entries(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> Entries:
    parts = list(anchors(buf, starts, ends))
    if not parts:
        none = np.zeros(0, np.int64)
        return Entries(buf, none, none.astype(np.uint64), none, none, none.astype(np.uint64), buckets)
    place, core, a, b, region = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Entries(buf, place, core, a, b - a, region, buckets)


def strings(buf: np.ndarray, found: Entries, hot: np.ndarray, buckets: int) -> Entries:
    """The SPAN-byte strings in the regions of the ``hot`` entries, as entries by their own hash."""
    flag = np.zeros(len(found.at), bool)
    flag[hot] = True
    i = np.nonzero(flag[found.of])[0] if len(flag) else np.zeros(0, np.int64)
    count = found.n[i] - SPAN + 1
    start = np.repeat(found.a[i] - np.cumsum(count) + count, count) + np.arange(count.sum())
    # regions of neighbouring anchors overlap; a start counts once
    start = np.unique(start)
    name = np.zeros(len(start), np.uint64)
    for lo in range(0, len(buf), _SECTION):
        x, y = np.searchsorted(start, [lo, lo + _SECTION])
        if x < y:
            hashes = PrefixHash(buf[lo : lo + _SECTION + SPAN])
            name[x:y] = mixed(hashes.of(start[x:y] - lo, start[x:y] - lo + SPAN))
    return Entries(buf, start, name, start, np.full(len(start), SPAN), name, buckets)


def _told(row: dict, found: Entries, field: str) -> np.ndarray:
    """The entries that a pack's verdicts name."""
    parts = [found.chosen(v["bucket"], v[field]) for v in row["told"] or [] if v[field]]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _entry_rows(buckets: int, hot: bool):
    """A row per bucket with this pack's entries; with ``hot`` those of the strings around its hot cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                buf, starts, ends = _opened(row["lengths"], row["size"], row["data"])
                found = entries(buf, starts, ends, buckets)
                if hot:
                    found = strings(buf, found, _told(row, found, "hot"), buckets)
                rows = [(b, row["pack"], found.core[i].tobytes(), np.packbits(found.twice[i]).tobytes()) for b, i in found.buckets()]
                if rows:
                    yield _batch(rows, _ENTRY)

    return run


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    cols = [pa.array([r[k] for r in rows], _KINDS[kind]) for k, (_, kind) in enumerate(fields)]
    return pa.RecordBatch.from_arrays(cols, [name for name, _ in fields])


def _judge(hot_core: float):
    """For each pack which of its entries in this bucket have a core that repeats, told apart by whether the core is hot."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        core = np.frombuffer(b"".join(r["core"] for r in rows), np.uint64)
        cuts = np.cumsum([0] + [len(r["core"]) // 8 for r in rows])
        twice = np.concatenate([_flags(r["twice"], len(r["core"]) // 8) for r in rows])
        _, group = np.unique(core, return_inverse=True)
        repeated = (np.bincount(group, weights=1 + twice) >= 2)[group]
        hot = repeated & (np.bincount(group) > hot_core)[group]
        ask = repeated & ~hot
        bits = lambda flags, s, e: np.packbits(flags[s:e]).tobytes() if flags[s:e].any() else b""
        out = [(r["pack"], r["bucket"], bits(ask, s, e), bits(hot, s, e)) for r, s, e in zip(rows, cuts[:-1], cuts[1:], strict=True) if repeated[s:e].any()]
        return pa.Table.from_batches([_batch(out, _VERDICT)])

    return run


def _asked(buckets: int, hot: bool):
    """The regions of the entries that a pack is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row in batch.to_pylist():
                buf, starts, ends = _opened(row["lengths"], row["size"], row["data"])
                found = entries(buf, starts, ends, buckets)
                if hot:
                    found = strings(buf, found, _told(row, found, "hot"), buckets)
                raw, rows = buf.tobytes(), []
                for v in row["again" if hot else "told"]:
                    if not v["ask"]:
                        continue
                    i = found.chosen(v["bucket"], v["ask"])
                    at = found.at[i]
                    a, n = found.a[at], found.n[at]
                    data = b"".join([raw[x:y] for x, y in zip(a.tolist(), (a + n).tolist(), strict=True)])
                    before = (found.place[at] - a).astype(np.uint8)
                    twice = np.packbits(found.twice[i]).tobytes()
                    rows.append((v["bucket"], row["pack"], found.core[i].tobytes(), before.tobytes(), n.astype(np.uint16).tobytes(), twice, squeeze.compress(data)))
                if rows:
                    yield _batch(rows, _REGION)

    return run


# the sort


def _common(hashes: PrefixHash, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length, up to ``most``, of the common extension of the suffixes at i and j."""
    n = np.zeros(len(i), np.int64)
    step = 1 << max(0, int(most.max(initial=1)).bit_length() - 1)
    while step:
        fits = n + step <= most
        a, b = (i + n)[fits], (j + n)[fits]
        same = hashes.of(a, a + step) == hashes.of(b, b + step)
        n[np.nonzero(fits)[0][same]] += step
        step >>= 1
    return n


def suffix_sort(buf: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge sort of suffixes within their groups: (order, extension shared with the one before).

    ``group`` is sorted.  All runs of a level, of all groups longer than a run,
    merge at once: each suffix finds its place in the opposite run by binary search.
    """
    buf = buf if len(buf) else np.zeros(1, np.uint8)  # where all suffixes are empty
    hashes, n = PrefixHash(buf), len(start)
    order = np.arange(n)
    if not n:
        return order, np.zeros(0, np.int64)
    last = len(buf) - 1

    def before(i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        si, sj, li, lj = start[i], start[j], length[i], length[j]
        most = np.minimum(li, lj)
        c = _common(hashes, si, sj, most)
        less = buf[np.minimum(si + c, last)] < buf[np.minimum(sj + c, last)]
        return np.where(c < most, less, (li < lj) | ((li == lj) & ties))

    edge = np.nonzero(np.diff(group, prepend=group[0] - 1))[0]
    sizes = np.diff(np.append(edge, n))
    begin, many = np.repeat(edge, sizes), np.repeat(sizes, sizes)
    width = 1
    while True:
        at = np.nonzero(many > width)[0]  # places in groups of more than one run
        if not len(at):
            break
        local = at - begin[at]
        run = local // width
        left = run % 2 == 0
        other = np.where(left, run + 1, run - 1) * width
        lo = np.zeros(len(at), np.int64)
        hi = np.clip(many[at] - other, 0, width)
        other += begin[at]
        # a right suffix goes after equal left ones, a left one before equal right ones
        while True:
            open_ = np.nonzero(lo < hi)[0]
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            less = before(order[other[open_] + mid], order[at[open_]], ~left[open_])
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        target = begin[at] + run // 2 * 2 * width + (local - run * width) + lo
        merged = order.copy()
        merged[target] = order[at]
        order, width = merged, width * 2

    i, j = order[1:], order[:-1]
    most = np.where(group[i] == group[j], np.minimum(length[i], length[j]), 0)
    shared = np.concatenate([[0], _common(hashes, start[i], start[j], most)])
    if not _verified(buf, start[j], start[i], length[j], length[i], most, shared[1:], group[i] == group[j]):
        return _byte_sort(buf, start, length, group)
    return order, shared


def _verified(
    buf: np.ndarray, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, most: np.ndarray, shared: np.ndarray, together: np.ndarray
) -> bool:
    """Whether neighbours share just as many bytes as their hashes say, and stand in the order of their bytes."""
    if not len(x):
        return True
    depth, last = int(most.max()), len(buf) - 1
    padded = np.concatenate([buf, np.zeros(depth + 1, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth + 1)
    cols = np.arange(depth + 1)
    for s in range(0, len(x), 8192):
        part = slice(s, s + 8192)
        a, b = rows[np.minimum(x[part], last)], rows[np.minimum(y[part], last)]
        same = (a == b) & (cols < most[part, None])
        true = same.argmin(axis=1)  # the last column is never the same
        ended = true == most[part]
        at = true[:, None]
        ordered = np.where(ended, nx[part] <= ny[part], np.take_along_axis(a, at, 1)[:, 0] < np.take_along_axis(b, at, 1)[:, 0])
        if (true != shared[part]).any() or not (ordered | ~together[part]).all():
            return False
    return True


def _byte_sort(buf: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same order from the bytes alone, for a hash collision."""
    raw = buf.tobytes()
    keys = [(g, raw[s : s + n]) for g, s, n in zip(group.tolist(), start.tolist(), length.tolist(), strict=True)]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    shared = [0]
    for x, y in zip(order, order[1:], strict=False):
        n = 0
        if keys[x][0] == keys[y][0]:
            a, b = keys[x][1], keys[y][1]
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
        shared.append(n)
    return np.array(order, np.int64), np.array(shared[: len(order)], np.int64)


def _core_groups(buf: np.ndarray, at: np.ndarray, core: np.ndarray) -> np.ndarray:
    """A number for each distinct core, by its bytes; ``core`` holds the hashes."""
    order = np.argsort(core, kind="stable")
    name = core[order]
    new = np.diff(name, prepend=name[:1]) != 0
    i = np.nonzero(~new)[0][1:]
    if _equal(buf, at[order[i]], at[order[i - 1]], np.full(len(i), CORE)).all():
        out = np.empty(len(at), np.int64)
        out[order] = np.cumsum(new)
        return out
    cores = np.lib.stride_tricks.sliding_window_view(buf, CORE)[at]
    return np.unique(np.ascontiguousarray(cores).view(f"V{CORE}").ravel(), return_inverse=True)[1]


def shared_strings(buf: np.ndarray, n: np.ndarray, before: np.ndarray, core: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """For each region around a core the strings that another region of that core has too.

    ``buf`` holds the regions, of ``n`` bytes each, one after the other;
    ``before`` counts the bytes ahead of the core, ``core`` is its hash, and
    ``twice`` tells that the region itself occurs again.  Bit o of the result
    stands for the SPAN bytes that start o bytes ahead of the core.
    """
    ends = np.cumsum(n)
    at = ends - n + before
    group = _core_groups(buf, at, core)
    by = np.argsort(group, kind="stable")
    group, at, before, ends, twice = group[by], at[by], before[by], ends[by], twice[by]
    after = ends - at - CORE
    # only what lies beside the cores is hashed: the bytes after them, and those before them backwards
    ahead, behind = np.cumsum(after) - after, np.cumsum(before) - before
    right, right_lcp = suffix_sort(buf[np.repeat(at + CORE - ahead, after) + np.arange(after.sum())], ahead, after, group)
    left, left_lcp = suffix_sort(buf[np.repeat(at - 1 + behind, before) - np.arange(before.sum())], behind, before, group)
    size = len(by)
    new_right, new_left = (np.concatenate([[True], np.diff(group[o]) != 0]) for o in (right, left))

    def classes(order: np.ndarray, new: np.ndarray, lcp: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        out = np.empty(size, np.int64)
        out[order] = np.cumsum(new | (lcp < depth))
        return out

    # regions that are equal as a whole go on as one, known to occur again
    length = lambda of, order: np.diff(of[order], prepend=-1) != 0
    whole = classes(right, new_right | length(after, right), right_lcp, after[right]) * (size + 1) + classes(left, new_left | length(before, left), left_lcp, before[left])
    _, first, kind, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    again = (count > 1) | (np.bincount(kind, weights=twice) > 0)
    low, high = np.maximum(0, SIDE - after[first]), before[first]  # the strings that a region has: low to high
    full = (_NONE >> (np.uint64(63) - high.astype(np.uint64))) & ~((np.uint64(1) << low.astype(np.uint64)) - np.uint64(1))
    mask = np.where(again, full, np.uint64(0))
    alone = np.bincount(group[first], minlength=int(group[-1]) + 1)[group[first]] == 1
    mixed_ = np.nonzero(~alone)[0]
    for o in range(WINDOW) if len(mixed_) else ():
        who = mixed_[(low[mixed_] <= o) & (high[mixed_] >= o)]
        if len(who) < 2:
            continue
        pair = classes(right, new_right, right_lcp, SIDE - o)[first[who]] * (size + 1) + classes(left, new_left, left_lcp, o)[first[who]]
        _, inverse, seen = np.unique(pair, return_inverse=True, return_counts=True)
        mask[who[seen[inverse] > 1]] |= np.uint64(1) << np.uint64(o)
    out = np.empty(size, np.uint64)
    out[by] = mask[kind]
    return out


def _settle(table: pa.Table) -> pa.Table:
    """Per pack the masks of its entries that were asked for."""
    rows = table.to_pylist()
    take = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
    core, before, n = take("core", np.uint64), take("before", np.uint8).astype(np.int64), take("size", np.uint16).astype(np.int64)
    cuts = np.cumsum([0] + [len(r["core"]) // 8 for r in rows])
    twice = np.concatenate([_flags(r["twice"], e - s) for r, s, e in zip(rows, cuts[:-1], cuts[1:], strict=True)])
    opened = zstandard.ZstdDecompressor()
    raw = b"".join([opened.decompress(r["data"]) for r in rows])
    ends = np.cumsum(n)
    order = np.argsort(core, kind="stable")
    edges = np.nonzero(np.diff(core[order], prepend=~core[order[:1]]))[0]
    mask = np.zeros(len(core), np.uint64)
    s = 0
    while s < len(order):
        # whole cores, about as many as are sorted at once
        k = int(np.searchsorted(edges, s + _SORTED, "right")) - 1
        if edges[k] <= s:
            k += 1
        e = int(edges[k]) if k < len(edges) and s + _SORTED < len(order) else len(order)
        i = order[s:e]
        data = b"".join([raw[x:y] for x, y in zip((ends[i] - n[i]).tolist(), ends[i].tolist(), strict=True)])
        mask[i] = shared_strings(np.frombuffer(data, np.uint8), n[i], before[i], core[i], twice[i])
        s = e
    squeeze = zstandard.ZstdCompressor(level=3)
    out = [(r["pack"], r["bucket"], squeeze.compress(mask[x:y].tobytes())) for r, x, y in zip(rows, cuts[:-1], cuts[1:], strict=True) if mask[x:y].any()]
    return pa.Table.from_batches([_batch(out, _MASK)])


_MASK = "pack long, bucket int, mask binary"


# cutting


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint runs that cover the intervals; touching ones are one run."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    at = np.nonzero(new)[0]
    return a[at], b[np.append(at[1:] - 1, len(b) - 1)]


def _spans(found: Entries, told: list[dict], masks: list[dict]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, end) of the shared strings around a pack's anchors, runs of neighbouring strings as one."""
    of = {v["bucket"]: v["ask"] for v in told or []}
    mask = np.zeros(len(found.at), np.uint64)
    opened = zstandard.ZstdDecompressor()
    for v in masks or []:
        mask[found.chosen(v["bucket"], of[v["bucket"]])] = np.frombuffer(opened.decompress(v["mask"]), np.uint64)
    place, mask = found.place[mask[found.of] != 0], mask[found.of][mask[found.of] != 0]
    low = np.bitwise_count((mask & (~mask + np.uint64(1))) - np.uint64(1)).astype(np.int64)
    count = np.bitwise_count(mask).astype(np.int64)
    run = (mask >> low.astype(np.uint64)) == _NONE >> (np.uint64(64) - count.astype(np.uint64))
    yield place[run] - low[run] - count[run] + 1, place[run] - low[run] + SPAN
    place, mask = place[~run], mask[~run]
    for o in range(WINDOW) if len(place) else ():
        s = place[(mask >> np.uint64(o) & np.uint64(1)) == 1] - o
        yield s, s + SPAN


def _cut_texts(buckets: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("keys"))
            for k, row in enumerate(batch.drop_columns(["keys"]).to_pylist()):
                buf, starts, ends = _opened(row["lengths"], row["size"], row["data"])
                parts = [(np.zeros(0, np.int64),) * 2]
                if row["masks"] or row["whole"]:
                    found = entries(buf, starts, ends, buckets)
                    parts += _spans(found, row["told"], row["masks"])
                    if row["whole"]:
                        parts += _spans(strings(buf, found, _told(row, found, "hot"), buckets), row["again"], row["whole"])
                a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
                # a run per text: runs of neighbouring texts touch but are not one
                text = np.searchsorted(starts, a, "right") - 1
                if len(a):
                    gap = np.int64(2) * text
                    a, b = _merged(a + gap, b + gap)
                n = np.frombuffer(row["lengths"], "<i8")
                yield _rows(keys[k].values, n, buf, starts, a, b, with_text)

    return run


def _rows(
    keys: pa.Array, n: np.ndarray, buf: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray, with_text: bool
) -> pa.RecordBatch:
    """A row per text of a pack; run i of the k-th text that is not empty lies at a[i] - 2k."""
    shifted = starts + 2 * np.arange(len(starts))
    of = np.searchsorted(shifted, a, "right") - 1
    a, b = a - 2 * of, b - 2 * of
    removed = np.bincount(of, weights=b - a, minlength=len(starts)).astype(np.int64)
    spans = np.bincount(of, minlength=len(starts))
    cuts = np.searchsorted(of, np.arange(len(starts) + 1))
    raw = memoryview(buf)
    ends = np.cumsum(n)
    full = np.nonzero(n > 0)[0]
    hashes, kept = [hashlib.sha256(b"").hexdigest()] * len(n), [b""] * len(n)
    for k, i in enumerate(full.tolist()):
        s, digest, parts = int(starts[k]), hashlib.sha256(), []
        for x, y in [*zip(a[cuts[k] : cuts[k + 1]].tolist(), b[cuts[k] : cuts[k + 1]].tolist(), strict=True), (int(ends[i]), 0)]:
            digest.update(raw[s:x])
            if with_text:
                parts.append(raw[s:x])
            s = y
        hashes[i] = digest.hexdigest()
        kept[i] = b"".join(parts)
    n_removed, n_spans = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    n_removed[full], n_spans[full] = removed, spans
    cols = [keys, pa.array(n), pa.array(n_removed), pa.array(n_spans), pa.array(hashes)]
    names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if with_text:
        cols.append(pa.array([x.decode("utf-8", "ignore") for x in kept]))
        names.append("kept_text")
    return pa.RecordBatch.from_arrays(cols, names)


def deduplicated(
    docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False,
    hot_core: int = HOT_CORE, pack_bytes: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256[, kept_text].

    ``kept_text`` joins the bytes that stay; a character cut in half goes.
    """
    pack_bytes = pack_bytes or pack_size(docs)
    base = packs(docs, pack_bytes, key, text)
    size = base.agg(F.sum("size")).head()[0] or 0
    buckets = max(1, -(-size // (max(PACK_BYTES, pack_bytes) // 2)))
    per_pack = lambda rows, name, *columns: rows.groupBy("pack").agg(F.collect_list(F.struct(*columns)).alias(name))
    judged = lambda rows, most: written(rows.groupBy("bucket").applyInArrow(_judge(most), _VERDICT), "verdicts")
    settled = lambda rows: written(rows.groupBy("bucket").applyInArrow(_settle, _MASK), "masks")
    weight = lambda rows, *columns: rows.agg(F.sum(sum((F.length(c) for c in columns), F.lit(64)))).head()[0] or 0
    plain = base.select("pack", "lengths", "size", "data")
    verdicts = judged(plain.mapInArrow(_entry_rows(buckets, False), _ENTRY), hot_core)
    load = weight(verdicts, "ask", "hot")
    told = per_pack(verdicts, "told", "bucket", "ask", "hot")
    asked = plain.join(sent(per_pack(verdicts.where(F.length("ask") > 0), "told", "bucket", "ask"), load, 1), "pack")
    masks = settled(asked.mapInArrow(_asked(buckets, False), _REGION))
    load += weight(masks, "mask")
    hot = verdicts.where(F.length("hot") > 0)
    both = told.join(per_pack(masks, "masks", "bucket", "mask"), "pack", "left")
    if hot.isEmpty():
        none = F.array().cast("array<struct<bucket:int,ask:binary,mask:binary>>")
        both = both.select("*", none.alias("again"), none.alias("whole"))
    else:
        crowded = plain.join(sent(per_pack(hot, "told", "bucket", "hot"), weight(hot, "hot"), 1), "pack")
        once_more = judged(crowded.mapInArrow(_entry_rows(buckets, True), _ENTRY), math.inf)
        again, part = per_pack(once_more, "again", "bucket", "ask"), weight(once_more, "ask")
        whole = settled(crowded.join(sent(again, part, 1), "pack").mapInArrow(_asked(buckets, True), _REGION))
        load += part + weight(whole, "mask")
        both = both.join(again, "pack", "left").join(per_pack(whole, "whole", "bucket", "mask"), "pack", "left")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    cut = base.join(sent(both, load, 1), "pack", "left").mapInArrow(_cut_texts(buckets, with_text), schema)
    return cut.withColumnRenamed("key", key)
