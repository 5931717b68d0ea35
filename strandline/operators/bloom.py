"""Blocked Bloom filters over packed k-mers (FLT01).

A key sets ``HASHES`` bits of one 64-bit word, so a test reads one word.  A filter is
a table (word, bits): the ``BLOCK`` words from ``word`` on.  Tasks set the bits of
their keys in a range of words, ``PIECE_BYTES`` at most, and send the blocks that have
any, by their places where these are fewer bytes; blocks of the same words are ORed,
so filters of the same number of words merge the same way.  A larger filter is several
pieces, each for its own share of the keys, so keys are tested by the piece that their
word is in.  A direct filter has a bit of its own for each possible key, and is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASHES = 4
BITS_PER_KEY = 16
#: Bytes of a filter that a task holds, and that go to every task at once.
PIECE_BYTES = 128 << 20
#: Words of a block.
BLOCK = 1024
#: Blocks that are turned to rows at once.
_ROWS = 256
#: Least hashes by which distinct keys are counted.
SKETCH = 4096


def words_for(keys: int, bits: int = BITS_PER_KEY) -> int:
    """64-bit words of a filter for ``keys`` keys."""
    return max(1, -(-keys * bits // 64))


def false_positive_rate(keys: int, words: int) -> float:
    """The share of other keys that pass: a word holds a Poisson number of keys."""
    mean = keys / words
    share, out = math.exp(-mean), 0.0
    for j in range(int(mean + 12 * math.sqrt(mean) + 24)):
        out += share * (1 - (1 - 1 / 64) ** (HASHES * j)) ** HASHES
        share *= mean / (j + 1)
    return out


def _hashes(keys: np.ndarray) -> np.ndarray:
    h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _words(h: np.ndarray, words: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(words) >> np.uint64(32)).view(np.int64)


def _bits(h: np.ndarray) -> np.ndarray:
    bits = np.zeros(len(h), np.uint64)
    for i in range(HASHES):
        bits |= np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63))
    return bits.view(np.int64)


def places(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bits) of each key."""
    h = _hashes(keys)
    return _words(h, words), _bits(h)


@dataclass(frozen=True)
class Piece:
    """The words ``start`` to ``start + len(bits)`` of a filter of ``words`` words."""

    words: int
    start: int
    bits: np.ndarray
    direct: bool = False

    def _mine(self, keys: np.ndarray) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """(places of the keys that belong to this piece, None for all; their words in it, their bits)."""
        h = keys if self.direct else _hashes(keys)
        word, mine = keys >> 6 if self.direct else _words(h, self.words), None
        if len(self.bits) < self.words:
            word = word - self.start
            mine = np.flatnonzero(word.view(np.uint64) < np.uint64(len(self.bits)))
            word, h = word[mine], h[mine]
        return mine, word, np.int64(1) << (h & 63) if self.direct else _bits(h)

    def among(self, keys: np.ndarray) -> np.ndarray:
        """The places of the keys that belong to this piece and may be in the filter."""
        mine, word, bits = self._mine(keys)
        hit = np.flatnonzero(self.bits[word] & bits == bits)
        return hit if mine is None else mine[hit]

    def add(self, keys: np.ndarray) -> None:
        """Sets the bits of the keys that belong to this piece: of several keys of a word one is stored in a turn."""
        _, word, bits = self._mine(keys)
        while len(word):
            left = np.flatnonzero(self.bits[word] & bits != bits)
            word, bits = word[left], bits[left]
            self.bits[word] |= bits


Keys = Callable[[pa.RecordBatch], Iterator[np.ndarray]]


def column(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The longs of the first column."""
    yield batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)


def listed(rows: DataFrame, keys: Keys = column) -> DataFrame:
    """The distinct keys of ``rows`` as a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in keys(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(found))], ["kmer"])

    return rows.mapInArrow(run, "kmer long").distinct()


def distinct(rows: DataFrame, keys: Keys = column) -> int:
    """How many distinct keys ``rows`` have, from the ``SKETCH`` least hashes: exact below that, to about 1.6 % above."""
    top = np.uint64(1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.zeros(0, np.uint64)
        for batch in batches:
            for found in keys(batch):
                h = _hashes(found)
                if len(least) == SKETCH:
                    h = h[h < least[-1]]
                if len(h):
                    least = np.unique(np.concatenate([least, h]))[:SKETCH]
        yield pa.RecordBatch.from_arrays([pa.array((least ^ top).view(np.int64))], ["h"])

    least = rows.mapInArrow(run, "h long").distinct().orderBy("h").limit(SKETCH).toArrow()["h"].to_numpy()
    if len(least) < SKETCH:
        return len(least)
    return int((SKETCH - 1) / ((int(least.max()) + (1 << 63) + 1) / (1 << 64)))


def build(rows: DataFrame, words: int, keys: Keys = column, start: int = 0, stop: int | None = None, direct: bool = False) -> DataFrame:
    """FLT01: the filter (word, bits) of the keys of ``rows``, a column of longs if not told; repeated and null keys do no harm.

    A task holds the words from ``start`` up to ``stop``, so a large filter is built range by range.
    """
    stop = words if stop is None else stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = Piece(words, start, np.zeros(stop - start, np.int64), direct)
        for batch in batches:
            for found in keys(batch):
                piece.add(found)
        for at in range(0, len(piece.bits), BLOCK * _ROWS):
            blocks = _sent(piece.bits[at : at + BLOCK * _ROWS], start + at)
            if blocks:
                yield _table(blocks)

    return _ored(rows.mapInArrow(run, "word long, bits binary, places binary"))


def _sent(bits: np.ndarray, start: int) -> list[tuple]:
    """(word, bits, places) of the blocks that have any: the bits as they are, or their places where these are fewer bytes."""
    ends = np.append(np.arange(BLOCK, len(bits), BLOCK), len(bits))
    n = np.add.reduceat(np.bitwise_count(bits.view(np.uint64)).astype(np.int64), ends - np.diff(ends, prepend=0))
    whole = 2 * n >= np.diff(ends, prepend=0) * 8
    at = np.flatnonzero(np.where(np.repeat(whole, np.diff(ends, prepend=0)), 0, bits))
    left, found = bits[at].view(np.uint64), []
    while len(at):  # the lowest bit of each word in a turn
        rest = left & (left - np.uint64(1))
        found.append(at * 64 + np.bitwise_count((left ^ rest) - np.uint64(1)))
        more = np.flatnonzero(rest)
        at, left = at[more], rest[more]
    places = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    cuts = np.searchsorted(places, ends * 64)
    out, before, first = [], 0, 0
    for i, (end, cut) in enumerate(zip(ends.tolist(), cuts.tolist())):
        if whole[i]:
            out.append((start + first, bits[first:end].tobytes(), None))
        elif cut > before:
            out.append((start + first, None, (places[before:cut] - first * 64).astype(np.uint16).tobytes()))
        before, first = cut, end
    return out


def _table(blocks: list[tuple]) -> pa.RecordBatch:
    word, *parts = zip(*blocks)
    return pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), *(pa.array(p, pa.binary()) for p in parts)], ["word", "bits", "places"][: 1 + len(parts)])


def _ored(blocks: DataFrame) -> DataFrame:
    """One row for each ``word``, the OR of its blocks; a task holds its share of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for word, bits, where in zip(*(c.to_pylist() for c in batch.columns)):
                block = sums.setdefault(word, np.zeros(BLOCK, np.int64))
                if bits is None:
                    full = np.zeros(BLOCK * 64, np.uint8)
                    full[np.frombuffer(where, np.uint16)] = 1
                    block |= np.packbits(full, bitorder="little").view(np.int64)
                else:
                    part = np.frombuffer(bits, np.int64)
                    block[: len(part)] |= part
        words = list(sums)
        for i in range(0, len(words), _ROWS):
            yield _table([(w, sums[w].tobytes()) for w in words[i : i + _ROWS]])

    return blocks.repartition("word").mapInArrow(run, "word long, bits binary")


def merged(*filters: DataFrame) -> DataFrame:
    """One filter of several with the same number of words."""
    both = filters[0]
    for other in filters[1:]:
        both = both.unionByName(other)
    return _ored(both.withColumn("places", F.lit(None).cast("binary")))


def _piece(table: DataFrame, words: int, start: int, stop: int, direct: bool = False) -> Piece:
    found, bits = table.toArrow(), np.zeros(stop - start, np.int64)
    for word, part in zip(found["word"].to_pylist(), found["bits"].to_pylist()):
        first, last = max(word, start), min(word + BLOCK, stop)
        bits[first - start : last - start] = np.frombuffer(part, np.int64)[first - word : last - word]
    return Piece(words, start, bits, direct)


def pieces(table: DataFrame, words: int, size: int | None = None) -> Iterator[Piece]:
    """The pieces of a written filter, of at most ``size`` bytes each."""
    each = max(1, (size or PIECE_BYTES) // 8)
    for start in range(0, words, each):
        stop = min(start + each, words)
        yield _piece(table.where((F.col("word") > start - BLOCK) & (F.col("word") < stop)), words, start, stop)


def built(rows: DataFrame, words: int, keys: Keys = column, direct: bool = False) -> Iterator[Piece]:
    """The pieces of the filter of the keys of ``rows``, each built, a pass over the rows, when it is asked for."""
    each = max(1, PIECE_BYTES // 8)
    for start in range(0, words, each):
        stop = min(start + each, words)
        yield _piece(build(rows, words, keys, start, stop, direct), words, start, stop, direct)
