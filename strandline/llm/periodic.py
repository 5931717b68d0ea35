"""Runs of repeating words, found by bit-parallel lags.

The words of a text become numbers, and each bit of the numbers one big integer
with a bit per word, a plane.  For a lag q every plane is XORed with itself
shifted by q, and the results are ORed: a zero says that a word equals the word
q further on.  ANDing the complement with itself, shifted by 1, 2, 4, ...,
leaves a bit only where enough such words stand in a row.  Those stretches are
the runs of period q, unless a run of a smaller period holds them.

A lag's planes stop as soon as nothing is left of them.  From ``SAMPLED`` words
on a lag is first asked at every eighth of itself: a run has at least 3 q equal
words in a row, so 24 samples in a row, and a lag without them has no run.
Samples deep inside a run of a smaller period p are left out, since a run of
period q overlaps it by fewer than p + q words.  So the lags of a text of n
words cost about n log n comparisons and not n * n; planes are made for the few
that are left.

A text's words are held as one 32-bit number each, beside its vocabulary; texts
come in slices bounded in bytes and never leave their task.

Defined results: a null text, one without a word and one without a run have an
empty list of runs, and the collapsed text is the words joined by one space
(empty where there are none); very long texts are handled whole; of runs with
equal starts the one with the smaller period comes first; repeated rows and null
keys are handled each for itself; extra columns are not read; an empty table
gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm.common import slices

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Lags from here on are sampled first, at every eighth of the lag.
SAMPLED = 64
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_GAP = re.compile(r"[\x20\x09-\x0D]")
_CHARS = 1 << 20


def numbered_words(text: str) -> tuple[np.ndarray, list[str]]:
    """A number for each word, in order, and the words by number; the text is cut between words first."""
    known: dict[str, int] = {}
    out, start = [np.zeros(0, np.int32)], 0
    while start < len(text):
        gap = _GAP.search(text, start + _CHARS) if len(text) - start > _CHARS else None
        stop = gap.start() if gap else len(text)
        words = _WORD.findall(text, start, stop)
        for w in dict.fromkeys(words):
            known.setdefault(w, len(known))
        out.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        start = stop
    return np.concatenate(out), list(known)


def _planes(ids: np.ndarray) -> list[int]:
    bits = max(1, int(ids.max()).bit_length())
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(bool), bitorder="little").tobytes(), "little") for b in range(bits)]


def _in_a_row(equal: int, least: int) -> int:
    """The bits of ``equal`` from which on at least ``least`` bits are set."""
    have = 1
    while have < least and equal:
        step = min(have, least - have)
        equal &= equal >> step
        have += step
    return equal


def _starts(planes: list[int], n: int, lag: int, least: int) -> int:
    """A bit for each word from which on ``least`` words equal those ``lag`` further on."""
    inside, differ, left = (1 << (n - lag)) - 1, 0, 0
    for plane in planes:
        differ |= (plane ^ (plane >> lag)) & inside
        left = _in_a_row(inside ^ differ, least)
        if not left:
            break
    return left


def _stretches(bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first bit of each stretch of set bits, and the first after it."""
    edges = bits ^ (bits << 1)
    at = np.nonzero(np.unpackbits(np.frombuffer(edges.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little"))[0]
    return at[::2], at[1::2]


def _may_repeat(ids: np.ndarray, lag: int, least: int, inner: np.ndarray) -> bool:
    """False only if no ``least`` words in a row, outside the depths of known runs, equal those ``lag`` further on."""
    step = lag // 8
    same = ids[: len(ids) - lag : step] == ids[lag::step]
    need = least // step
    if np.count_nonzero(same) < need:
        return False
    for start, stop, period in inner.tolist():
        depth = period + lag
        same[-(-(start + depth) // step) : max(0, -(-(stop - depth) // step))] = False
    other = np.flatnonzero(~same)
    return int(np.diff(other, prepend=-1, append=len(same)).max()) > need


def runs_of(ids: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of every run, by start, then period; ``least_periods`` is 4 or more."""
    n = len(ids)
    found = np.zeros((0, 3), np.int64)
    if n < least_words:
        return found
    planes = _planes(ids)
    first, reach = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the runs so far: starts, and the furthest end up to each
    inner = np.zeros((0, 3), np.int64)  # (start, stop, period) of runs that are long enough to have depths
    for lag in range(1, n // least_periods + 1):
        least = max(least_words - lag, (least_periods - 1) * lag)
        if n < lag + least:
            continue
        if lag >= SAMPLED:
            inner = inner[inner[:, 1] - inner[:, 0] > 2 * (lag + inner[:, 2])]
            if not _may_repeat(ids, lag, least, inner):
                continue
        bits = _starts(planes, n, lag, least)
        if not bits:
            continue
        start, end = _stretches(bits, n)
        stop = end + (least - 1 + lag)
        if len(first):
            before = np.searchsorted(first, start, "right") - 1
            new = (before < 0) | (reach[np.maximum(before, 0)] < stop)
            start, stop = start[new], stop[new]
        if not len(start):
            continue
        found = np.concatenate([found, np.stack([start, stop - start, np.full(len(start), lag)], 1)])
        order = np.argsort(found[:, 0], kind="stable")
        first, reach = found[order, 0], np.maximum.accumulate((found[:, 0] + found[:, 1])[order])
        long = stop - start > 2 * (lag + SAMPLED)
        inner = np.concatenate([inner, np.stack([start, stop, np.full(len(start), lag)], 1)[long]])
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay if each run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS,
) -> DataFrame:
    """(key, n_words, runs array<struct<start, length, period>>, collapsed) of every row."""
    fields = ["start", "length", "period"]
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"

    def one(value: str | None) -> tuple[int, np.ndarray, str]:
        ids, words = numbered_words(value or "")
        found = runs_of(ids, least_words, least_periods)
        kept = ids[kept_words(len(ids), found)] if len(found) else ids
        return len(ids), found, " ".join(map(words.__getitem__, kept.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 200):
                n, found, collapsed = zip(*map(one, part.column(1).to_pylist()), strict=True)
                rows = np.concatenate(found)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                runs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], fields))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), runs, pa.array(collapsed)], [key, "n_words", "runs", "collapsed"])

    return docs.select(key, text).mapInArrow(run, schema)
