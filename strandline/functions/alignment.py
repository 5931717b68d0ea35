"""Alignment scores over Arrow batches (inventory FN20, JN03-JN08, RM01, RM30).

The dynamic programs run row by row in NumPy over all pairs of a batch at once,
so Python's cost is per cell of the largest pair, not per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.sequence import RESIDUES

#: BLOSUM62, rows and columns in the order of ``RESIDUES``.
BLOSUM62 = np.array(
    """
 4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0 -2 -1  0 -4
-1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3 -1  0 -1 -4
-2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3  3  0 -1 -4
-2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3  4  1 -1 -4
 0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1 -3 -3 -2 -4
-1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2  0  3 -1 -4
-1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3 -1 -2 -1 -4
-2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3  0  0 -1 -4
-1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3 -3 -3 -1 -4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1 -4 -3 -1 -4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2  0  1 -1 -4
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1 -3 -1 -1 -4
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1 -3 -3 -1 -4
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2 -2 -1 -2 -4
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2  0  0  0 -4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0 -1 -1  0 -4
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3 -4 -3 -2 -4
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1 -3 -2 -1 -4
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4 -3 -2 -1 -4
-2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4  1 -1 -4
-1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1 -4
-4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4  1
""".split(),
    np.int64,
).reshape(24, 24)

_INDEX = np.full(256, RESIDUES.index("X"), np.int64)
_INDEX[np.frombuffer(RESIDUES.encode(), np.uint8)] = np.arange(len(RESIDUES))


def blosum62(a: Column, b: Column) -> Column:
    """FN20: the score of two residues, as a lookup in an array literal."""
    from strandline.functions.sequence import residue_index

    flat = F.array(*(F.lit(int(x)) for x in BLOSUM62.ravel()))
    return F.get(flat, residue_index(a) * 24 + residue_index(b))


def _codes(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts])
    out = np.full((len(texts), max(1, int(sizes.max(initial=0)))), fill, np.int64)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = np.frombuffer(t.encode("ascii", "replace"), np.uint8)
    return out, sizes


def smith_waterman(
    queries: list[str], targets: list[str], match: int | None = None, mismatch: int = -1, gap: int = -3, band: int | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local scores with a linear gap cost, and where they end (query, target).

    With ``match`` None residues score by BLOSUM62.  ``band`` bounds the
    distance from the main diagonal.  Of equal scores the first by query, then
    by target counts.
    """
    q, nq = _codes(queries, 0)
    t, nt = _codes(targets, 0)
    n, columns = len(queries), t.shape[1]
    if match is None:
        qi, ti = _INDEX[q], _INDEX[t]
    last = np.zeros((n, columns + 1), np.int64)
    best, best_q, best_t = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
    place = np.arange(columns)
    inside = place[None, :] < nt[:, None]
    drop = gap * place
    for i in range(q.shape[1]):
        pair = np.where(q[:, i : i + 1] == t, match, mismatch) if match is not None else BLOSUM62[qi[:, i : i + 1], ti]
        row = np.maximum(0, np.maximum(last[:, :-1] + pair, last[:, 1:] + gap))
        fine = inside & (i < nq)[:, None]
        if band is not None:
            fine &= np.abs(place - i)[None, :] <= band
        row = np.where(fine, row, 0)
        # gaps along the row: running maximum of the scores less their gap cost
        row = np.where(fine, np.maximum(row, np.maximum.accumulate(row - drop, axis=1) + drop), 0)
        top = row.argmax(axis=1)
        value = row[np.arange(n), top]
        better = value > best
        best, best_q, best_t = np.where(better, value, best), np.where(better, i, best_q), np.where(better, top, best_t)
        last[:, 1:] = row
    return best, best_q, best_t


def extend(
    queries: list[str], targets: list[str], q: np.ndarray, t: np.ndarray, seed: int, most: int, side: int, positive: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[dict]]]:
    """Ungapped extension of a seed of each pair on both sides (JN03, JN04), all pairs at once.

    A side stops at its ``most`` + 1-st mismatch, at ``side`` residues or at an
    end.  Returns query starts, target starts, lengths, identities, scores and the
    differences (JN06, at target positions from 0); with ``positive`` a pair of
    positive BLOSUM62 score counts as a match.
    """
    a, na = _codes(queries, 0)
    b, nb = _codes(targets, 0)
    ia, ib = _INDEX[a & 255], _INDEX[b & 255]
    row = np.arange(len(queries))

    def side_of(step: int, first_q: np.ndarray, first_t: np.ndarray) -> np.ndarray:
        n, bad, going = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.ones(len(row), bool)
        for k in range(side):
            i, j = first_q + step * k, first_t + step * k
            going &= (i >= 0) & (j >= 0) & (i < na) & (j < nb) & (bad <= most)
            if not going.any():
                break
            i, j = np.clip(i, 0, a.shape[1] - 1), np.clip(j, 0, b.shape[1] - 1)
            same = BLOSUM62[ia[row, i], ib[row, j]] > 0 if positive else a[row, i] == b[row, j]
            n += going
            bad += going & ~same
        return n

    left, right = side_of(-1, q - 1, t - 1), side_of(1, q + seed, t + seed)
    start, other, n = q - left, t - left, left + seed + right
    place = np.arange(int(n.max(initial=0)))
    inside = place < n[:, None]
    i, j = np.where(inside, start[:, None] + place, 0), np.where(inside, other[:, None] + place, 0)
    worth = np.where(inside, BLOSUM62[ia[row[:, None], i], ib[row[:, None], j]], 0)
    equal = a[row[:, None], i] == b[row[:, None], j]
    fine = (worth > 0 if positive else equal) & inside
    found: list[list[dict]] = [[] for _ in row]
    for r, k in zip(*(x.tolist() for x in np.nonzero(inside & ~equal)), strict=True):
        at, of = int(other[r]) + k, int(start[r]) + k
        found[r].append({"pos": at, "ref": targets[r][at], "alt": queries[r][of], "blosum": int(worth[r, k])})
    return start, other, n, fine.sum(axis=1) / np.maximum(n, 1), worth.sum(axis=1).astype(float), found


def local_score(match: int | None = None, mismatch: int = -1, gap: int = -3, band: int | None = 15):
    """JN05, JN06, JN07, RM01 as a column function of (query, target): struct(score, query_end, target_end)."""

    @F.pandas_udf("score long, query_end long, target_end long")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for query, target in pairs:
            parts = [
                smith_waterman(query.iloc[i : i + 512].fillna("").tolist(), target.iloc[i : i + 512].fillna("").tolist(), match, mismatch, gap, band)
                for i in range(0, len(query), 512)
            ]
            s, a, b = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
            yield pd.DataFrame({"score": s, "query_end": a, "target_end": b})

    return score


def seed_extension(seed: int = 8, most: int = 3, side: int = 30, positive: bool = True):
    """JN03, JN04 as a column function of (query, target, q, t)."""

    @F.pandas_udf("query_start int, ref_start int, length int, identity double, score double, mutations array<struct<pos:int,ref:string,alt:string,blosum:int>>")
    def run(query: pd.Series, target: pd.Series, q: pd.Series, t: pd.Series) -> pd.DataFrame:
        names = ["query_start", "ref_start", "length", "identity", "score", "mutations"]
        parts = []
        for i in range(0, len(query), 1024):
            at = slice(i, i + 1024)
            parts.append(extend(query.iloc[at].tolist(), target.iloc[at].tolist(), q.iloc[at].to_numpy(np.int64), t.iloc[at].to_numpy(np.int64), seed, most, side, positive))
        columns = [np.concatenate([x[k] for x in parts]) if parts else np.zeros(0) for k in range(5)]
        return pd.DataFrame(dict(zip(names, [*columns, [m for x in parts for m in x[5]]], strict=True)))

    return run


def best_ungapped(least_score: int = 30, least_length: int = 15):
    """JN08, RM30 as a column function of (query, target): the best run of any offset without gaps, by BLOSUM62.

    struct(score, offset, start, length): ``offset`` is target place less query
    place, ``start`` the run's place in the query; null where the best run has
    less than ``least_score`` or ``least_length``.  Of equal scores the least
    offset and then the first run counts.
    """

    @F.pandas_udf("score long, offset int, start int, length int")
    def run(query: pd.Series, target: pd.Series) -> pd.DataFrame:
        rows = [ungapped(x, y, least_score, least_length) for x, y in zip(query, target, strict=True)]
        return pd.DataFrame(rows, columns=["score", "offset", "start", "length"]).astype({"score": "Int64", "offset": "Int32", "start": "Int32", "length": "Int32"})

    return run


def ungapped(query: str | None, target: str | None, least_score: int, least_length: int) -> tuple:
    """The best run without gaps over all offsets: all diagonals side by side, each a running sum cut at zero."""
    if not query or not target:
        return None, None, None, None
    (a, _), (b, _) = _codes([query], 0), _codes([target], 0)
    worth = BLOSUM62[_INDEX[a[0] & 255][:, None], _INDEX[b[0] & 255][None, :]]
    n, m = worth.shape
    # row d holds the diagonal of offset d - (n - 1), padded by pairs that end any run
    laid = np.full((n + m - 1, n), -1000)
    i = np.arange(n)[:, None]
    j = np.arange(m)[None, :]
    laid[j - i + n - 1, np.broadcast_to(i, (n, m))] = worth
    total = np.concatenate([np.zeros((n + m - 1, 1), np.int64), np.cumsum(laid, axis=1)], axis=1)
    low = np.minimum.accumulate(total, axis=1)
    gain = total[:, 1:] - low[:, :-1]
    d, end = np.unravel_index(int(gain.argmax()), gain.shape)
    begin = int(np.nonzero(total[d, : end + 1] == low[d, end])[0][-1])
    score, length = int(gain[d, end]), int(end) + 1 - begin
    if score < least_score or length < least_length:
        return None, None, None, None
    return score, int(d) - (n - 1), begin, length
