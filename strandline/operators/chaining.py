"""Co-linear chains of seeds and anchor pairs (JN23).

A chain is a list of seeds, each beginning where the one before has ended or
later, on both sequences.  It scores ``MATCH`` for each letter of its seeds less
``gap`` for each letter left out between them, on either sequence.  The best chain
that ends in a seed comes from the best one that ended before it: with the gap's
cost split into a part of each seed, that is a maximum over all seeds that end at
or before a place, which a tree of prefix maxima over the reference gives.  Seeds
are taken in order of the read, so n seeds cost n log n and no pair of seeds is
made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH = 10


class _PrefixMaxima:
    """The greatest (value, index) put at or before a place."""

    def __init__(self, size: int):
        self.best = [(-(1 << 62), -1)] * (size + 1)

    def put(self, place: int, value: tuple[int, int]) -> None:
        i = place + 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def upto(self, place: int) -> tuple[int, int]:
        i, out = place + 1, (-(1 << 62), -1)
        while i > 0:
            out = max(out, self.best[i])
            i -= i & -i
        return out


def best_chain(q: np.ndarray, t: np.ndarray, size: np.ndarray, gap: int) -> tuple[int, list[int]]:
    """(score, indexes of the seeds) of the best chain; of equal ones that which ends first on the read, then the reference."""
    order = np.lexsort((size, t, q)).tolist()
    qs, ts, ns = q.tolist(), t.tolist(), size.tolist()
    ends = sorted({a + n for a, n in zip(ts, ns, strict=True)})
    place = {e: i for i, e in enumerate(ends)}
    below = np.searchsorted(np.array(ends), t, "right") - 1  # the last end at or before each start
    maxima, waiting = _PrefixMaxima(len(ends)), 0
    by_end = sorted(order, key=lambda i: qs[i] + ns[i])
    score, before = [0] * len(qs), [-1] * len(qs)
    for i in order:
        while waiting < len(by_end) and qs[by_end[waiting]] + ns[by_end[waiting]] <= qs[i]:
            j = by_end[waiting]  # it ends before this one starts, so its score is known
            maxima.put(place[ts[j] + ns[j]], (score[j] + gap * (qs[j] + ns[j] + ts[j] + ns[j]), -j))
            waiting += 1
        value, j = maxima.upto(int(below[i])) if below[i] >= 0 else (0, 1)
        own = MATCH * ns[i]
        linked = value - gap * (qs[i] + ts[i])
        score[i], before[i] = (own + linked, -j) if j <= 0 and linked > 0 else (own, -1)
    last = max(order, key=lambda i: (score[i], -qs[i] - ns[i], -ts[i] - ns[i]))
    out, i = [], last
    while i >= 0:
        out.append(i)
        i = before[i]
    return score[last], out[::-1]


def chains(seeds: DataFrame, keys: list[str], gap: int = 1, q: str = "q", t: str = "t", size: str = "size") -> DataFrame:
    """(keys, score, seeds, q_start, q_end, t_start, t_end): the best chain of each pair of sequences.

    ``seeds`` has the place on the read, on the reference and the length of each.
    Pairs are dealt by key and read in runs, so a task holds one pair's seeds at a
    time beside an Arrow batch; repeated seeds count once.
    """
    kinds = {f.name: f.dataType.simpleString() for f in seeds.schema.fields}
    columns = ["score", "seeds", "q_start", "q_end", "t_start", "t_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _with_end(batches):
            table = pa.Table.from_batches([batch]) if batch is not None else None
            both = table if held is None else held if table is None else pa.concat_tables([held, table])
            if both is None or not len(both):
                continue
            new = np.zeros(len(both), bool)
            for k in keys:
                values = both[k].combine_chunks()
                code = values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            starts = np.append(np.flatnonzero(np.append(True, new[1:])), len(both))
            stop = len(starts) - 1 if table is None else len(starts) - 2  # the last run may go on
            held = both.slice(int(starts[stop]))
            if not stop:
                continue
            place = [both[c].to_numpy().astype(np.int64) for c in (q, t, size)]
            rows = []
            for a, b in zip(starts[:stop].tolist(), starts[1 : stop + 1].tolist(), strict=True):
                qs, ts, ns = (x[a:b] for x in place)
                score, chain = best_chain(qs, ts, ns, gap)
                first, last = chain[0], chain[-1]
                rows.append((score, len(chain), qs[first], qs[last] + ns[last], ts[first], ts[last] + ns[last]))
            at = pa.array(starts[:stop])
            yield pa.RecordBatch.from_arrays(
                [*(both[k].take(at).combine_chunks() for k in keys), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))], [*keys, *columns]
            )

    wanted = seeds.select(*keys, *(F.col(c).cast("long").alias(c) for c in (q, t, size))).distinct()
    dealt = wanted.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{c} long" for c in columns)]))


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def anchor_pairs(chained: DataFrame, is_gene: DataFrame, pair: str = "pair_id", mate: str = "mate", ref: str = "ref_id", least: int = 0) -> DataFrame:
    """JN23: (pair, gene, anchor, score): mates of a pair of which one chains to a gene and the other to a reference that is none.

    ``is_gene`` is (ref, gene boolean).  Of each mate only its best chain to a gene,
    and to another reference, counts (the smaller reference of equal ones), so a pair
    of mates gives at most two rows, and no product of a pair's hits is made.
    """
    known = chained.where(F.col("score") >= least).join(is_gene, ref)
    best = known.groupBy(pair, mate, "gene").agg(F.max(F.struct("score", (-F.col(ref)).alias("r"))).alias("b"))
    side = lambda gene, name: best.where(F.col("gene") == gene).select(pair, F.col(mate).alias(f"mate_{name}"), (-F.col("b.r")).alias(name), F.col("b.score").alias(f"score_{name}"))
    both = side(True, "gene").join(side(False, "anchor"), pair).where("mate_gene <> mate_anchor")
    return both.select(pair, F.col("mate_gene").alias(mate), "gene", "anchor", (F.col("score_gene") + F.col("score_anchor")).alias("score"))
