"""Ranked lexical search: document-at-a-time merges over compressed postings.

``build`` turns documents into shards of about ``SHARD_BYTES`` of text, inside
the tasks that read them: a row holds the shard's document ids in order, the
documents' numbers of terms, the terms in order and for each term its postings,
(place among the ids, occurrences) in place order, as differences in bytes of
seven bits.  No text is shuffled, and a shard's row is bounded, but for a single
document that is larger.

``search`` first sums the documents of each asked term over the shards, then
sends the queries with their weights to the tasks that read the shards.  For each
query a heap of the lists' next places brings up one document after the other,
and a heap of the best ``k``, by score and then smaller id, decides.  A list can
add no more to a score than its own largest posting: the lists that together
stay under the worst of the best are left out of the merge and only looked up
for documents that the others bring up, while it still can matter.  That bound
is exact, so results are whole.  The heaps go on from shard to shard of a task;
the tasks' best are merged in two steps, by buckets of tasks, then all.

Queries are sent in blocks of ``QUERY_BYTES`` of text, counted before: more
queries are more passes over the index.

Scores are whole numbers: floor(1000 ln((2 N + 2) / (2 df + 1))) for a term, times
(10^9 tf) div (1000 tf + 8 m), with m = 100 - b + (b n N) div L; see ``search``.

Defined results: a null or empty text and one without a term are no documents of
N and are never found; a null id comes after all others among equal scores;
repeated rows are documents of their own; rows of one query id with different
texts are one query with all their terms, repeated rows count once, a null query
id is a query like any other, and one without a known term finds nothing; very
long texts are indexed whole; extra columns are not read; an empty table on
either side gives an empty table.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandline.llm.common import sent, slices, written

#: Bytes of text in a shard.
SHARD_BYTES = 8 << 20
#: Bytes of text of the queries that are sent at once.
QUERY_BYTES = 4 << 20
#: Of 100 parts of a document's length, those that count relative to the average.
LENGTH_PARTS = 75
_WORDY = "0123456789abcdefghijklmnopqrstuvwxyz".encode() + bytes(range(128, 256))
_FOLD = bytes(b if b in _WORDY else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of everything beyond ASCII, in UTF-8, only A-Z lower-cased."""
    return (text or "").encode().translate(_FOLD).split()


# postings


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 as bytes of seven bits, the last without the high bit, and each one's end."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        size += values >= 1 << bits
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        more = size > k
        out[ends[more] - size[more] + k] = (values[more] >> (7 * k) & 127) | (size[more] > k + 1) * 128
    return out, ends


def unpacked(raw: np.ndarray) -> np.ndarray:
    """The numbers of ``packed`` bytes."""
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        on = first + k <= last
        out[on] |= (raw[first[on] + k].astype(np.int64) & 127) << (7 * k)
    return out


class _Shard:
    """Documents on their way into a row of the index."""

    def __init__(self) -> None:
        self.keys: list[int | None] = []
        self.known: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, key: int | None, text: str) -> None:
        found = terms(text)
        for t in dict.fromkeys(found):
            self.known.setdefault(t, len(self.known))
        self.keys.append(key)
        self.ids.append(np.fromiter(map(self.known.__getitem__, found), np.int64, len(found)))
        self.size += len(text)

    def columns(self) -> list[list]:
        """The row's cells: keys, lengths, terms, their numbers of documents and their postings."""
        order = sorted(range(len(self.keys)), key=lambda i: (self.keys[i] is None, self.keys[i] or 0))
        lengths = [len(self.ids[i]) for i in order]
        names = sorted(self.known)
        rank = np.zeros(len(names), np.int64)
        rank[[self.known[t] for t in names]] = np.arange(len(names))
        at = np.repeat(np.arange(len(order)), lengths)
        ids = rank[np.concatenate([self.ids[i] for i in order])] if order else at
        pairs, tf = np.unique(ids << 32 | at, return_counts=True)
        of, place = pairs >> 32, pairs & 0xFFFFFFFF
        new = np.diff(of, prepend=-1) > 0
        step = np.where(new, place, np.diff(place, prepend=0))
        raw, ends = packed(np.stack([step, tf], 1).reshape(-1))
        df = np.bincount(of, minlength=len(names))
        stops = ends[2 * np.cumsum(df) - 1] if len(names) else ends
        raw = raw.tobytes()
        postings = [raw[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist(), strict=False)]
        return [[self.keys[i] for i in order], lengths, [t.decode() for t in names], df.tolist(), postings]


_INDEX = {"keys": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "terms": pa.list_(pa.string()), "df": pa.list_(pa.int64()), "postings": pa.list_(pa.binary())}


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index, a written row per shard; ids are whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()

        def row() -> pa.RecordBatch:
            cells = [pa.array([cell], kind) for cell, kind in zip(shard.columns(), _INDEX.values(), strict=True)]
            return pa.RecordBatch.from_arrays(cells, list(_INDEX))

        for batch in batches:
            for part in slices(batch, 1, 1000):
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    shard.add(k, t or "")
                if shard.size >= SHARD_BYTES:
                    yield row()
                    shard = _Shard()
        if shard.keys:
            yield row()

    schema = "keys array<bigint>, lengths array<bigint>, terms array<string>, df array<bigint>, postings array<binary>"
    return written(docs.select(F.col(key).cast("long").alias("key"), text).mapInArrow(run, schema), "index")


# search


def length_norms(n: np.ndarray, docs: int, words: int, parts: int = LENGTH_PARTS) -> np.ndarray:
    """100 - parts + (parts x n x docs) div words of each document, also where the product needs more than 64 bits."""
    if parts * int(n.max(initial=0)) * docs < 1 << 63:
        return 100 - parts + (parts * docs) * n // max(1, words)
    return np.array([100 - parts + parts * x * docs // words for x in n.tolist()], np.int64)


def shard_lists(row: dict, asked: pa.Array, docs: int, words: int) -> dict[str, tuple[list[int], list[int], int]]:
    """(places, parts of the score, the largest part) of each asked term that the shard holds."""
    names = row["terms"].values
    at = np.flatnonzero(pc.is_in(names, value_set=asked).to_numpy(zero_copy_only=False))
    if not len(at):
        return {}
    m = length_norms(row["lengths"].values.to_numpy(), docs, words)
    df = row["df"].values.to_numpy()[at]
    raw = unpacked(np.frombuffer(b"".join(row["postings"].values.take(pa.array(at)).to_pylist()), np.uint8)).reshape(-1, 2)
    ends = np.cumsum(df)
    place = np.cumsum(raw[:, 0])
    place -= np.repeat(np.concatenate([[0], place[ends[:-1] - 1]]), df)
    part = 10**9 * raw[:, 1] // (1000 * raw[:, 1] + 8 * m[place])
    top = np.maximum.reduceat(part, ends - df)
    cut = lambda x: [x[a:b] for a, b in zip((ends - df).tolist(), ends.tolist(), strict=True)]
    return dict(zip(names.take(pa.array(at)).to_pylist(), zip(cut(place.tolist()), cut(part.tolist()), top.tolist(), strict=True), strict=True))


def merge(lists: list[tuple[int, list[int], list[int], int]], keys: list[int | None], best: list[tuple], k: int) -> None:
    """The documents of a shard into ``best``, a heap of at most ``k`` (score, has an id, -id).

    ``lists`` has (weight, places, parts, largest part) of each term of the query.
    """
    lists = sorted(lists, key=lambda x: x[0] * x[3])
    bound, total = [], 0  # what the lists up to each can add
    for weight, _, _, top in lists:
        bound.append(total := total + weight * top)
    least = best[0][0] if len(best) == k else 1
    need = bisect_left(bound, least)  # the lists before this one cannot make a result alone
    at = [0] * len(lists)
    heap = [(lists[j][1][0], j) for j in range(need, len(lists))]
    heapq.heapify(heap)
    while heap:
        place, score = heap[0][0], 0
        while heap and heap[0][0] == place:
            j = heap[0][1]
            weight, places, parts, _ = lists[j]
            i = at[j]
            score += weight * parts[i]
            at[j] = i = i + 1
            if i < len(places):
                heapq.heapreplace(heap, (places[i], j))
            else:
                heapq.heappop(heap)
        for j in range(need - 1, -1, -1):
            if score + bound[j] < least:
                break
            weight, places, parts, _ = lists[j]
            at[j] = i = bisect_left(places, place, at[j])
            if i < len(places) and places[i] == place:
                score += weight * parts[i]
        if score < least:
            continue
        key = keys[place]
        entry = (score, key is not None, -(key or 0))
        if len(best) < k:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)
        if len(best) == k and best[0][0] > least:
            least = best[0][0]
            if (now := bisect_left(bound, least)) > need:
                need = now
                heap = [x for x in heap if x[1] >= need]
                heapq.heapify(heap)


def _hits(index: DataFrame, queries: list[tuple[int, dict[str, int]]], docs: int, words: int, k: int) -> DataFrame:
    """(query, part, score, key): each task's best for each query; ``queries`` has (number, weight of each term)."""
    shipped = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(sorted({t for _, q in shipped.value for t in q}), pa.string())
        best: dict[int, list[tuple]] = {number: [] for number, _ in shipped.value}
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(n).slice(i, 1).flatten() for n, c in enumerate(_INDEX)}
                have = shard_lists({c: _Flat(x) for c, x in row.items()}, asked, docs, words)
                keys = row["keys"].to_pylist()
                for number, weights in shipped.value:
                    if lists := [(w, *have[t]) for t, w in weights.items() if t in have]:
                        merge(lists, keys, best[number], k)
        rows = [(number, s, -x if known else None) for number, heap in best.items() for s, known, x in heap]
        part = pa.array([TaskContext.get().partitionId()] * len(rows), pa.int64())
        number, score, key = (pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ([], [], [])))
        yield pa.RecordBatch.from_arrays([number, part, score, key], ["query", "part", "score", "key"])

    return index.select(*_INDEX).mapInArrow(run, "query long, part long, score long, key long")


class _Flat:
    def __init__(self, values: pa.Array):
        self.values = values


def search(
    index: DataFrame, queries: DataFrame, k: int = 10, query_key: str = "item_id", text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """(query_key, rank, key, score) of the ``k`` best documents of each query with a score above 0.

    With N documents that hold a term, L terms in all of them, n in one, df
    documents with a term and tf of it in one: the score is the sum over the
    query's terms, repeats included, of floor(1000 ln((2 N + 2) / (2 df + 1))) x
    ((10^9 tf) div (1000 tf + 8 m)), m = 25 + (75 n N) div L.
    """
    spark = index.sparkSession
    kind = queries.schema[query_key].dataType
    held = F.filter(F.col("lengths"), lambda n: n > 0)
    total = index.select(F.size(held).alias("docs"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("words"))
    docs, words = total.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    asked = queries.where(F.col(text).isNotNull()).select(F.col(query_key).alias("id"), F.col(text).alias("text")).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    df = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select("x.*")
    out = None
    for block in range(blocks):
        items: dict = {}
        for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toLocalIterator():
            items.setdefault(r["id"], Counter()).update(t.decode() for t in terms(r["text"]))
        names = sorted({t for q in items.values() for t in q})
        wanted = spark.createDataFrame(pa.table({"terms": pa.array(names, pa.string())}))
        found = df.join(sent(wanted, len(names)), "terms").groupBy("terms").agg(F.sum("df").alias("df"))
        weight = {r["terms"]: math.floor(1000 * math.log((2 * docs + 2) / (2 * r["df"] + 1))) for r in found.collect()}  # terms of one block of queries
        numbered = [(i, {t: c * weight[t] for t, c in q.items() if weight.get(t, 0) > 0}) for i, q in enumerate(items.values())]
        hits = _hits(index, [(i, q) for i, q in numbered if q], docs, words, k)
        order = [F.desc("score"), F.asc_nulls_last("key")]
        for bucket in (["query", F.pmod("part", F.lit(64))], ["query"]):
            place = F.row_number().over(Window.partitionBy(*bucket).orderBy(*order))
            hits = hits.withColumn("rank", place).where(F.col("rank") <= k)
        ids = pa.table({"query": pa.array(range(len(items)), pa.int64()), "id": pa.array(list(items), to_arrow_type(kind))})
        named = hits.join(sent(spark.createDataFrame(ids), len(items)), "query")
        named = named.select(F.col("id").alias(query_key), "rank", F.col("key").alias(key), "score")
        out = named if out is None else out.unionByName(named)
    return out
