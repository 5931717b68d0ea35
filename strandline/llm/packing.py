"""Pattern packing of token pieces by non-negative least squares.

1. ``pieces`` encodes every document, ends it with ``END``, and cuts what is
   longer than a sequence into full pieces, the first being the remainder.
2. The lengths' histogram, at most one row per length, goes to the driver.
3. ``plan`` enumerates patterns of one to three lengths that fill a sequence,
   fits how often each repeats to the histogram by non-negative least squares
   (coordinate descent on the sparse columns), rounds down, and packs what is
   left by best fit in falling order, counts at a time.
4. Every piece gets a rank among those of its length and finds its sequence and
   offset in the plan, whose size depends on the histogram's length alone.

Scale: ranks come from buckets of about the square root of all rows inside a
length, so a length with a third of all rows is spread; no token moves.

Defined results: a null text counts as empty and is one piece of ``END``; a very
long text is cut into as many full pieces as it has; pieces of one length are
interchangeable; repeated rows are packed separately; extra columns are not read; an empty table
gives an empty table.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.bpe import LETTERS, encode
from strandline.llm.common import slices, written

CAPACITY = 1024
END = 2

#: Patterns of three lengths take their smallest length from multiples of this.
THIRD_STEP = 16


class _Tokens:
    """Ids of a ``tokenizers`` file.

    Where the file is plain byte-level BPE whose merges stand in the order of
    their tokens' ids, split by ``pattern``, tiktoken runs the same merges about
    four times as fast; this is verified when the file is loaded.  Any other
    file, and texts with one of the file's special strings, go to ``tokenizers``.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.path, self.slow, self.fast, self.pattern = path, None, None, pattern
        if _is_plain(spec, pattern):
            ranks = {_token_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(x in text for x in self.added):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return encode(text, self.fast)


def _is_plain(spec: dict, pattern: str) -> bool:
    """Whether a file's ids are those of byte-level merges in order of rank, after a split by ``pattern``."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or spec.get("truncation") or split.get("type") != "ByteLevel":
        return False
    if split.get("add_prefix_space") or not split.get("use_regex", True) or pattern != LETTERS:
        return False
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    added = {x["content"] for x in spec.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    single = sorted(i for t, i in vocab.items() if len(t) == 1)
    return made == sorted(set(made)) and sorted([*made, *single]) == sorted(vocab.values()) and len(single) == 256 and (not made or made[0] > single[-1])


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _token_bytes(token: str) -> bytes:
    return bytes(_byte_of()[c] for c in token)


@lru_cache(maxsize=2)
def tokens_of(path: str, pattern: str) -> _Tokens:
    return _Tokens(path, pattern)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` tokens: the remainder first, then full ones."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(
    docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, uid[, ids]) of every document; uid is unique."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, piece int, start long, length long, ids_crc32 long, uid long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path, pattern)
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, 1, 200):
                of, rows, ids = [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    all_ids = np.append(tokens(t or ""), np.uint32(END)).astype("<u4")
                    for k, (start, n) in enumerate(cut(len(all_ids), capacity)):
                        piece = all_ids[start : start + n]
                        of.append(i)
                        rows.append((k, start, n, zlib.crc32(piece.tobytes()), uid))
                        uid += 1
                        if with_ids:
                            ids.append(piece.astype(np.int32))
                cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 4), strict=True)]
                names = [key, "piece", "start", "length", "ids_crc32", "uid"]
                extra = [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of, pa.int64())), *cols, *extra], names + ["ids"] * with_ids
                )

    return docs.select(key, text).mapInArrow(run, schema + ", ids array<int>" * with_ids)


# the plan


def patterns(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Full-enough patterns of one to three of ``lengths``.

    For each length: itself; it and the longest that fits beside it; and it, a
    third from a coarse grid, and the longest that fits beside both.
    """
    have = np.array(sorted(lengths))
    longest = lambda room: int(have[i - 1]) if (i := np.searchsorted(have, room, "right")) else 0
    out = set()
    thirds = sorted({longest(x) for x in range(THIRD_STEP, capacity // 3 + 1, THIRD_STEP)} - {0})
    for a in have.tolist():
        b = longest(capacity - a)
        out.add((a, b) if b and a >= b else (b, a) if b else (a,))
        for c in thirds:
            if (b := longest(capacity - a - c)) :
                out.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(out, reverse=True)


def fit(choices: list[tuple[int, ...]], histogram: dict[int, int], sweeps: int = 40) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths closest to the histogram."""
    left = {n: float(c) for n, c in histogram.items()}
    columns = [tuple((n, p.count(n)) for n in set(p)) for p in choices]
    norms = [sum(k * k for _, k in c) for c in columns]
    x = [0.0] * len(choices)
    scale = max(left.values(), default=1.0)
    for _ in range(sweeps):
        moved = 0.0
        for j, column in enumerate(columns):
            step = sum(left[n] * k for n, k in column) / norms[j]
            new = max(0.0, x[j] + step)
            if (d := new - x[j]) != 0.0:
                for n, k in column:
                    left[n] -= k * d
                x[j] = new
                moved = max(moved, abs(d))
        if moved < 1e-4 * scale:
            break
    return np.array(x)


def best_fit(left: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in falling order, over counts: (pattern, repeats)."""
    open_: dict[int, list[list]] = {}
    for n in sorted(left, reverse=True):
        todo = left[n]
        for room in sorted(r for r in open_ if r >= n):
            if not todo:
                break
            groups = open_.pop(room)
            each = room // n
            for pattern, count in groups:
                whole = min(count, todo // each)
                if whole:
                    open_.setdefault(room - each * n, []).append([pattern + (n,) * each, whole])
                    todo -= whole * each
                if count > whole and todo and todo < each:
                    open_.setdefault(room - todo * n, []).append([pattern + (n,) * todo, 1])
                    whole, todo = whole + 1, 0
                if count > whole:
                    open_.setdefault(room, []).append([pattern, count - whole])
        each = capacity // n
        if todo // each:
            open_.setdefault(capacity - each * n, []).append([(n,) * each, todo // each])
        if todo % each:
            open_.setdefault(capacity - todo % each * n, []).append([(n,) * (todo % each), 1])
    return [(p, c) for groups in open_.values() for p, c in groups]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram exactly."""
    left = {n: c for n, c in histogram.items() if c}
    choices = patterns(list(left), capacity)
    x = fit(choices, left)
    out = []
    for j in np.argsort(-x, kind="stable").tolist():
        p = choices[j]
        repeats = min(int(x[j]), *(left[n] // p.count(n) for n in set(p)))
        if repeats > 0 and sum(p) == capacity:
            out.append((p, repeats))
            for n in p:
                left[n] -= repeats
    return out + best_fit({n: c for n, c in left.items() if c}, capacity)


def places(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Sorted rows (length, first rank, sequence of that rank, offset)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, repeats in planned:
        offset = 0
        for n in pattern:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + repeats
            offset += n
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _ranked(found: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``found`` with each piece's rank from 0 among those of its length."""
    total = sum(histogram.values())
    target = max(512, math.isqrt(total))
    buckets = F.create_map(*(F.lit(x) for n, c in histogram.items() for x in (n, -(-c // target))))
    keyed = found.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.element_at(buckets, F.col("length"))))
    ends = keyed.groupBy("length", "bucket").count()
    over = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("length", "bucket", F.coalesce(F.sum("count").over(over), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("uid")
    keyed = keyed.withColumn("rank", F.row_number().over(within) - 1)
    return keyed.join(starts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "bucket")


def packed(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    found = written(pieces(docs, path, pattern, capacity, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if not histogram:
        out = found.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        return out.where("false")
    at = places(plan(histogram, capacity))
    keys = (at[:, 0] << 44) + at[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (np.asarray(batch.column(c).to_numpy(), np.int64) for c in ("length", "rank"))
            i = np.searchsorted(keys, (n << 44) + rank, "right") - 1
            sequence, offset = at[i, 2] + rank - at[i, 1], at[i, 3]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = columns + ["ids"] * with_ids
    ranked = _ranked(found, histogram).select(*names, F.col("rank").cast("long").alias("rank"))
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
