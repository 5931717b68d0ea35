"""Exact deduplication against a minimal perfect hash of historical digests.

``build_index`` turns the distinct digests of the history into shards of a
minimal perfect hash: a digest's first bytes name its shard, and a cascade of
bit arrays inside the shard gives every digest its own slot from 0 to n - 1.
A slot holds the full digest, the winner's locator (the largest id seen) and
the number of rows.  ``probe`` sends the incoming distinct digests to their
shard, where one vectorised pass finds the slots; since a perfect hash answers
for strangers too, the slot's digest is compared byte by byte, and digests that
differ are nonmembers, which form groups of their own.

Scale: both sides are pre-aggregated per digest before they move, so a digest
with a third of all rows costs one row per map task.  A shard holds about
``SHARD_DIGESTS`` digests of history and input together, whatever their sizes.  The join back to rows is
a sort-merge join, whose hot partitions adaptive execution can split.

Defined results: a null text counts as empty; null ids lose to any other id; of
repeated rows and ties for the winning id one stays; very long texts are hashed
where they lie and never move; extra columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import ascii_lower, keep, scratch, written

SHARD_DIGESTS = 50_000

_INDEX = "shard long, n long, levels array<binary>, digests binary, winners binary, known binary, counts binary, ties binary"
_GROUP = "digest binary, keep_id long, n_keep long, group_size long, member boolean"


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    h = h ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class PerfectHash:
    """A minimal perfect hash over distinct 32-byte digests.

    Level i has a bit per 1.5 keys still unplaced; a key whose bit no other key
    shares is placed there, the rest go on.  A key's slot is its bit's rank.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0] + [int(x.sum()) for x in levels])
        self.ranks = [np.cumsum(x) - x for x in (y.astype(np.int64) for y in levels)]

    @staticmethod
    def _keys(digests: np.ndarray) -> np.ndarray:
        words = digests.reshape(-1, 32)[:, 8:24].copy().view(np.uint64).reshape(-1, 2)
        return words[:, 0] ^ _mix(words[:, 1], 101)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        left, levels = cls._keys(digests), []
        while len(left):
            size = max(8, len(left) * 3 // 2)
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("two digests agree in 128 bits")
        return cls(levels)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot for each digest; -1 where no level has it (a nonmember for sure)."""
        keys = self._keys(digests)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = (_mix(keys[open_], i) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.before[i] + self.ranks[i][at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> list[bytes]:
        return [len(x).to_bytes(8, "little") + np.packbits(x).tobytes() for x in self.levels]

    @classmethod
    def load(cls, blobs: list[bytes]) -> PerfectHash:
        return cls(
            [
                np.unpackbits(np.frombuffer(b, np.uint8, offset=8), count=int.from_bytes(b[:8], "little")).astype(bool)
                for b in blobs
            ]
        )


def _digest_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _longs(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.fill_null(0).to_numpy(), np.int64)


def _build_shard(key: tuple, table: pa.Table) -> pa.Table:
    digests = _digest_matrix(table["digest"])
    mph = PerfectHash.build(digests)
    order = np.argsort(mph.slots(digests))
    known = np.array(table["keep_id"].is_valid().to_numpy(), np.uint8)
    return pa.table(
        {
            "shard": [key[0].as_py()],
            "n": [len(digests)],
            "levels": pa.array([mph.dump()], pa.list_(pa.binary())),
            "digests": [digests[order].tobytes()],
            "winners": [_longs(table["keep_id"])[order].tobytes()],
            "known": [known[order].tobytes()],
            "counts": [_longs(table["group_size"])[order].tobytes()],
            "ties": [_longs(table["n_keep"])[order].tobytes()],
        }
    )


def _probe_shard(key: tuple, incoming: pa.Table, index: pa.Table) -> pa.Table:
    digests = _digest_matrix(incoming["digest"]) if len(incoming) else np.zeros((0, 32), np.uint8)
    valid = np.array(incoming["keep_id"].is_valid().to_numpy(), bool)
    ids, sizes, ties = (_longs(incoming[c]) for c in ("keep_id", "group_size", "n_keep"))
    member = np.zeros(len(digests), bool)
    rest = []
    if len(index):
        row = index.slice(0, 1).to_pylist()[0]
        held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        won, count, tied = (np.frombuffer(row[c], np.int64) for c in ("winners", "counts", "ties"))
        known = np.frombuffer(row["known"], np.uint8).astype(bool)
        slot = PerfectHash.load(row["levels"]).slots(digests)
        found = np.nonzero(slot >= 0)[0]
        same = (held[slot[found]] == digests[found]).all(axis=1)
        at, of = found[same], slot[found[same]]
        member[at] = True
        hit = np.zeros(len(held), bool)
        hit[of] = True
        older = known[of] & (~valid[at] | (won[of] > ids[at]))
        equal = (known[of] == valid[at]) & (~valid[at] | (won[of] == ids[at]))
        ties[at] = np.where(older, tied[of], ties[at] + np.where(equal, tied[of], 0))
        ids[at] = np.where(older, won[of], ids[at])
        valid[at] |= known[of]
        sizes[at] += count[of]
        rest = [held[~hit], won[~hit], known[~hit], tied[~hit], count[~hit]]
    parts = [(digests, ids, valid, ties, sizes, member)]
    if rest:
        parts.append((*rest, np.ones(len(rest[0]), bool)))
    cat = [np.concatenate(x) for x in zip(*parts, strict=True)]
    return pa.table(
        {
            "digest": pa.array([bytes(x) for x in cat[0]], pa.binary()),
            "keep_id": pa.array(cat[1], pa.int64(), mask=~cat[2]),
            "n_keep": pa.array(cat[3], pa.int64()),
            "group_size": pa.array(cat[4], pa.int64()),
            "member": pa.array(cat[5], pa.bool_()),
        }
    )


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards))


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, doc_id, n) -> one row per digest: winner, its number of rows, all rows."""
    top = F.max(F.struct("doc_id", "n"))
    return rows.groupBy("digest").agg(top.alias("_t"), F.sum("n").alias("group_size")).select(
        "digest", F.col("_t.doc_id").alias("keep_id"), F.col("_t.n").alias("n_keep"), "group_size"
    )


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """``grouped`` history -> one row per shard, as a table in the shared folder."""
    keyed = history.withColumn("shard", _shard(F.col("digest"), shards))
    return written(keyed.groupBy("shard").applyInArrow(_build_shard, _INDEX), "mph-index")


def probe(incoming: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Groups of history and incoming rows together; ``member``: the index holds the digest."""
    keyed = incoming.withColumn("shard", _shard(F.col("digest"), shards))
    return keyed.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probe_shard, _GROUP)


def groups(docs: DataFrame, is_history: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(digest, doc_id, n) of every row, and the groups found through the index.

    ``is_history`` tells which rows are already published, a null that a row is
    not; by default those whose id has an even CRC-32, so that one table plays
    both parts.
    """
    if is_history is None:
        is_history = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"), F.coalesce(is_history, F.lit(False)).alias("old"))
    total = docs.count()
    rows = written(rows.groupBy("digest", "doc_id", "old").agg(F.count("*").alias("n")), "digests", total)
    old, new = grouped(rows.where("old")), grouped(rows.where("NOT old"))
    # history and incoming digests meet in the same shards, whichever has more
    shards = max(1, -(-rows.count() // SHARD_DIGESTS))
    with scratch():
        found = keep(written(probe(new, build_index(old, shards), shards), "digest-groups", total))
    return rows, found


def decide(docs: DataFrame, is_history: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, known."""
    rows, found = groups(docs, is_history)
    each = rows.groupBy("digest", "doc_id").agg(F.sum("n").alias("n")) if is_history is not None else rows
    out = each.join(found, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_i"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("member").alias("known"),
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)
    return out.withColumn("kept", kept).drop("_i")


def survivors(docs: DataFrame, is_history: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group.

    Of repeated rows with the winning id the one stays whose JSON form is last,
    so columns that have no order of their own, such as maps, do no harm.
    """
    _, found = groups(docs, is_history)
    keyed = docs.select(F.struct("*").alias("_row"), digest_of(F.col("text")).alias("_digest"))
    found = found.select(F.col("digest").alias("_digest"), "keep_id", "n_keep")
    winners = keyed.join(found, "_digest").where(F.col("_row.doc_id").eqNullSafe(F.col("keep_id")))
    single = winners.where("n_keep = 1").select("_row.*")
    tied = winners.where("n_keep > 1").groupBy("_digest").agg(F.max_by("_row", F.to_json("_row")).alias("_row")).select("_row.*")
    return single.unionByName(tied)


