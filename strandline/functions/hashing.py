"""Exact 64- and 32-bit hashes over Arrow batches (inventory FN11-FN14, FN21)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from strandline.functions.sequence import residue_index

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


def finalise(x: np.ndarray) -> np.ndarray:
    """FN11: the 64-bit finaliser of MurmurHash3, on unsigned words."""
    x = (x ^ (x >> _SHIFT)) * _M1
    x = (x ^ (x >> _SHIFT)) * _M2
    return x ^ (x >> _SHIFT)


def murmur32(data: bytes, seed: int = 0) -> int:
    """FN13: MurmurHash3_x86_32."""
    mask, h, n = 0xFFFFFFFF, seed, len(data)
    rotate = lambda v, r: (v << r | v >> (32 - r)) & mask
    for i in range(0, n - n % 4, 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & mask
        h = (rotate(h ^ rotate(k, 15) * 0x1B873593 & mask, 13) * 5 + 0xE6546B64) & mask
    if tail := data[n - n % 4 :]:
        k = int.from_bytes(tail, "little") * 0xCC9E2D51 & mask
        h ^= rotate(k, 15) * 0x1B873593 & mask
    h ^= n
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


@F.pandas_udf(LongType())
def murmur_finaliser(key: pd.Series) -> pd.Series:
    """FN11 over longs that hold unsigned bits; nulls count as 0."""
    return pd.Series(finalise(key.fillna(0).to_numpy(np.int64).view(np.uint64)).view(np.int64))


@F.pandas_udf(LongType())
def murmur_seeded(key: pd.Series, seed: pd.Series) -> pd.Series:
    """FN12: the finaliser of key XOR seed."""
    k = key.to_numpy(np.int64).view(np.uint64) ^ seed.to_numpy(np.int64).view(np.uint64)
    return pd.Series(finalise(k).view(np.int64))


def murmur32_all(texts: list[bytes], seed: int = 0) -> np.ndarray:
    """FN13 of many texts: those of one length together, four bytes of all of them at a time."""
    out = np.zeros(len(texts), np.uint32)
    sizes = np.array([len(x) for x in texts])
    rotate = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
    scramble = lambda k: rotate(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    for n in np.unique(sizes).tolist():
        at = np.nonzero(sizes == n)[0]
        rows = np.frombuffer(b"".join(texts[i] for i in at.tolist()), np.uint8).reshape(len(at), n)
        words = np.ascontiguousarray(rows[:, : n - n % 4]).view("<u4")
        h = np.full(len(at), seed, np.uint32)
        for k in range(n // 4):
            h = rotate(h ^ scramble(words[:, k]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        if n % 4:
            tail = sum(rows[:, n - n % 4 + i].astype(np.uint32) << np.uint32(8 * i) for i in range(n % 4))
            h ^= scramble(tail)
        h ^= np.uint32(n)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        out[at] = h ^ (h >> np.uint32(16))
    return out


@F.pandas_udf(LongType())
def murmur_text(text: pd.Series) -> pd.Series:
    """FN13 over UTF-8 text with seed 0."""
    known = text.notna()
    out = pd.Series([None] * len(text), dtype="Int64", index=text.index)
    out[known] = murmur32_all([t.encode() for t in text[known]]).astype(np.int64)
    return out


def _word32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def jenkins(key: Column) -> Column:
    """FN14: one-at-a-time mixing of a 64-bit key folded to 32 bits, as a long of 0 to 2 ** 32 - 1; built-in expressions only."""
    h = _word32(key.bitwiseXOR(F.shiftrightunsigned(key, 32)))
    for left, right in ((10, 6), (3, 11)):
        h = _word32(h + F.shiftleft(h, left))
        h = h.bitwiseXOR(F.shiftright(h, right))
    return _word32(h + F.shiftleft(h, 15))


def compact_hash(key: Column) -> Column:
    """FN14: the low 31 bits of ``jenkins``."""
    return jenkins(key).bitwiseAND(F.lit(0x7FFFFFFF))


def residue_hash(word: Column, prime: int = 31) -> Column:
    """FN21: residues' places in the scoring order as digits to the base ``prime``; exact for words of up to 12 residues."""
    return F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: h * prime + residue_index(c))
