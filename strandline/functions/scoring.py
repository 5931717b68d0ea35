"""Numeric scores, categories and bit fields (inventory FN32-FN38, FN36-FN37, FLT04-FLT05, FLT15, FLT19, RM09)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower bounds of the categories 1 to 7.
UNIQUENESS_CUTS = (0.10, 0.30, 0.50, 0.70, 0.80, 0.90, 0.95)
CONSERVATION_CUTS = (0.10, 0.20, 0.30, 0.50, 0.70, 0.85, 0.95)
COOCCURRENCE_CUTS = (0.05, 0.15, 0.30, 0.50, 0.70, 0.85, 0.95)


def category(score: Column, cuts: tuple[float, ...]) -> Column:
    """How many cuts the score reaches (FN33, FN35, RM09)."""
    return sum((F.when(score >= c, 1).otherwise(0) for c in cuts), F.lit(0))


def encode_weight(w: Column) -> Column:
    """FN34: [0, 1] to 0..65535, clamped, rounded down."""
    return F.floor(F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0)) * 65535).cast("int")


def decode_weight(code: Column) -> Column:
    return code / 65535.0


def set_bits(flags: Column, value: Column, shift: int, width: int) -> Column:
    """FN32: ``flags`` with a field replaced."""
    mask = (1 << width) - 1
    return flags.bitwiseAND(F.lit(~(mask << shift))).bitwiseOR(F.shiftleft(value.bitwiseAND(F.lit(mask)), shift))


def get_bits(flags: Column, shift: int, width: int) -> Column:
    return F.shiftright(flags, shift).bitwiseAND(F.lit((1 << width) - 1))


def fragment_length(r1_start: Column, r2_end: Column) -> Column:
    """FN36: bases spanned by a pair of hits in residues; null if the second lies not downstream."""
    return F.when(r2_end > r1_start, (r2_end - r1_start) * 3)


def fragment_probability(length: Column, mean: Column, sd: Column) -> Column:
    """FN37: exp(-z*z/2) within [0.01, 1]; null without a length (greatest and least would pass over it)."""
    z = (length - mean) / sd
    return F.when(z.isNotNull(), F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.exp(-z * z / 2))))


def variant_confidence(count: Column, depth: Column) -> Column:
    """FN38: lower bound of the frequency, less at low depth."""
    p = count / depth
    se = F.sqrt(p * (1 - p) / depth)
    return F.greatest(F.lit(0.0), p - 1.96 * se) * (1 - F.exp(-depth / 100.0))


def contamination(human: Column, adapter: Column, low_complexity: Column, homopolymer: Column) -> Column:
    """FLT15: weighted sum of the flags, at most 7."""
    one = lambda c, w: F.when(c, w).otherwise(0)
    return F.least(F.lit(7), one(human, 4) + one(adapter, 3) + one(low_complexity, 2) + one(homopolymer, 1))


def bloom_size(n: int, fpr: float) -> tuple[int, int]:
    """FLT04: bits and hashes for ``n`` keys at a false positive rate."""
    bits = max(1, math.ceil(-n * math.log(fpr) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(1, n) * math.log(2)))


def bloom_fpr(n: Column, bits: int, hashes: int) -> Column:
    """FLT04: expected false positive rate at ``n`` keys."""
    return F.pow(1 - F.exp(-hashes * n / F.lit(float(bits))), F.lit(hashes))


#: Patterns in messages of failures that a retry cannot mend, and of those it can.
PERMANENT_PATTERNS = (
    "file not found", "permission denied", "invalid fastq", "corrupted file", "malformed input", "invalid sample id", "missing manifest",
)
TRANSIENT_PATTERNS = (
    "connection refused", "timeout", "network", "temporary failure", "resource temporarily unavailable", "cuda out of memory", "gpu memory", "deadlock",
)


def error_class(message: Column, code: Column) -> Column:
    """FLT19: permanent patterns first, then transient ones, then the exit code."""
    low = F.lower(F.coalesce(message, F.lit("")))
    has = lambda patterns: F.coalesce(*(F.when(low.contains(p), F.lit(True)) for p in patterns), F.lit(False))
    return (
        F.when(has(PERMANENT_PATTERNS), "permanent")
        .when(has(TRANSIENT_PATTERNS), "transient")
        .when(code.isin(1, 2, 125, 126, 127), "permanent")
        .when(code.isin(130, 143), "transient")
        .otherwise("unknown")
    )


def retry_delay(retries: Column, jitter: Column, base: int = 60) -> Column:
    """SM03: seconds until the next try; jitter in [0, 1] adds 10 to 30 per cent."""
    return base * F.pow(F.lit(2.0), retries) * (1.1 + 0.2 * jitter)
