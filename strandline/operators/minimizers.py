"""Minimizers as window functions (WN01-WN06, WN10, RM15, RM16, RM22).

Input rows are (key, pos, kmer, h): ``h`` orders the k-mers.  Any order will
do; for unsigned 64-bit hashes pass the hash XOR the sign bit.  Invalid bases
leave gaps in ``pos``, and a run without a gap is searched on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unsigned_order(h: Column) -> Column:
    """A long whose signed order is the unsigned order of ``h``."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def runs(rows: DataFrame, key: str) -> DataFrame:
    """Number the runs of neighbouring places of each key."""
    return rows.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy(key).orderBy("pos")))


def changes(rows: DataFrame, key: str, w: int) -> DataFrame:
    """WN01, WN03, WN06: the least (h, pos) of the last ``w`` k-mers, once per change; leftmost of equals.

    A window counts when it is full, or at the end of a shorter run.
    """
    over = Window.partitionBy(key, "run").orderBy("pos")
    seen = runs(rows, key).select(
        key, "run", "pos", F.min(F.struct("h", "pos", "kmer")).over(over.rowsBetween(-(w - 1), 0)).alias("m"),
        F.row_number().over(over).alias("_i"), F.lead("pos").over(over).isNull().alias("_last"),
    )
    full = seen.where((F.col("_i") >= w) | F.col("_last"))
    moved = full.withColumn("_was", F.lag("m.pos").over(over)).where(F.col("_was").isNull() | (F.col("_was") != F.col("m.pos")))
    return moved.select(key, F.col("m.pos").alias("pos"), F.col("m.kmer").alias("kmer"))


def per_window(rows: DataFrame, key: str, w: int) -> DataFrame:
    """WN02: one minimizer for every full window of ``w`` k-mers."""
    over = Window.partitionBy(key, "run").orderBy("pos")
    seen = runs(rows, key).select(
        key, F.col("pos").alias("window"), F.min(F.struct("h", "pos", "kmer")).over(over.rowsBetween(0, w - 1)).alias("m"),
        F.count("*").over(over.rowsBetween(0, w - 1)).alias("_n"),
    )
    return seen.where(F.col("_n") == w).select(key, "window", F.col("m.pos").alias("pos"), F.col("m.kmer").alias("kmer"))


def of_kmer(kmer: Column, length: int, k: int) -> Column:
    """WN04: the least ``length``-mer inside a k-mer."""
    return F.array_min(F.transform(F.sequence(F.lit(1), F.lit(k - length + 1)), lambda i: F.substring(kmer, i, F.lit(length))))


def local_minima(rows: DataFrame, key: str, side: int = 5) -> DataFrame:
    """WN05: k-mers whose h is the least within ``side`` places on either side."""
    over = Window.partitionBy(key, "run").orderBy("pos").rowsBetween(-side, side)
    return runs(rows, key).withColumn("_m", F.min("h").over(over)).where(F.col("h") == F.col("_m")).drop("_m", "run")


def neighbours(rows: DataFrame, key: str, value: str, side: int = 5) -> DataFrame:
    """WN10: the values of up to ``side`` rows on either side, in order."""
    over = Window.partitionBy(key).orderBy("pos").rowsBetween(-side, side)
    return rows.withColumn("around", F.collect_list(value).over(over))
