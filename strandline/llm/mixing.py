"""Mixing sources to target weights by systematic sampling.

A source's target is its weight's part of a share of all words, at most
``most`` times its own words; what is above goes to the other sources by weight
until none is above.  Inside a source every document is expected target / words
times.  The documents stand in a row, longest first, their expected copies are
summed up from the first on, one random offset below 1 is added to all sums,
and a document is emitted once for each integer that its sum crosses: the
integer part of the expected copies, or one more.  Long documents stand beside
long ones, so what a source gives is off its target by about one document.

The sums are whole numbers (rank x target + offset, divided by the source's
words) in decimals of 38 digits, so no rounding can add or lose a copy, and no
document exceeds ``most`` copies.  The offset and the order of documents of one
length come from MD5 of the seed and of ids: reruns agree.

At scale: ranks come from a range sort by source, length and id over small
rows.  Ranges split a source wherever it is large, so a source that holds a
third of all rows is many tasks; rows alike in all of these are told apart by
their place in the written table.  A range's first rank in each source is a sum
over a table with a row per range and source.  Targets take a row of sums per
round on the driver, however many sources there are.

Defined results: a null source is a source of its own, after all others; a null
or empty text has size 0 and is never counted as taken; very long texts are
counted whole; repeated rows and null ids are documents of their own; a source
without a word has target 0; extra columns are not read (``mixed`` keeps them,
whatever their names); an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import FILE_BYTES, SPACE_CLASS, files_for, keep, scratch, sent, table_bytes, written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
_WORD = SPACE_CLASS.replace("[", "[^") + "+"
_SOURCE = ["_none", "_name"]
_ROW = (1 << 33) - 1  # monotonically_increasing_id: the partition above these bits, the row in it below


def ranked(df: DataFrame, group: list[str], order: list[Column], ranges: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` range-sorted and written with ``_at``, and (``_part``, group, ``_first``, ``_before``) of each range and group.

    A row's rank in its group, from 0, is ``_at - _first + _before``.
    """
    by = [F.col(g) for g in group] + order
    placed = df.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_part", F.shiftright("_at", 33)), name)
    each = placed.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")
    return placed, each.select("_part", *group, "_first", before.alias("_before"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes`` (``_none``, ``_name``, ``_words``, a written row per source) with the target of each source.

    Weights go round in the order of names, by code point.
    """
    n = sizes.count()
    placed, firsts = ranked(sizes, [], [F.col(c) for c in _SOURCE], files_for(sizes.sparkSession, n), "sources")
    rank = (F.col("_at") - F.col("_first") + F.col("_before")) % len(weights)
    weight = reduce(lambda c, i: c.when(rank == i, weights[i]), range(1, len(weights)), F.when(rank == 0, weights[0]))
    weighed = written(placed.join(F.broadcast(firsts), "_part").select(*_SOURCE, "_words", weight.cast("double").alias("_weight")), "weighed", rows=n)
    top = (most * F.col("_words")).cast("double")
    all_words = weighed.agg(F.sum("_words")).first()[0] or 0
    left, parts, full = share * all_words, weighed.agg(F.sum("_weight")).first()[0] or 1.0, 0
    while True:
        wanted = F.col("_weight") * F.lit(left) / F.lit(parts)
        above = wanted > top
        words, rest, count = weighed.agg(F.sum(F.when(above, F.col("_words"))), F.sum(F.when(~above, F.col("_weight"))), F.count_if(above)).first()
        if count == full:  # what is left for the others has only grown, so none has come off
            return weighed.select(*_SOURCE, "_words", F.when(above, top).otherwise(wanted).alias("_target"))
        left, parts, full = share * all_words - most * words, rest or 1.0, count


def _copies(docs: DataFrame, row: Column, key: str, source: str, text: str, weights: tuple[int, ...], share: float, most: int, seed: int) -> DataFrame:
    """(``_row``, ``_size``, ``_words``, ``_target``, ``_copies``) of every row; the mix's own columns start with an underscore."""
    spark = docs.sparkSession
    md5 = lambda *c: F.md5(F.concat(*c).cast("string"))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")
    with scratch():
        lean = docs.select(
            row.alias("_row"), size.alias("_size"), F.col(source).isNull().alias("_none"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_name"), F.col(key).cast("string").alias("_key"),
        )
        lean = written(lean, "sizes")
        rows = lean.count()
        sizes = written(lean.groupBy(*_SOURCE).agg(F.sum("_size").alias("_words")), "source-sizes")
        ranges = max(files_for(spark, rows), -(-table_bytes(lean) // FILE_BYTES))
        order = [F.desc("_size"), F.asc_nulls_last("_hash"), F.asc_nulls_last("_key"), F.col("_tie")]
        lean = lean.withColumns({"_hash": md5(F.col("_key")), "_tie": F.monotonically_increasing_id()})
        placed, firsts = ranked(lean, _SOURCE, order, ranges, "placed")
        offset = F.conv(F.substring(md5(F.lit(str(seed)), F.when(F.col("_none"), "-").otherwise("+"), F.col("_name")), 1, 15), 16, 10).cast("long")
        goals = targets(sizes, weights, share, most).withColumn("_offset", F.when(F.col("_words") > 0, offset % F.col("_words")).otherwise(0))
        firsts = written(firsts.join(goals, _SOURCE), "firsts")
        keep(placed), keep(firsts)
    both = placed.join(sent(firsts, firsts.count(), 256), ["_part", *_SOURCE])
    both = both.withColumn("_rank", F.col("_at") - F.col("_first") + F.col("_before"))
    crossed = "(CAST(_rank + {} AS DECIMAL(18, 0)) * CAST(floor(_target) AS DECIMAL(19, 0)) + CAST(_offset AS DECIMAL(19, 0))) div CAST(_words AS DECIMAL(19, 0))"
    copies = F.when(F.col("_words") > 0, F.expr(crossed.format(1)) - F.expr(crossed.format(0))).otherwise(0)
    return both.select("_row", "_size", "_words", "_target", copies.cast("long").alias("_copies"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0,
    key: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """(key, size, source_size, target, copies, taken) of every document: its words, its source's, and how often it is in the mix."""
    out = _copies(docs, F.col(key), key, source, text, weights, share, most, seed)
    return out.select(
        F.col("_row").alias(key), F.col("_size").alias("size"), F.col("_words").alias("source_size"), F.col("_target").alias("target"),
        F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0,
    key: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    out = _copies(docs, F.struct(*docs.columns), key, source, text, weights, share, most, seed)
    out = out.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select("_row.*")
