"""Taxonomy and diversity (GR01, GR02, GR04, GR06-GR10, AG25, AG26, AG28, AG31, AG32, AG40, SNK15-SNK17, RM34, RM35).

A taxonomy is (id, parent, rank, name); a root's parent is null, 0 or itself.
All ancestor questions go through the closure table, built once per taxonomy by
doubling steps, so their cost is a join, not a walk.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.storage import dealt, written

#: A tree of up to so many bytes, 64 a row, is sent to every task; a larger one is joined by a shuffle.
TREE_BYTES = 128 << 20


def closure(taxa: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, ancestor, steps), each taxon with itself at 0, as a table in the shared folder.

    Each round doubles the steps that are known and is written, so a query that
    uses the closure several times reads it and a round's plan is one join.  It
    ends when no taxon has an ancestor further up; more than 2 ** ``rounds``
    steps (or a cycle) raise.
    """
    up = taxa.where(F.col("parent").isNotNull() & (F.col("parent") != 0) & (F.col("parent") != F.col("id")))
    jumps = up.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("steps"))
    out = written(taxa.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("steps")).unionByName(jumps), "closure")
    for i in range(rounds + 1):
        far = out.where(F.col("steps") == 1 << i).select(F.col("id").alias("_id"), F.col("ancestor").alias("_mid"))
        near = out.where("steps > 0").select(F.col("id").alias("_m"), "ancestor", "steps")
        more = far.join(near, F.col("_mid") == F.col("_m")).select(F.col("_id").alias("id"), "ancestor", (F.col("steps") + (1 << i)).alias("steps"))
        more = written(more, "closure")
        if more.isEmpty():
            return out
        out = out.unionByName(more)
    raise RuntimeError(f"the taxonomy is deeper than {1 << rounds}")


def depths(tree: DataFrame) -> DataFrame:
    """GR01: (id, depth), roots at 0."""
    return tree.groupBy("id").agg(F.max("steps").alias("depth"))


def _with(rows: DataFrame, side: DataFrame, key: str, few: bool, how: str) -> DataFrame:
    """``rows`` with the ``side`` (few: sent to all tasks) of their ``key``; else both sides are dealt over tasks of bounded rows."""
    return rows.join(F.broadcast(side), key, how) if few else dealt(rows, key).join(side, key, how)


def _few(tree: DataFrame) -> bool:
    return tree.count() * 64 <= TREE_BYTES


def _paths(tree: DataFrame, key: str, name: str) -> DataFrame:
    """(key, path): a taxon's ancestors from itself up."""
    path = F.array_sort(F.collect_list(F.struct("steps", "ancestor")))
    return tree.where("id IS NOT NULL AND ancestor IS NOT NULL").groupBy(F.col("id").alias(key)).agg(path.alias(name))


def lca_pairs(pairs: DataFrame, tree: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """GR02, GR04, GR06: ``pairs`` with lca, the deepest common ancestor; null without one.

    Among common ancestors the deepest is the one fewest steps above ``a``.
    """
    few, others = _few(tree), [c for c in pairs.columns if c not in (a, b)]
    met = _with(_with(pairs, _paths(tree, a, "_pa"), a, few, "left"), _paths(tree, b, "_pb"), b, few, "left")
    lca = F.get(F.array_intersect("_pa.ancestor", "_pb.ancestor"), F.lit(0))  # in the order of a's path
    up = lambda p, c: F.get(f"{p}.steps", (F.array_position(f"{p}.ancestor", F.col("lca")) - 1).cast("int")).alias(c)
    return met.withColumn("lca", lca).select(a, b, *others, "lca", up("_pa", "up_a"), up("_pb", "up_b"))


def distance(up_a: Column, up_b: Column) -> Column:
    """GR07: steps between two taxa through their ancestor over 20, at most 1; 1 without an ancestor."""
    return F.coalesce(F.least(F.lit(1.0), (up_a + up_b) / 20.0), F.lit(1.0))


def related(up_a: Column, up_b: Column, most: int = 2) -> Column:
    """GR10: whether both are within ``most`` steps of their ancestor."""
    return F.coalesce((up_a <= most) & (up_b <= most), F.lit(False))


def lca_groups(rows: DataFrame, tree: DataFrame, key: str, taxon: str) -> DataFrame:
    """AG32, AG40: (key, lca, n_taxa, spread): deepest ancestor that all taxa of a key share.

    Counting how many taxa reach an ancestor needs no fold, and is the same in any order.
    """
    few = _few(tree)
    each = dealt(rows.select(key, taxon).where(F.col(key).isNotNull()), key).distinct()
    each = each.withColumn("n_taxa", F.count("*").over(Window.partitionBy(key)))
    reach = _with(each, tree.select(F.col("id").alias(taxon), "ancestor", "steps"), taxon, few, "inner")
    reach = reach if few else dealt(reach, key)
    per = reach.groupBy(key, "n_taxa", "ancestor").agg(F.count("*").alias("_n"), F.min("steps").alias("_low"), F.max("steps").alias("_high"))
    common = per.where(F.col("_n") == F.col("n_taxa"))
    best = common.groupBy(key, "n_taxa").agg(F.min(F.struct("_low", "ancestor", "_high")).alias("_m"))
    return best.select(key, F.col("_m.ancestor").alias("lca"), "n_taxa", (F.col("_m._high") - F.col("_m._low")).alias("spread"))


def lineages(taxa: DataFrame, tree: DataFrame, sep: str = "|") -> DataFrame:
    """GR08: (id, lineage) from the root down."""
    named = tree.join(taxa.select(F.col("id").alias("ancestor"), "name"), "ancestor")
    line = F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("o"), "name")))
    return named.groupBy("id").agg(line.alias("l")).select("id", F.array_join(F.col("l.name"), sep).alias("lineage"))


def at_rank(taxa: DataFrame, tree: DataFrame, rank: str) -> DataFrame:
    """GR09: (id, ancestor at ``rank``)."""
    ranked = taxa.where(F.col("rank") == rank).select(F.col("id").alias("ancestor"))
    return tree.join(ranked, "ancestor", "left_semi").select("id", "ancestor")


def rollup(counts: DataFrame, taxa: DataFrame, tree: DataFrame, rank: str) -> DataFrame:
    """SNK16, AG31: counts (id, n) summed at ``rank``, with names."""
    up = counts.join(at_rank(taxa, tree, rank), "id").groupBy("ancestor").agg(F.sum("n").alias("n"))
    return up.join(taxa.select(F.col("id").alias("ancestor"), "name"), "ancestor").select(F.col("ancestor").alias("id"), "name", "n")


def lineage_abundance(counts: DataFrame, taxa: DataFrame, tree: DataFrame) -> DataFrame:
    """SNK15: per cent of all reads under every taxon, with its lineage."""
    total = counts.agg(F.sum("n").alias("_all"))
    under = counts.join(tree, "id").groupBy("ancestor").agg(F.sum("n").alias("n")).withColumnRenamed("ancestor", "id")
    out = under.join(lineages(taxa, tree), "id").crossJoin(F.broadcast(total))
    return out.select("id", "lineage", "n", (100.0 * F.col("n") / F.col("_all")).alias("percent"))


def diversity(counts: DataFrame, value: str = "n", base: float = 2.0, *by: str) -> DataFrame:
    """AG28, RM34: richness, Shannon, Simpson, Pielou, Berger-Parker and Chao1 of positive counts."""
    totals = counts.where(F.col(value) > 0).groupBy(*by).agg(F.sum(value).alias("_t")) if by else counts.where(F.col(value) > 0).agg(F.sum(value).alias("_t"))
    rows = counts.where(F.col(value) > 0)
    rows = rows.join(totals, list(by)) if by else rows.crossJoin(F.broadcast(totals))
    p = F.col(value) / F.col("_t")
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("richness"),
        (-F.sum(p * F.log(p))).alias("_h"),
        F.sum(p * p).alias("_d"),
        F.max(p).alias("berger_parker"),
        F.sum(F.when(F.col(value) == 1, 1).otherwise(0)).alias("_f1"),
        F.sum(F.when(F.col(value) == 2, 1).otherwise(0)).alias("_f2"),
    )
    shannon = F.col("_h") / math.log(base)
    chao = F.col("richness") + F.when(F.col("_f2") > 0, F.col("_f1") * F.col("_f1") / (2.0 * F.col("_f2"))).otherwise(
        F.col("_f1") * (F.col("_f1") - 1) / 2.0
    )
    pielou = F.when(F.col("richness") > 1, F.col("_h") / F.log(F.col("richness"))).otherwise(0.0)
    return sums.select(
        *by, "richness", shannon.alias("shannon"), (1 - F.col("_d")).alias("simpson"), pielou.alias("pielou"), "berger_parker", chao.alias("chao1")
    )


def cumulative(counts: DataFrame, key: str, value: str = "n") -> DataFrame:
    """RM35: running share in falling order, then by key.

    The rows are range-sorted, however often a value is there; a range's running
    sum goes on from the sums of those before it, a row for each range.
    """
    order = [F.desc(value), F.asc(key)]
    placed = written(counts.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy("_range").agg(F.sum(value).alias("_s"))
    ranges = Window.orderBy("_range")  # as many rows as there are ranges
    before = F.coalesce(F.sum("_s").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("_s").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = placed.withColumn("_in", inside).join(F.broadcast(sums.select("_range", before.alias("_above"), every.alias("_all"))), "_range")
    return rows.withColumn("share", (F.col("_above") + F.col("_in")) / F.col("_all")).drop("_in", "_range", "_above", "_all")


def consistency(votes: DataFrame, tree: DataFrame, read: str = "read_id", decay: float = 2.0) -> DataFrame:
    """AG25, AG26: vote-weighted closeness of a read's taxa (read, taxon, votes) to its best taxon.

    Gives the exponential and the linear form; a single taxon scores 1.
    """
    over = Window.partitionBy(read).orderBy(F.desc("votes"), "taxon")
    pairs = lca_pairs(votes.withColumn("best", F.first("taxon").over(over)), tree, "best", "taxon")
    d = distance(F.col("up_a"), F.col("up_b"))
    return pairs.groupBy(read, "best").agg(
        (F.sum(F.exp(-d * decay) * F.col("votes")) / F.sum("votes")).alias("exponential"),
        (F.sum((1 - d) * F.col("votes")) / F.sum("votes")).alias("linear"),
    )
