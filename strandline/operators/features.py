"""Minimizer features (AG33-AG39, FLT12-FLT13, JN18-JN19, RM04-RM09, RM18, RM20, ST05, ST08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scoring import CONSERVATION_CUTS, UNIQUENESS_CUTS, category


def uniqueness(hits: DataFrame, key: str = "kmer", owner: str = "genome_id") -> DataFrame:
    """AG33, RM18: 1 - frequency over owners, squared when frequent; flags for rare and for over half or four fifths (RM20)."""
    total = hits.agg(F.count_distinct(owner).alias("_all"))
    per = hits.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(owner).alias("owners"))
    f = F.col("owners") / F.col("_all")
    score = F.when(f > 0.5, (1 - f) * (1 - f)).otherwise(1 - f)
    out = per.crossJoin(F.broadcast(total)).withColumn("uniqueness", score)
    return out.select(
        key, "n", "owners", "uniqueness", category(F.col("uniqueness"), UNIQUENESS_CUTS).alias("category"),
        (F.col("n") <= 3).alias("rare"), (f > 0.5).alias("common"), (f > 0.8).alias("universal"),
    )


def bucket_score(owners_share):
    """AG34: 255 to 50 by frequency."""
    return F.when(owners_share <= 0.01, 255).when(owners_share <= 0.05, 200).when(owners_share <= 0.2, 150).when(owners_share <= 0.5, 100).otherwise(50)


def feature_table(hits: DataFrame, key: str = "kmer", owner: str = "genome_id", taxon: str = "taxon") -> DataFrame:
    """AG36, AG38, RM06: occurrences, owners, taxa, places and entropy of each minimizer."""
    per = hits.groupBy(key).agg(
        F.count("*").alias("n"), F.count_distinct(owner).alias("owners"), F.count_distinct(taxon).alias("taxa"),
        F.avg("pos").alias("mean_pos"), F.stddev_samp("pos").alias("sd_pos"),
    )
    each = hits.groupBy(key, taxon).agg(F.count("*").alias("c")).join(per.select(key, "n"), key)
    p = F.col("c") / F.col("n")
    entropy = each.groupBy(key).agg((-F.sum(p * F.log2(p))).alias("entropy"))
    ratio = F.col("taxa") / F.col("n")
    return per.join(entropy, key).withColumn("taxa_ratio", ratio).withColumn("conservation", category(ratio, CONSERVATION_CUTS))


def clustered(hits: DataFrame, genome: str = "genome_id", window: int = 100, more: int = 3) -> DataFrame:
    """AG39: hits with more than ``more`` others within ``window`` places.

    Places are cut into blocks of eight windows; a hit within a window of its
    block's edge is shown to the neighbour too, so a genome is many small sorts.
    """
    width = 8 * window
    at = F.floor(F.col("pos") / width)
    blocks = F.array_distinct(F.array(at, F.floor((F.col("pos") - window) / width), F.floor((F.col("pos") + window) / width)))
    shown = hits.select("*", at.alias("_own"), F.explode(blocks).alias("_block"))
    over = Window.partitionBy(genome, "_block").orderBy("pos").rangeBetween(-window, window)
    near = shown.withColumn("near", F.count("*").over(over) - 1).where("_own = _block").drop("_own", "_block")
    return near.withColumn("clustered", F.col("near") > more)


def cooccurrence(hits: DataFrame, genome: str, window: int, key: str = "kmer") -> DataFrame:
    """JN18, AG35: pairs of different minimizers within ``window`` of each other, weighted exp(-2 d / window).

    Places are cut into blocks of ``window``; a hit meets its own block and the
    next, so the join is an equi-join and a genome's length does not matter.
    """
    block = F.floor(F.col("pos") / window)
    a = hits.select(genome, F.col(key).alias("a"), F.col("pos").alias("pa"), F.explode(F.array(block, block + 1)).alias("block"))
    b = hits.select(genome, F.col(key).alias("b"), F.col("pos").alias("pb"), block.alias("block"))
    near = a.join(b, [genome, "block"]).where((F.col("pb") > F.col("pa")) & (F.col("pb") - F.col("pa") <= window) & (F.col("a") != F.col("b")))
    d = F.col("pb") - F.col("pa")
    return near.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(F.exp(-2.0 * d / window)).alias("weight"))


def look_ahead(hits: DataFrame, genome: str, window: int, top: int, key: str = "kmer") -> DataFrame:
    """JN19, ST05: for each minimizer the ``top`` that follow it, weighted 1 / (1 + d)."""
    block = F.floor(F.col("pos") / window)
    a = hits.select(genome, F.col(key).alias("a"), F.col("pos").alias("pa"), F.explode(F.array(block, block + 1)).alias("block"))
    b = hits.select(genome, F.col(key).alias("b"), F.col("pos").alias("pb"), block.alias("block"))
    near = a.join(b, [genome, "block"]).where((F.col("pb") > F.col("pa")) & (F.col("pb") - F.col("pa") <= window))
    scored = near.groupBy("a", "b").agg(F.sum(1.0 / (1 + F.col("pb") - F.col("pa"))).alias("weight"))
    over = Window.partitionBy("a").orderBy(F.desc(F.round("weight", 9)), "b")
    return scored.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= top)


def merged(old: DataFrame, new: DataFrame, key: str = "kmer") -> DataFrame:
    """ST08: two count tables (key, n) as one."""
    return old.select(key, "n").unionByName(new.select(key, "n")).groupBy(key).agg(F.sum("n").alias("n"))
