"""Expectation-maximisation for reads that match several genes (AG09-AG17, JN10-JN13, Q1-Q5).

Reads with the same candidate genes at the same scores behave alike in every
round, so ``run`` folds them into one class with a count before it starts, and
writes the classes once.  State is one row per (class, gene) candidate, fixed,
and one per gene, changing, which is sent to all tasks if the genes are few.
Every few rounds the state is written, so the plan does not grow with the
rounds.  Convergence is the largest change of any gene's abundance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandline.functions.scoring import fragment_length, fragment_probability
from strandline.storage import dealt, written

SIMILARITY_WEIGHT = 0.3
PRIOR_SHARE = 0.1


def start(genes: DataFrame) -> DataFrame:
    """(gene_id, length, prior, family): abundance starts at the prior, drawn 30 % to its family's mean (AG15)."""
    mean = F.avg("prior").over(Window.partitionBy("family"))
    return genes.select("gene_id", "length", "prior", "family", (0.7 * F.col("prior") + 0.3 * mean).alias("abundance"))


def e_step(candidates: DataFrame, state: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """AG10, AG12: probabilities of each read's candidate genes (read_id, gene_id, score).

    ``similar`` holds (gene_id, other, similarity) for genes that share a read;
    a candidate is boosted by the best similarity x abundance of the others.
    """
    rows = candidates.join(state.select("gene_id", "length", "abundance"), "gene_id")
    weight = F.col("score") * F.col("abundance") / (F.col("length") + 1e-10)
    if similar is not None:
        others = candidates.select("read_id", F.col("gene_id").alias("other"))
        near = similar.join(state.select(F.col("gene_id").alias("other"), F.col("abundance").alias("_a")), "other")
        boost = candidates.select("read_id", "gene_id").join(others, "read_id").where("gene_id <> other").join(near, ["gene_id", "other"])
        boost = boost.groupBy("read_id", "gene_id").agg(F.max(F.col("similarity") * F.col("_a")).alias("_b"))
        rows = rows.join(boost, ["read_id", "gene_id"], "left")
        weight = weight * (1 + SIMILARITY_WEIGHT * F.coalesce("_b", F.lit(0.0)))
    over = Window.partitionBy("read_id")
    total = F.sum("_w").over(over)
    p = F.when(total > 0, F.col("_w") / total).otherwise(1.0 / F.count("*").over(over))
    count = ["n"] if "n" in candidates.columns else []
    return rows.withColumn("_w", weight).select("read_id", "gene_id", p.alias("p"), *count)


def m_step(assigned: DataFrame, state: DataFrame, reads_each: float = 1.0) -> DataFrame:
    """AG11, AG13: expected reads and abundance of every gene; a pair counts ``reads_each`` = 2."""
    n = F.col("n") if "n" in assigned.columns else F.lit(1)
    got = assigned.groupBy("gene_id").agg((reads_each * F.sum(F.col("p") * n)).alias("reads"))
    rows = state.drop("reads").join(got, "gene_id", "left").withColumn("reads", F.coalesce("reads", F.lit(0.0)))
    return rows.withColumn("abundance", (F.col("reads") + PRIOR_SHARE * F.col("prior")) / (F.col("length") / 1000.0))


def smooth(state: DataFrame, share: float = 0.05) -> DataFrame:
    """AG15: draw each abundance a little to its family's mean."""
    mean = F.avg("abundance").over(Window.partitionBy("family"))
    return state.withColumn("abundance", (1 - share) * F.col("abundance") + share * mean)


def classes(candidates: DataFrame) -> DataFrame:
    """(read_id, gene_id, score) -> (read_id, gene_id, score, n): one stand-in for the n reads with equal candidates."""
    sets = candidates.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("gene_id", "score"))).alias("s"))
    each = sets.groupBy("s").agg(F.min("read_id").alias("read_id"), F.count("*").alias("n"))
    return each.select("read_id", "n", F.explode("s").alias("s")).select("read_id", "s.gene_id", "s.score", "n")


#: A state of up to so many bytes is sent to every task; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def run(
    candidates: DataFrame, genes: DataFrame, rounds: int = 100, tolerance: float = 1e-3, smooth_every: int = 5,
    similar: DataFrame | None = None, reads_each: float = 1.0, cut_every: int = 5,
) -> DataFrame:
    """AG14: (gene_id, length, prior, family, abundance, reads) after convergence or ``rounds``.

    With ``tolerance`` 0 exactly ``rounds`` are made.
    """
    folded = written(classes(candidates).repartition("read_id"), "classes")
    # what does not change comes from here in every round, so a round has its predecessor in its plan once, not twice
    base = written(start(genes), "genes")
    names = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in base.columns if base.schema[c].dataType == StringType()]
    held = base.agg(F.sum(sum(names, F.lit(16 * (len(base.columns) + 2))))).head()[0] or 0  # two words a cell, and what names take beyond
    few = held <= BROADCAST_BYTES
    state = base
    for i in range(1, rounds + 1):
        new = m_step(e_step(folded, F.broadcast(state) if few else state, similar), base, reads_each)
        if smooth_every and i % smooth_every == 0:
            new = smooth(new)
        if i % cut_every == 0:
            new = written(new, "abundances")
            if tolerance:
                moved = new.join(state.select("gene_id", F.col("abundance").alias("_was")), "gene_id").agg(F.max(F.abs(F.col("abundance") - F.col("_was")))).head()[0]
                if moved is None or moved < tolerance:
                    return new
        state = new
    return state


def family_rollup(state: DataFrame, least: float = 0.1) -> DataFrame:
    """AG16: expected reads per family, for genes above ``least`` reads."""
    return state.where(F.col("reads") > least).groupBy("family").agg(F.sum("reads").alias("reads"), F.count("*").alias("genes"), F.sum("abundance").alias("abundance"))


def pairs(hits: DataFrame) -> DataFrame:
    """JN10, JN13: (pair_id, gene_id) with the best hit of either mate; one mate may be missing."""
    best = dealt(hits, "pair_id", "gene_id").groupBy("pair_id", "gene_id", "is_r2").agg(F.max(F.struct("score", "ref_start", "ref_end")).alias("h"))
    one = best.where("NOT is_r2").select("pair_id", "gene_id", F.col("h").alias("h1"))
    two = best.where("is_r2").select("pair_id", "gene_id", F.col("h").alias("h2"))
    return one.join(two, ["pair_id", "gene_id"], "full_outer")


def pair_candidates(hits: DataFrame, mean: float, sd: float) -> DataFrame:
    """AG12: (read_id, gene_id, score) of pairs: both mates' scores, doubled or halved by concordance, and once
    by the fragment's probability where both mates hit; mates that do not follow each other get the least."""
    both = F.col("h1").isNotNull() & F.col("h2").isNotNull()
    length = fragment_length(F.col("h1.ref_start"), F.col("h2.ref_end"))
    p = F.coalesce(fragment_probability(length, F.lit(mean), F.lit(sd)), F.lit(0.01))
    total = F.coalesce("h1.score", F.lit(0.0)) + F.coalesce("h2.score", F.lit(0.0))
    score = total * F.when(both, 2.0 * p).otherwise(0.5)
    return pairs(hits).select(F.col("pair_id").alias("read_id"), "gene_id", score.alias("score"))


def concordance(hits: DataFrame) -> DataFrame:
    """JN11, JN12: both mates on a gene double the score, else it is halved; strict, so one mate alone never counts twice."""
    over = Window.partitionBy("pair_id", "gene_id")
    both = F.max(F.col("is_r2").cast("int")).over(over) + F.max((~F.col("is_r2")).cast("int")).over(over) == 2
    return dealt(hits, "pair_id", "gene_id").withColumn("concordant", both).withColumn("pair_score", F.col("score") * F.when(F.col("concordant"), 2.0).otherwise(0.5))


def fragment_model(lengths: DataFrame, value: str = "length", z: float = 2.0) -> DataFrame:
    """AG17: mean and deviation of fragment lengths, of those within ``z`` deviations where 50 and then 30 are left."""
    first = lengths.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.count(value).alias("n"))
    kept = lengths.crossJoin(F.broadcast(first)).where(F.abs(F.col(value) - F.col("m")) <= z * F.col("s"))
    second = kept.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(value).alias("kept"))
    out = first.crossJoin(second)
    fine = (F.col("n") >= 50) & (F.col("kept") >= 30)
    return out.select(F.when(fine, F.col("mean")).alias("mean"), F.when(fine, F.col("sd")).alias("sd"), "n", "kept")
