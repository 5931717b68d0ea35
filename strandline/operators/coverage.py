"""Coverage and abundance of genes (AG01-AG04, AG18, AG27, AG42, AG46, FLT07, WN09).

Hits are (gene_id, ref_start, ref_end) in residues, end exclusive; genes are
(gene_id, length) in residues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_good_hit(identity: Column, length: Column, coverage: Column | None = None, least: float | None = None) -> Column:
    """FLT07: identity x length of 30 at least, identity .85, length 20, and coverage if asked for."""
    out = (identity * length >= 30) & (identity >= 0.85) & (length >= 20)
    return out & (coverage >= least) if least is not None else out


def depth_runs(hits: DataFrame) -> DataFrame:
    """AG01: (gene_id, start, end, depth) by a sweep over starts and ends; no row per residue.

    Steps are summed per place before they are sorted, so a gene's sort has at most as many rows as the gene has residues.
    """
    starts = hits.select("gene_id", F.col("ref_start").alias("at"), F.lit(1).alias("d"))
    ends = hits.select("gene_id", F.col("ref_end").alias("at"), F.lit(-1).alias("d"))
    steps = starts.unionByName(ends).groupBy("gene_id", "at").agg(F.sum("d").alias("d"))
    over = Window.partitionBy("gene_id").orderBy("at")
    runs = steps.select("gene_id", F.col("at").alias("start"), F.lead("at").over(over).alias("end"), F.sum("d").over(over).alias("depth"))
    return runs.where(F.col("end").isNotNull() & (F.col("depth") > 0))


def coverage(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """AG02: covered residues, per cent, mean depth, mean coverage and uniformity of every gene with a hit."""
    width = F.least("end", "length") - F.col("start")
    runs = depth_runs(hits).join(genes.select("gene_id", "length"), "gene_id").withColumn("w", width).where("w > 0")
    sums = runs.groupBy("gene_id", "length").agg(
        F.sum("w").alias("covered"), F.sum(F.col("w") * F.col("depth")).alias("bases"), F.sum(F.col("w") * F.col("depth") * F.col("depth")).alias("_sq")
    )
    mean = F.col("bases") / F.col("length")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("_sq") / F.col("length") - mean * mean))
    return sums.select(
        "gene_id", "length", "covered", "bases",
        (100.0 * F.col("covered") / F.col("length")).alias("percent_coverage"),
        mean.alias("mean_coverage"),
        (F.col("bases") / F.col("covered")).alias("mean_depth"),
        (1 - sd / (mean + 1e-6)).alias("uniformity"),
    )


def abundance(hits: DataFrame, genes: DataFrame, reads: int | Column, count: str | None = None) -> DataFrame:
    """AG03, WN09: reads, RPKM and TPM of every gene with a read; ``reads`` is the number of all reads."""
    n = F.sum(count) if count else F.count("*")
    per = hits.groupBy("gene_id").agg(n.alias("reads")).join(genes.select("gene_id", "length"), "gene_id").where("reads > 0 AND length > 0")
    kb = F.col("length") * 3 / 1000.0
    rpk = F.col("reads") / kb
    total = per.agg(F.sum(rpk).alias("_rpk"))
    all_reads = F.lit(reads) if isinstance(reads, int) else reads
    return per.crossJoin(F.broadcast(total)).select(
        "gene_id", "length", "reads", (F.col("reads") * 1e6 / (kb * all_reads)).alias("rpkm"), (rpk / F.col("_rpk") * 1e6).alias("tpm")
    )


def abundance_by_coverage(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """AG04: bases per covered base, beside the coverage columns."""
    return coverage(hits, genes).withColumn("depth_covered", F.col("bases") / (F.col("covered") * 3.0))


def summary(hits: DataFrame, by: list[str]) -> DataFrame:
    """AG18, AG42: reads, distinct genes and identity figures at one grain."""
    return hits.groupBy(*by).agg(
        F.count_distinct("read_id").alias("reads"),
        F.count_distinct("gene_id").alias("genes"),
        F.count("*").alias("hits"),
        F.avg("identity").alias("mean_identity"),
        F.stddev_samp("identity").alias("sd_identity"),
        F.max("identity").alias("best_identity"),
    )


def confidence(percent: Column, depth: Column) -> Column:
    """AG18: the confidence that a gene is present."""
    return F.when((percent >= 95) & (depth >= 10), "HIGH").when((percent >= 80) & (depth >= 5), "MODERATE").otherwise("LOW")


def gene_report(rows: DataFrame) -> DataFrame:
    """ST02: genes (gene_id, tpm, ...) by falling TPM, then by id."""
    return rows.orderBy(F.desc("tpm"), "gene_id")


def family_report(rows: DataFrame) -> DataFrame:
    """ST02: (family, gene_id, reads, tpm, mean_identity) summed by family, by falling TPM, then by name."""
    per = rows.groupBy("family").agg(
        F.array_join(F.array_sort(F.collect_set(F.col("gene_id").cast("string"))), ", ").alias("variants"),
        F.sum("reads").alias("reads"), F.sum("tpm").alias("tpm"), (F.sum(F.col("mean_identity") * F.col("reads")) / F.sum("reads")).alias("mean_identity"),
    )
    return per.orderBy(F.desc("tpm"), "family")
