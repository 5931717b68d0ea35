"""Allele pileups, frequencies, variant calls and their reading (AG05-AG08, AG19, FLT06, FLT09-FLT10, RM02, RM03, RM29, RM31, ST01, ST02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scoring import variant_confidence
from strandline.functions.sequence import translate_codon


def is_valid_match(score: Column, identity: Column, length: Column, peptide: Column) -> Column:
    """FLT06: score 30, identity .70, length 20 at least, and at most half of the residues X or stop."""
    bad = F.length(F.regexp_replace(peptide, "[^X*]", ""))
    return (score >= 30) & (identity >= 0.70) & (length >= 20) & (bad <= 0.5 * F.length(peptide))


def pileup(matches: DataFrame, keys: list[str], start: str = "ref_start", peptide: str = "peptide") -> DataFrame:
    """AG05: counts of (keys, pos, residue); positions from 1; X and stops count for nothing."""
    each = matches.select(*keys, F.col(start).alias("_s"), F.posexplode(F.split(peptide, "")).alias("_i", "residue"))
    fine = each.where((F.col("residue") != "") & ~F.col("residue").isin("X", "*"))
    return fine.groupBy(*keys, (F.col("_s") + F.col("_i") + 1).alias("pos"), "residue").agg(F.count("*").alias("n"))


def shares(piled: DataFrame, keys: list[str]) -> DataFrame:
    """RM29: each residue's share at its position."""
    return piled.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def wild_types(known: DataFrame, keys: list[str]) -> DataFrame:
    """FLT10: wild type and resistant residues per position; of conflicting wild types the first in order, and a flag."""
    return known.groupBy(*keys).agg(
        F.min_by("wild", F.struct("row", "wild")).alias("wild"),
        F.array_sort(F.collect_set("mutant")).alias("resistant"),
        (F.count_distinct("wild") > 1).alias("conflict"),
    )


def frequencies(piled: DataFrame, known: DataFrame, keys: list[str], min_depth: int = 5, least: float = 0.05) -> DataFrame:
    """AG06: at known positions the shares of wild type, dominant mutant and resistant residues.

    ``piled`` is (keys, residue, n), ``known`` (keys, wild, resistant array).
    Of equally frequent mutants the first residue is dominant.
    """
    rows = piled.join(known, keys)
    mutant = F.col("residue") != F.col("wild")
    resistant = mutant & F.array_contains("resistant", F.col("residue"))
    per = rows.groupBy(*keys, "wild").agg(
        F.sum("n").alias("depth"),
        F.sum(F.when(~mutant, F.col("n")).otherwise(0)).alias("_w"),
        F.sum(F.when(resistant, F.col("n")).otherwise(0)).alias("_r"),
        F.min(F.when(mutant, F.struct((-F.col("n")).alias("n"), "residue"))).alias("_d"),
        F.array_sort(F.collect_list(F.when(mutant, F.struct("residue", "n")))).alias("_m"),
    ).where(F.col("depth") >= min_depth)
    share = lambda c: c / F.col("depth")
    notes = F.transform(
        F.filter("_m", lambda m: m["n"] / F.col("depth") >= least),
        lambda m: F.concat("wild", F.col(keys[-1]).cast("string"), m["residue"], F.lit("("), F.floor(100 * m["n"] / F.col("depth")).cast("string"), F.lit("%)")),
    )
    return per.select(
        *keys, "wild", "depth", share(F.col("_w")).alias("wild_share"),
        F.coalesce("_d.residue", F.lit("X")).alias("dominant"), F.coalesce(share(-F.col("_d.n")), F.lit(0.0)).alias("dominant_share"),
        share(F.col("_r")).alias("resistant_share"), F.when(F.size(notes) > 0, F.array_join(notes, ",")).otherwise("None").alias("summary"),
    )


def calls(piled: DataFrame, keys: list[str], known: DataFrame, min_depth: int = 5, least: float = 0.10) -> DataFrame:
    """AG07, AG08: known mutations by depth and frequency, with a lower-bound confidence."""
    deep = piled.withColumn("depth", F.sum("n").over(Window.partitionBy(*keys)))
    called = deep.where((F.col("depth") >= min_depth) & (F.col("n") / F.col("depth") >= least))
    hits = called.join(known.select(*keys, F.col("mutant").alias("residue")).distinct(), [*keys, "residue"], "left_semi")
    return hits.withColumn("share", F.col("n") / F.col("depth")).withColumn("confidence", variant_confidence(F.col("n"), F.col("depth")))


def annotated(matches: DataFrame, known: DataFrame, match_id: str, keys: list[str]) -> DataFrame:
    """RM02, RM03, FLT09: each match's mutations (array of pos, alt) with wild type and verdict."""
    each = matches.select(match_id, *keys, F.explode_outer("mutations").alias("m")).select(match_id, *keys, "m.pos", "m.alt")
    told = each.join(known.select(*keys, "pos", F.col("mutant").alias("alt"), F.lit(True).alias("hit")).distinct(), [*keys, "pos", "alt"], "left")
    told = told.withColumn("hit", F.coalesce("hit", F.lit(False)))
    return told.groupBy(match_id, *keys).agg(F.sum(F.col("hit").cast("int")).alias("known"), F.count("pos").alias("mutations"))


#: The texts and confidences of a report, from the surest reading down.
READINGS = {
    "sure": ("HIGH CONFIDENCE: Fluoroquinolone resistance detected", 0.95),
    "likely": ("MODERATE CONFIDENCE: Fluoroquinolone resistance likely", 0.80),
    "possible": ("LOW CONFIDENCE: Possible fluoroquinolone resistance", 0.60),
    "region": ("QRDR mutations detected - resistance possible but not confirmed", 0.40),
    "none": ("No fluoroquinolone resistance markers detected", 0.05),
}


def interpretation(known_sure: Column, known: Column, qrdr: Column) -> Column:
    """AG19: struct(text, confidence) from the counts of sure and other known mutations and of region mutations."""
    out = lambda name: F.struct(F.lit(READINGS[name][0]).alias("text"), F.lit(READINGS[name][1]).alias("confidence"))
    some = known > 0
    return (
        F.when(some & (known_sure >= 2), out("sure")).when(some & (known_sure == 1), out("likely")).when(some, out("possible"))
        .when(qrdr > 0, out("region")).otherwise(out("none"))
    )


def codon_scan(sequences: DataFrame, known: DataFrame, seq: str = "seq") -> DataFrame:
    """RM31: known mutations (species, gene, pos, wild, mutant) that a gene's own sequence (id, gene, seq) shows at their codon.

    No alignment: the sequence must start with the gene's first codon.
    """
    met = sequences.select("id", "gene", F.col(seq).alias("_s")).join(known.select("gene", "pos", "wild", "mutant").distinct(), "gene")
    codon = F.substring("_s", (F.col("pos") - 1) * 3 + 1, F.lit(3))
    return met.where((F.length("_s") >= F.col("pos") * 3) & (translate_codon(codon) == F.col("mutant"))).select("id", "gene", "pos", "wild", "mutant")


def mutation_report(calls: DataFrame, keys: list[str]) -> DataFrame:
    """ST02: distinct mutations with their counts, the most frequent first, then in order of their keys."""
    return calls.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)
