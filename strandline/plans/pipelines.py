"""The three analyses end to end, as compositions of operators (section 3 of the survey; SNK26, UX10, UX13).

Samples are a column where the input has one; nothing is done sample by sample.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import genes as G
from strandline.functions import sequence as Q
from strandline.functions.scoring import fragment_length
from strandline.operators import alleles, classify, coverage, em, kmers, taxonomy
from strandline.sources import sinks
from strandline.sources.tables import Config
from strandline.storage import written


class Detector(Protocol):
    """UX10: anything that turns reads (read_id, seq) into named result tables."""

    def __call__(self, reads: DataFrame) -> dict[str, DataFrame]: ...


class Pipeline:
    """UX13: the base of the analyses; a subclass returns its result tables by name from ``__call__``."""

    config: Config = Config()

    def __call__(self, reads: DataFrame) -> dict[str, DataFrame]:
        raise NotImplementedError

    def write(self, reads: DataFrame, path: str) -> list[str]:
        """Every result table as Parquet in a folder of its name; the names."""
        self.config.checked()
        results = self(reads)
        for name, rows in results.items():
            sinks.parquet(rows, f"{path}/{name}")
        return list(results)


def frames_of(reads: DataFrame, config: Config) -> DataFrame:
    """Open stretches of all six frames of (read_id, seq): (read_id, frame, start, peptide)."""
    return Q.six_frames(reads.select("read_id", "seq"), "seq", config.min_length)


@dataclass
class GeneQuantification(Pipeline):
    """Reads against resistance proteins: hits, coverage, abundance with expectation-maximisation, and summaries.

    ``proteins`` is (protein_id, protein, gene_name, drug_class).  Reads are
    (read_id, seq), or of pairs (read_id, pair_id, is_r2, seq): then concordant
    mates weigh more, the fragment lengths' mean and deviation come from the pairs
    themselves, and expectation-maximisation runs over pairs.
    """

    proteins: DataFrame
    config: Config = Config()

    def __call__(self, reads: DataFrame) -> dict[str, DataFrame]:
        c = self.config
        paired = "pair_id" in reads.columns
        found = kmers.protein_matches(frames_of(reads, c), self.proteins.select("protein_id", "protein"), c.protein_kmer, 1, c.min_identity, c.min_length, 3, 30, True)
        hits = found.select(
            "read_id", F.col("protein_id").alias("gene_id"), "frame", F.col("ref_start"), (F.col("ref_start") + F.col("length")).alias("ref_end"), "identity", "score"
        )
        genes = self.proteins.select(
            F.col("protein_id").alias("gene_id"), "gene_name", "drug_class", F.length("protein").alias("length"),
            G.gene_family(F.col("gene_name")).alias("family"), G.prior_weight(F.col("gene_name")).alias("prior"),
        )
        hits = hits.join(genes.select("gene_id", F.col("length").alias("_n")), "gene_id").withColumn("coverage", (F.col("ref_end") - F.col("ref_start")) / F.col("_n")).drop("_n")
        if paired:
            hits = em.concordance(hits.join(reads.select("read_id", "pair_id", "is_r2"), "read_id")).drop("pair_score")
        hits = written(hits, "hits")
        n = F.col("ref_end") - F.col("ref_start")
        agree = F.col("concordant") if paired else F.lit(False)
        scored = hits.withColumn("score", G.assignment_score(F.col("identity"), F.col("coverage"), n, agree, F.col("frame")))
        out = {}
        if paired:
            lengths = em.pairs(hits).select(fragment_length(F.col("h1.ref_start"), F.col("h2.ref_end")).alias("length")).where("length > 0")
            out["fragments"] = em.fragment_model(lengths)
            model = out["fragments"].head()
            mean, sd = model.mean or c.fragment_mean, model.sd or c.fragment_sd
            candidates = em.pair_candidates(scored, mean, sd)
        else:
            candidates = scored.groupBy("read_id", "gene_id").agg(F.max("score").alias("score"))
        covered = coverage.coverage(hits, genes)
        total = reads.count()
        expected = em.run(candidates, genes, c.em_rounds, c.em_tolerance, smooth_every=1 if paired else 5, reads_each=2.0 if paired else 1.0)
        abundance = coverage.abundance(hits.select("read_id", "gene_id").distinct(), genes, total)
        identity = hits.groupBy("gene_id").agg(F.avg("identity").alias("mean_identity"))
        return out | {
            "hits": hits,
            "coverage": covered,
            "abundance": abundance,
            "report": coverage.family_report(abundance.join(genes.select("gene_id", "family"), "gene_id").join(identity, "gene_id")),
            "em": expected,
            "families": em.family_rollup(expected),
            "classes": coverage.summary(hits.join(genes.select("gene_id", "drug_class"), "gene_id"), ["drug_class"]),
        }


@dataclass
class MutationScan(Pipeline):
    """Reads against target proteins and known mutations: matches, allele frequencies, calls and a reading.

    ``proteins`` is (protein_id, protein, species, gene), ``known`` (species, gene, pos, wild, mutant, row).
    """

    proteins: DataFrame
    known: DataFrame
    config: Config = Config()

    def __call__(self, reads: DataFrame) -> dict[str, DataFrame]:
        c, keys = self.config, ["species", "gene", "pos"]
        frames = frames_of(reads, c)
        found = kmers.protein_matches(frames, self.proteins.select("protein_id", "protein"), c.protein_kmer, 1, 0.8, c.min_length, 2, 50, False)
        best = kmers.best_with_ties(found, ["read_id"], "score").join(self.proteins.drop("protein"), "protein_id")
        changed = best.select("read_id", "species", "gene", "ref_start", "length", "identity", "mutations")
        # positions from 1; a residue without a mutation is the reference's
        seen = changed.join(self.known.select("species", "gene", "pos", "wild").groupBy("species", "gene", "pos").agg(F.min("wild").alias("wild")), ["species", "gene"])
        seen = seen.where((F.col("pos") > F.col("ref_start")) & (F.col("pos") <= F.col("ref_start") + F.col("length")))
        here = F.filter("mutations", lambda m: m["pos"] + 1 == F.col("pos"))
        text = self.proteins.select("species", "gene", "protein").dropDuplicates(["species", "gene"])
        seen = seen.join(text, ["species", "gene"]).withColumn("residue", F.coalesce(F.get(here, 0)["alt"], F.substring(F.col("protein"), F.col("pos"), F.lit(1))))
        piled = seen.groupBy("species", "gene", "pos", "residue").agg(F.count("*").alias("n"))
        table = alleles.wild_types(self.known, keys)
        verdict = seen.join(self.known.select("species", "gene", "pos", F.col("mutant").alias("residue")).distinct(), [*keys, "residue"], "left_semi")
        counts = verdict.agg(F.coalesce(F.sum((F.col("identity") > 0.95).cast("int")), F.lit(0)).alias("sure"), F.count("*").alias("known"))
        # mutations in a gene's region, known or not; positions from 1
        each = changed.select("gene", F.explode("mutations").alias("m"))
        counts = counts.crossJoin(each.agg(F.coalesce(F.sum(G.in_qrdr(F.col("gene"), F.col("m.pos") + 1).cast("int")), F.lit(0)).alias("qrdr")))
        return {
            "matches": best,
            "frequencies": alleles.frequencies(piled, table, keys, c.min_depth),
            "calls": alleles.calls(piled, keys, self.known, c.min_depth),
            "reading": counts.select("*", alleles.interpretation(F.col("sure"), F.col("known"), F.col("qrdr")).alias("r")).select("sure", "known", "qrdr", "r.*"),
        }


def build_index(genomes: DataFrame, tree: DataFrame, k: int) -> DataFrame:
    """(kmer, taxon): each canonical k-mer of (taxon, seq) with the deepest taxon that all its genomes share."""
    rows = Q.kmers(genomes.select("taxon", "seq"), "seq", k).select(Q.canonical(F.col("kmer")).alias("kmer"), "taxon").distinct()
    return taxonomy.lca_groups(rows, tree, "kmer", "taxon").select("kmer", F.col("lca").alias("taxon"))


@dataclass
class Profile(Pipeline):
    """Reads against a k-mer index: votes, verdicts, counts, lineages and diversity."""

    index: DataFrame
    taxa: DataFrame
    tree: DataFrame
    config: Config = Config()

    def __call__(self, reads: DataFrame) -> dict[str, DataFrame]:
        asked = Q.kmers(reads.select("read_id", "seq"), "seq", self.config.kmer).select("read_id", Q.canonical(F.col("kmer")).alias("kmer"))
        hits = asked.join(self.index, "kmer")
        total = asked.groupBy("read_id").agg(F.count("*").alias("n"))
        called = classify.by_vote(hits, total=total)
        counts = called.groupBy(F.col("taxon").alias("id")).agg(F.count("*").alias("n"))
        return {
            "calls": called,
            "counts": counts,
            "lineages": taxonomy.lineage_abundance(counts, self.taxa, self.tree),
            "diversity": taxonomy.diversity(counts),
        }


def run_all(reads: DataFrame, **detectors: Detector) -> dict[str, dict[str, DataFrame]]:
    """Several detectors over the same reads."""
    return {name: detect(reads) for name, detect in detectors.items()}
