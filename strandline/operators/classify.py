"""Read classification by votes (AG20-AG23, AG27, AG29-AG30, AG47, FLT05, FLT17, RM17, RM27, JN20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.sequence import kmers
from strandline.storage import dealt


def votes(hits: DataFrame, read: str = "read_id", taxon: str = "taxon") -> DataFrame:
    return dealt(hits, read).groupBy(read, taxon).agg(F.count("*").alias("votes"))


def by_vote(hits: DataFrame, read: str = "read_id", taxon: str = "taxon", total: DataFrame | None = None) -> DataFrame:
    """AG20, RM27: each read's top taxon (lowest of equals) and its share.

    The share is of the read's votes, or of ``total`` (read, n) if given.
    """
    v = votes(hits, read, taxon)
    top = v.groupBy(read).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col(taxon).alias("t"))).alias("b"), F.sum("votes").alias("n"), F.count("*").alias("taxa"))
    if total is not None:
        top = top.drop("n").join(total.select(read, F.col("n")), read)
    return top.select(read, F.col("b.t").alias(taxon), (-F.col("b.v")).alias("votes"), "taxa", (-F.col("b.v") / F.col("n")).alias("confidence"))


def by_pair(hits: DataFrame, pair: str = "pair_id", mate: str = "mate", taxon: str = "taxon", bonus: float = 2.0, least: float = 0.0) -> DataFrame:
    """AG21: votes of both mates; a taxon that both have counts ``bonus`` times."""
    per = dealt(hits, pair).groupBy(pair, taxon).agg(F.count("*").alias("v"), F.count_distinct(mate).alias("mates"))
    scored = per.withColumn("score", F.col("v") * F.when(F.col("mates") > 1, bonus).otherwise(1.0))
    top = scored.groupBy(pair).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(taxon).alias("t"), "mates")).alias("b"), F.sum("score").alias("n"))
    out = top.select(pair, F.col("b.t").alias(taxon), (-F.col("b.s")).alias("score"), (F.col("b.mates") > 1).alias("concordant"), (-F.col("b.s") / F.col("n")).alias("confidence"))
    return out.where(F.col("confidence") >= least)


def diversity_specificity(minimizers: Column, taxa: Column, least: int = 3) -> tuple[Column, Column]:
    specific = F.when(taxa <= 2, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - (taxa - 2) * 0.1))
    return F.when(minimizers >= least, 1.0).otherwise(0.5), specific


def two_stage(
    reads: DataFrame, phylo: bool = True, min_kmers: int = 10, min_minimizers: int = 3, first: float = 0.1, second: float = 0.3, far: float = 0.5
) -> DataFrame:
    """AG22, AG23: two-stage verdict of (best_votes, kmers, minimizers, taxa, phylo_score).

    Stage one asks for votes, their share and distinct minimizers; stage two for
    a weighted sum of share, phylogenetic score, diversity and specificity.
    """
    primary = F.coalesce(F.col("best_votes") / F.nullif(F.col("kmers"), F.lit(0)), F.lit(0.0))
    diverse, specific = diversity_specificity(F.col("minimizers"), F.col("taxa"), min_minimizers)
    if phylo:
        secondary, close = 0.4 * primary + 0.3 * F.col("phylo_score") + 0.2 * diverse + 0.1 * specific, F.col("phylo_score") >= 1 - far
    else:
        secondary, close = 0.5 * primary + 0.3 * diverse + 0.2 * specific, F.lit(True)
    one = (primary >= first) & (F.col("best_votes") >= min_kmers) & (F.col("minimizers") >= min_minimizers)
    out = reads.withColumns({"primary": primary, "secondary": secondary, "passed_1": one})
    out = out.withColumn("passed_2", F.col("passed_1") & (F.col("secondary") >= second) & close)
    return out.withColumn("conflict", (F.col("taxa") > 3) & (F.col("phylo_score") < 0.7))


def within_best(hits: DataFrame, read: str = "read_id", taxon: str = "taxon", share: float = 0.8) -> DataFrame:
    """RM17: all genomes with at least ``share`` of a read's best count."""
    v = votes(hits, read, taxon)
    top = F.max("votes").over(Window.partitionBy(read))
    return v.withColumn("best", top).where(F.col("votes") >= share * F.col("best")).drop("best")


def profiles(matches: DataFrame, sizes: DataFrame) -> DataFrame:
    """AG29, AG47: per organism hits, weight, distinct k-mers, breadth and confidence."""
    per = matches.groupBy("organism").agg(
        F.count("*").alias("hits"), F.sum("weight").alias("weight"), F.count_distinct("kmer").alias("kmers"), F.count_distinct("read_id").alias("reads")
    )
    out = per.join(sizes, "organism").withColumn("breadth", F.col("kmers") / F.col("size"))
    total = per.agg(F.sum("weight").alias("_all"))
    return out.crossJoin(F.broadcast(total)).withColumn("abundance", F.col("weight") / F.col("_all")).drop("_all").withColumn(
        "confidence", F.least(F.lit(1.0), F.log10(F.col("hits") + 1) / 3.0) * F.least(F.lit(1.0), 10 * F.col("breadth"))
    )


def is_present(hits: Column, abundance: Column, breadth: Column, confidence: Column) -> Column:
    """FLT17."""
    return (hits >= 10) & (abundance >= 1e-6) & (breadth >= 0.001) & (confidence >= 0.1)


def pair_concordance(best: DataFrame) -> DataFrame:
    """AG30: per organism the pairs whose mates (pair_id, mate, taxon) agree, and their share."""
    per = best.groupBy("pair_id").agg(F.count_distinct("taxon").alias("t"), F.count_distinct("mate").alias("m"), F.min("taxon").alias("taxon"))
    both = per.where("m = 2 AND t = 1").groupBy("taxon").agg(F.count("*").alias("concordant"))
    seen = best.groupBy("taxon").agg(F.count_distinct("pair_id").alias("pairs"))
    return seen.join(both, "taxon", "left").select(
        "taxon", "pairs", F.coalesce("concordant", F.lit(0)).alias("concordant"), (F.coalesce("concordant", F.lit(0)) / F.col("pairs")).alias("share")
    )


def cascade(keys: DataFrame, *levels: tuple[DataFrame, str, float]) -> DataFrame:
    """FLT05: confidence from membership at each level (table of keys, key column, weight), at most 1."""
    out, score = keys, F.lit(0.0)
    for i, (table, key, weight) in enumerate(levels):
        flag = f"_l{i}"
        out = out.join(table.select(key).distinct().withColumn(flag, F.lit(weight)), key, "left")
        score = score + F.coalesce(flag, F.lit(0.0))
    return out.withColumn("confidence", F.least(F.lit(1.0), score)).drop(*(f"_l{i}" for i in range(len(levels))))


def contained(hits: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """JN20, JN09: hits (key, start, end) inside a region (key, lo, hi, region)."""
    return hits.join(regions, key).where((F.col("start") >= F.col("lo")) & (F.col("end") <= F.col("hi")))


def placements(reads: DataFrame, genomes: DataFrame, k: int = 15, checked: int | None = 50, least: float = 0.8, tile: int = 4096) -> DataFrame:
    """RM26: each read's (read_id, seq) best place in each genome (genome, seq) by identity over its first ``checked`` bases (None: all).

    Places come from k-mers of the read, every ``k`` bases, that the genome has, so no
    read is slid along a genome; of equally good places the first counts: (read_id,
    genome, place, identity, n), n the read's length.  Genomes are cut into tiles
    of ``tile`` bases, each with a read's length of the next, before places meet
    them, so what is shuffled and compared is a tile.
    """
    a = kmers(reads.select("read_id", "seq"), "seq", k, k).select("read_id", "kmer", F.col("pos").alias("q"))
    b = kmers(genomes.select("genome", "seq"), "seq", k).select("genome", "kmer", F.col("pos").alias("t"))
    at = a.join(b, "kmer").where("t >= q").select("read_id", "genome", (F.col("t") - F.col("q")).alias("place")).distinct()
    head = F.col("seq") if checked is None else F.substring("seq", 1, checked)
    longest = reads.agg(F.max(F.length("seq"))).head()[0] or 0
    last = F.floor((F.length("seq") - 1) / tile).cast("int")
    tiles = genomes.where(F.length("seq") > 0).select("genome", "seq", F.explode(F.sequence(F.lit(0), last)).alias("tile"))
    tiles = tiles.select("genome", "tile", F.substring("seq", F.col("tile") * tile + 1, F.lit(tile + longest)).alias("_t"))
    met = at.withColumn("tile", F.floor(F.col("place") / tile).cast("int")).join(reads.select("read_id", head.alias("_r"), F.length("seq").alias("n")), "read_id")
    met = met.join(tiles, ["genome", "tile"]).withColumn("_at", F.col("place") - F.col("tile") * tile).where(F.col("_at") + F.col("n") <= F.length("_t"))
    near = F.substring("_t", F.col("_at") + 1, F.length("_r"))
    same = F.size(F.filter(F.arrays_zip(F.split("_r", ""), F.split(near, "")), lambda p: (p["0"] == p["1"]) & (p["0"] != "")))
    rated = met.select("read_id", "genome", "place", "n", (same / F.length("_r")).alias("identity")).where(F.col("identity") >= least)
    best = rated.groupBy("read_id", "genome", "n").agg(F.max(F.struct("identity", (-F.col("place")).alias("p"))).alias("m"))
    return best.select("read_id", "genome", (-F.col("m.p")).alias("place"), F.col("m.identity").alias("identity"), "n")


def pair_placements(placed: DataFrame) -> DataFrame:
    """RM25: (pair_id, mate 1 or 2, genome, place, identity, n) -> each pair's best genome, and whether the mates agree there.

    Mates agree where the insert is 100 to 1000 bases; that lifts their mean
    identity by half.  Of equal scores the first genome counts.
    """
    side = lambda m: placed.where(F.col("mate") == m).select("pair_id", "genome", *(F.col(c).alias(f"{c}{m}") for c in ("place", "identity", "n")))
    both = side(1).join(side(2), ["pair_id", "genome"])
    insert = F.abs(F.col("place2") - F.col("place1")) + F.greatest("n1", "n2")
    agree = insert.between(100, 1000)
    score = (F.col("identity1") + F.col("identity2")) / 2 * F.when(agree, 1.5).otherwise(1.0)
    rows = both.select("pair_id", "genome", insert.alias("insert"), agree.alias("concordant"), score.alias("score"))
    over = Window.partitionBy("pair_id").orderBy(F.desc("score"), "genome")
    return rows.withColumn("_r", F.row_number().over(over)).where("_r = 1").drop("_r")


def placement_profile(best: DataFrame) -> DataFrame:
    """RM25: per genome concordant and other pairs and the sum of scores, those of concordant pairs up by half, others down to 0.7."""
    worth = F.col("score") * F.when(F.col("concordant"), 1.5).otherwise(0.7)
    return best.groupBy("genome").agg(
        F.sum(F.col("concordant").cast("long")).alias("concordant"), F.sum((~F.col("concordant")).cast("long")).alias("discordant"), F.sum(worth).alias("score")
    )
