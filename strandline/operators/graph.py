"""Resistance graph, attribution and position weight matrices (GR11-GR16, RM12, AG44-AG45, FN40-FN41)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.storage import written


def paths(edges: DataFrame, sources: DataFrame, most: int = 5) -> DataFrame:
    """GR12, GR15: all simple paths from ``sources`` (id) of up to ``most`` edges: (start, node, path, steps, weight, product).

    Each step is one join; a node never comes twice in a path.
    """
    now = sources.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path"), F.lit(0).alias("steps"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("product"))
    out = now
    for _ in range(most):
        step = now.join(edges.select(F.col("src").alias("node"), "dst", F.col("weight").alias("_w")), "node").where(~F.array_contains("path", F.col("dst")))
        now = step.select(
            "start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), (F.col("steps") + 1).alias("steps"),
            (F.col("weight") + F.col("_w")).alias("weight"), (F.col("product") * F.col("_w")).alias("product"),
        )
        out = out.unionByName(now)
    return out


def shortest(edges: DataFrame, sources: DataFrame, rounds: int = 1000) -> DataFrame:
    """GR12: of each (start, node) the shortest path, then the first in order: (start, node, path, steps).

    A breadth-first frontier: a round goes one edge on from the nodes that the
    last one reached first and keeps one path for each, so the work is that of
    the edges met, not of all simple paths.  It ends when nothing new is reached.
    """
    step = edges.select(F.col("src").alias("node"), "dst").distinct()
    front = sources.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path"), F.lit(0).alias("steps")).distinct()
    seen = front = cut(front)
    for _ in range(rounds):
        on = front.join(step, "node").select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), (F.col("steps") + 1).alias("steps"))
        front = cut(on.groupBy("start", "node").agg(F.min("path").alias("path"), F.min("steps").alias("steps")).join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))
    raise RuntimeError(f"paths of more than {rounds} edges")


def best_paths(edges: DataFrame, scores: DataFrame, sources: DataFrame, k: int = 3, most: int = 100) -> DataFrame:
    """RM12: of each (start, node) the ``k`` best paths: (start, node, place, path, score).

    A path's score is the sum over its edges of weight x coverage x identity of the
    node that the edge leads to, over ``scores`` (id, coverage, identity).  A turn
    goes one edge on from the paths of the last and keeps ``k`` for each node, so the
    work is that of k paths for each edge and length, however many paths there are:
    what comes later of a path does not depend on how it came here.  The graph has
    no cycle; paths of more than ``most`` edges raise.  Equal scores go by path.
    """
    worth = edges.join(scores.select(F.col("id").alias("dst"), (F.col("coverage") * F.col("identity")).alias("_c")), "dst")
    step = cut(worth.select(F.col("src").alias("node"), "dst", (F.col("weight") * F.col("_c")).alias("_w")))
    order = [F.desc("score"), F.asc("path")]
    best = lambda df: df.withColumn("place", F.row_number().over(Window.partitionBy("start", "node").orderBy(*order))).where(F.col("place") <= k)
    now = cut(sources.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path"), F.lit(0.0).alias("score")).distinct())
    found = now.where("false")
    for _ in range(most):
        on = now.join(step, "node").select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), (F.col("score") + F.col("_w")).alias("score"))
        now = cut(best(on).drop("place"))
        if now.isEmpty():
            return best(found)
        found = cut(best(found.unionByName(now)).drop("place"))
    raise RuntimeError(f"paths of more than {most} edges: is there a cycle?")


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, as a table in the shared folder that ``spark.checkpoint.dir`` names."""
    return written(df, "round")


def labels(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """GR14: (id, component): the least node reached over undirected edges.

    Labels spread to neighbours and then jump to their label's label, so the
    rounds grow with the logarithm of the longest chain; the last round changed
    nothing, and one that does not come raises.
    """
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    now = cut(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("id"), F.least("src", "m").alias("component")))
    for _ in range(rounds):
        seen = both.join(now.select(F.col("id").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("m"))
        hooked = now.join(seen.withColumnRenamed("src", "id"), "id").select("id", F.least("component", "m").alias("component"))
        up = hooked.select(F.col("id").alias("component"), F.col("component").alias("_up"))
        new = cut(hooked.join(up, "component").select("id", F.col("_up").alias("component")))
        if new.join(now.select("id", F.col("component").alias("_was")), "id").where("component <> _was").isEmpty():
            return new
        now = new
    raise RuntimeError("labels did not settle")


def co_occurring(edges: DataFrame, mutations: DataFrame) -> DataFrame:
    """GR13: (id, other) for mutations that an edge of the type co_occurs leads to."""
    met = edges.where(F.col("type") == "co_occurs").select(F.col("src").alias("id"), F.col("dst").alias("other"))
    return mutations.select("id").distinct().join(met, "id").distinct()


def score(edges: DataFrame, organism_gene: str = "carries", gene_mutation: str = "contains", mutation_drug: str = "confers") -> DataFrame:
    """AG44: summed weights over organism -> gene -> mutation -> drug."""
    of = lambda t, a, b, w: edges.where(F.col("type") == t).select(F.col("src").alias(a), F.col("dst").alias(b), F.col("weight").alias(w))
    chain = of(organism_gene, "organism", "gene", "w1").join(of(gene_mutation, "gene", "mutation", "w2"), "gene").join(of(mutation_drug, "mutation", "drug", "w3"), "mutation")
    return chain.groupBy("organism", "drug").agg(F.sum(F.col("w1") + F.col("w2") + F.col("w3")).alias("score"))


def risk(level):
    """AG45: high from 8, moderate from 4."""
    return F.when(level >= 8, "high").when(level >= 4, "moderate").otherwise("low")


def attribution(evidence: DataFrame, least: float = 0.5) -> DataFrame:
    """GR15, GR16: (gene, organism, coverage, identity, kmer_weight) -> scores above ``least``, best first."""
    s = F.col("coverage") * F.col("identity") * F.col("kmer_weight") * 0.9
    return evidence.withColumn("score", s).groupBy("gene", "organism").agg(F.max("score").alias("score")).where(F.col("score") > least).orderBy(F.desc("score"), "gene", "organism")


def pssm(aligned: DataFrame, seq: str = "seq", pseudo: float = 1.0) -> DataFrame:
    """FN40: (pos, base, log_odds) of equally long sequences, against an even background."""
    each = aligned.select(F.posexplode(F.split(seq, "")).alias("pos", "base")).where(F.col("base").isin("A", "C", "G", "T"))
    grid = each.select("pos").distinct().crossJoin(F.broadcast(each.sparkSession.createDataFrame([(b,) for b in "ACGT"], "base string")))
    n = grid.join(each.groupBy("pos", "base").agg(F.count("*").alias("n")), ["pos", "base"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + pseudo)
    f = F.col("n") / F.sum("n").over(Window.partitionBy("pos"))
    return n.withColumn("f", f).select("pos", "base", "f", F.log2(F.col("f") / 0.25).alias("log_odds"))


def information(matrix: DataFrame) -> DataFrame:
    """FN41: bits per position."""
    return matrix.groupBy("pos").agg((2 + F.sum(F.col("f") * F.log2("f"))).alias("bits"))


def scan(reads: DataFrame, matrix: DataFrame, key: str, seq: str, width: int, share: float = 0.1) -> DataFrame:
    """FN40: windows of ``width`` bases that score above ``share`` x width."""
    starts = F.explode(F.sequence(F.lit(1), F.length(seq) - width + 1)).alias("start")
    windows = reads.where(F.length(seq) >= width).select(key, seq, starts)
    each = windows.select(key, "start", F.posexplode(F.split(F.substring(F.col(seq), F.col("start"), F.lit(width)), "")).alias("pos", "base"))
    scored = each.join(F.broadcast(matrix.select("pos", "base", "log_odds")), ["pos", "base"]).groupBy(key, "start").agg(F.sum("log_odds").alias("score"))
    return scored.where(F.col("score") > share * width)
