"""Connected components of an edge table by alternating stars.

Each round is two aggregations and two joins over edges, cut off from its
lineage by a table in the shared folder, which is deleted when the next round
has been written; nothing is collected but a count and a checksum.  A hub costs
its partial aggregates and a join that adaptive execution can split.

Defined results: a link with a null end is no link; repeated links and links of
a value to itself change nothing; no link, no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import discard, written

MAX_ROUNDS = 60


def _low(edges: DataFrame, rows: int) -> DataFrame:
    # as a table, so that the join shuffles both sides and a hub's partition can be split
    return written(edges.groupBy("u").agg(F.min("v").alias("m")), "lows", rows)


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _low(both, 2 * rows)
    near = both.join(low.select("u", F.least("u", "m").alias("m")), "u").where("v > u")
    out = written(near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges", rows)
    discard(low)
    return out


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    low = _low(edges, rows)
    out = edges.join(low, "u").select(
        F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
    )
    out = written(out.where("u <> v").distinct(), "edges", rows)
    discard(low)
    return out


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(u, v) links of comparable values -> (node, root): root is the smallest value reached.

    Nodes without a link to another value do not appear.  ``rows`` bounds the
    number of links where it is known.
    """
    flat = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now, mark = written(flat, "edges", rows), None
    for _ in range(MAX_ROUNDS):
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).head()
        if (new.n, new.h) == mark or new.n == 0:
            break
        mark = (new.n, new.h)
        large = _large_star(now, new.n)
        discard(now)
        now = _small_star(large, new.n)
        discard(large)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
