"""Synthetic paired reads with known origin, for tests (UX15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.sequence import reverse_complement

READ, MEAN, SD, LEAST, MOST = 150, 350, 50, 350, 1000


def paired_reads(genomes: DataFrame, n: int, seed: int = 1, read: int = READ) -> DataFrame:
    """``n`` pairs per row of ``genomes`` (genome_id, seq): pair_id, genome_id, start, insert, seq_1, seq_2.

    Inserts are normal, clipped to the published range and to the genome; the
    second mate is the reverse complement of the insert's end.
    """
    rows = genomes.where(F.length("seq") >= LEAST).select("genome_id", "seq", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    insert = F.least(F.greatest(F.round(F.randn(seed) * SD + MEAN), F.lit(LEAST)), F.lit(MOST), F.length("seq")).cast("int")
    rows = rows.withColumn("insert", insert).withColumn("u", F.rand(seed + 1))
    rows = rows.withColumn("start", F.floor(F.col("u") * (F.length("seq") - F.col("insert") + 1)).cast("int"))
    part = F.substring(F.col("seq"), F.col("start") + 1, F.col("insert"))
    return rows.select(
        F.concat_ws(":", "genome_id", "k").alias("pair_id"), "genome_id", "start", "insert",
        F.substring(part, 1, read).alias("seq_1"), reverse_complement(F.substring(part, F.col("insert") - read + 1, F.lit(read))).alias("seq_2"),
    )
