"""A corpus pipeline of five stages, each one operator of ``strandline.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  The first four return the
columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import exact_dedup, packing, quality_rules, simhash, suffix_dedup
from strandline.llm.common import table, written

#: Jaccard similarity of 5-word shingle sets from which on a document is a near duplicate.
NEAR_SIMILARITY = 0.8


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule.

    Null and empty texts break the rule on length and go; very long texts are
    measured whole; repeated rows are judged alike; extra columns stay; an empty
    table gives an empty table.
    """
    return quality_rules.passing(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts: the one with the largest id.

    Null texts are equal to empty ones; a null id loses to any other; of repeated
    rows and ties one stays; extra columns stay, whatever their names; an empty
    table gives an empty table.
    """
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: no two that stay are known to be alike.

    Of alike documents the one with the smallest id stays, null ids coming last;
    of repeated rows one stays, and one of all texts without a word; very long
    texts are compared whole; an empty table gives an empty table.
    """
    return simhash.survivors(docs, size=5, similarity=NEAR_SIMILARITY)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that repeat; n_chars counts what stays.

    Every document stays, if need be with an empty text, which a null text becomes
    too; every copy of a passage goes, repeated rows' whole texts among them; extra
    columns stay; an empty table gives an empty table.
    """
    others = [c for c in docs.columns if c != "text"]
    keyed = docs.select(F.struct(*others).alias("_row"), "text")
    cut = suffix_dedup.deduplicated(keyed, key="_row", with_text=True)
    out = cut.select("_row.*", F.col("kept_text").alias("text"))
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and their place there.

    A null or empty text is one piece of the end token; a long one is cut into full
    pieces; repeated rows are packed each for itself; an empty table gives an empty
    table.
    """
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("suffix_dedup", repeats),
    ("packing", pack),
]

#: The stages after the first rest on hashing, sorting and packing that SQL cannot express; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
