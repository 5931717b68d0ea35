"""Queries whose parameters must matter in their own data: without the band, the cap or the gap their rows change."""

from pyspark.sql import functions as F

from strandline.functions import alignment as A
from strandline.plans import parity

SF = "/root/testdata/sf0.001"


def test_the_band_matters(spark):
    pairs = parity._seeded(spark, SF)
    score = lambda *rule: A.local_score(*rule)(F.col("peptide"), F.col("protein"))["score"]
    rules = {"residues": (None, -1, -3), "narrow": (None, -1, -2), "letters": (2, -1, -1), "bases": (5, -3, -8)}
    bands = {"residues": 15, "narrow": 10, "letters": 15, "bases": 15}
    got = pairs.select(*(score(*rules[n], b).alias(n) for n, b in bands.items()), *(score(*rules[n], None).alias(f"{n}_all") for n in rules)).collect()
    for n in rules:
        assert sum(r[n] < r[f"{n}_all"] for r in got) >= 10 and all(r[n] <= r[f"{n}_all"] for r in got)


def test_the_cap_and_the_chains_matter(spark):
    pairs = parity._seeded(spark, SF)
    assert pairs.count() > parity.local_bases(spark, SF).count()
    assert parity._chained(spark, SF).where("seeds > 1 AND score < 30 * seeds").count() >= 20
