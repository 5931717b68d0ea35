import random

import pytest
from pyspark.sql import functions as F

from strandline.functions.sequence import GENETIC_CODE
from strandline.operators import taxonomy
from strandline.plans import pipelines
from strandline.sources.tables import Config

BACK = {}
for codon, residue in GENETIC_CODE.items():
    BACK.setdefault(residue, codon)


def protein(rng, n):
    return "".join(rng.choice("ARNDCQEGHILKMFPSTWYV") for _ in range(n))


def coded(peptide):
    return "".join(BACK[c] for c in peptide)


@pytest.fixture(scope="module")
def targets():
    rng = random.Random(1)
    return {i: protein(rng, 150) for i in (1, 2, 3)}


def test_gene_quantification(spark, targets):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        g = 1 if i % 3 else 2
        at = rng.randint(0, 100)
        rows.append((i, coded(targets[g][at : at + 50])))
    rows += [(100 + i, "".join(rng.choice("ACGT") for _ in range(150))) for i in range(20)]
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    names = {1: "KPC-2", 2: "NDM-1", 3: "vanA"}
    proteins = spark.createDataFrame([(i, p, names[i], "BETA-LACTAM") for i, p in targets.items()], "protein_id int, protein string, gene_name string, drug_class string")
    out = pipelines.GeneQuantification(proteins, Config(em_rounds=5))(reads)
    assert {r.gene_id: r.reads for r in out["abundance"].collect()} == {1: 40, 2: 20}
    assert sum(r.reads for r in out["em"].collect()) == pytest.approx(60)
    assert {r.family for r in out["families"].collect()} == {"KPC", "NDM"}
    assert out["classes"].head().reads == 60
    assert all(r.percent_coverage > 60 for r in out["coverage"].collect())


def test_mutation_scan(spark, targets):
    p = targets[1][:82] + "S" + targets[1][83:]
    changed = p[:82] + "L" + p[83:]
    rows = [(i, coded((changed if i < 8 else p)[60:110])) for i in range(20)]
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    proteins = spark.createDataFrame([(1, p, "e", "gyrA")], "protein_id int, protein string, species string, gene string")
    known = spark.createDataFrame([("e", "gyrA", 83, "S", "L", 1), ("e", "gyrA", 140, "S", "L", 2)], "species string, gene string, pos int, wild string, mutant string, row long")
    out = pipelines.MutationScan(proteins, known)(reads)
    f = out["frequencies"].collect()
    assert [(r.pos, r.depth, r.dominant, r.resistant_share) for r in f] == [(83, 20, "L", 0.4)]
    assert [(r.residue, r.n) for r in out["calls"].collect()] == [("L", 8)]
    assert out["reading"].head().text.startswith("HIGH CONFIDENCE")


def test_paired_quantification(spark, targets):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        at = rng.randint(0, 40)
        gene = coded(targets[1 + i % 2])
        rows += [(2 * i, i, False, gene[3 * at : 3 * at + 120]), (2 * i + 1, i, True, gene[3 * at + 180 : 3 * at + 300])]
    reads = spark.createDataFrame(rows, "read_id long, pair_id long, is_r2 boolean, seq string")
    proteins = spark.createDataFrame([(i, p, n, "BETA-LACTAM") for (i, p), n in zip(targets.items(), ("KPC-2", "NDM-1", "vanA"), strict=True)], "protein_id int, protein string, gene_name string, drug_class string")
    out = pipelines.GeneQuantification(proteins, Config(em_rounds=3))(reads)
    assert out["hits"].where("NOT concordant").count() == 0
    m = out["fragments"].head()
    assert m.n == 60 and 280 <= m.mean <= 300
    expected = {r.gene_id: r.reads for r in out["em"].collect()}
    assert expected[1] == pytest.approx(60) and expected[2] == pytest.approx(60) and expected[3] == 0
    assert [r.family for r in out["report"].collect()] in (["KPC", "NDM"], ["NDM", "KPC"])


def test_unknown_mutations_in_the_region_are_told(spark, targets):
    p = targets[1][:82] + "S" + targets[1][83:]
    changed = p[:70] + ("W" if p[70] != "W" else "C") + p[71:]
    reads = spark.createDataFrame([(i, coded(changed[60:110])) for i in range(6)], "read_id long, seq string")
    proteins = spark.createDataFrame([(1, p, "e", "gyrA")], "protein_id int, protein string, species string, gene string")
    known = spark.createDataFrame([("e", "gyrA", 83, "S", "L", 1)], "species string, gene string, pos int, wild string, mutant string, row long")
    r = pipelines.MutationScan(proteins, known)(reads)["reading"].head()
    assert (r.known, r.qrdr, r.confidence) == (0, 6, 0.40)


def test_profile(spark, tmp_path):
    rng = random.Random(3)
    seq = {i: "".join(rng.choice("ACGT") for _ in range(400)) for i in (4, 5)}
    shared = "".join(rng.choice("ACGT") for _ in range(200))
    genomes = spark.createDataFrame([(4, seq[4] + shared), (5, seq[5] + shared)], "taxon long, seq string")
    taxa = spark.createDataFrame([(1, None, "root", "root"), (3, 1, "genus", "G"), (4, 3, "species", "a"), (5, 3, "species", "b")], "id long, parent long, rank string, name string")
    tree = taxonomy.closure(taxa, 2).persist()
    index = pipelines.build_index(genomes, tree, 21)
    reads = spark.createDataFrame([(1, seq[4][50:150]), (2, seq[5][50:150]), (3, shared[20:120]), (4, "A" * 50)], "read_id long, seq string")
    out = pipelines.run_all(reads, profile=pipelines.Profile(index, taxa, tree, Config(kmer=21)))["profile"]
    assert {r.read_id: r.taxon for r in out["calls"].collect()} == {1: 4, 2: 5, 3: 3}
    assert {r.id: r.n for r in out["lineages"].collect()} == {1: 3, 3: 3, 4: 1, 5: 1}
    assert out["diversity"].head().richness == 3
    assert out["counts"].agg(F.sum("n")).head()[0] == 3
    names = pipelines.Profile(index, taxa, tree, Config(kmer=21)).write(reads, str(tmp_path / "out"))
    assert names == ["calls", "counts", "lineages", "diversity"] and spark.read.parquet(str(tmp_path / "out" / "calls")).count() == 3
