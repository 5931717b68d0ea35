import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from strandline.sources import fastq, sinks, tables


def write_fastq(path, n, mate, packed=False, broken=False):
    rng = random.Random(7)
    text = ""
    for i in range(n):
        seq = "".join(rng.choice("ACGT") for _ in range(30))
        text += f"@read{i}/{mate} x\n{seq}\n+\n{'I' * 30}\n"
    if broken:
        text += "@last/1\nACGT\n"
    (gzip.open if packed else open)(path, "wt").write(text)


def test_fastq_pairs(spark, tmp_path):
    write_fastq(tmp_path / "a_1.fastq.gz", 25_000, 1, True, True)
    write_fastq(tmp_path / "a_2.fastq", 24_000, 2)
    one, two = fastq.scan(spark, str(tmp_path / "a_1.fastq.gz")), fastq.scan(spark, str(tmp_path / "a_2.fastq"))
    assert fastq.reads(one).count() == 25_000
    assert [r.reason for r in fastq.rejects(one).collect()] == ["truncated"]
    both = fastq.pairs(one, two)
    assert both.count() == 24_000 and both.where("NOT same_name").count() == 0
    assert fastq.long_form(both).groupBy("mate").count().count() == 2
    assert fastq.is_fastq(str(tmp_path / "a_1.fastq.gz"))


def test_bad_records():
    lines = [b"read", b"AC", b"+", b"II", b"@b", b"AC", b"-", b"II", b"@c", b"AC", b"+", b"I", b"@d", b"AC", b"+", b"II"]
    assert [r[3] for r in fastq.records(iter(lines))] == ["header", "separator", "quality length", None]
    assert list(fastq.records(iter([]))) == []


def test_fastq_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_fastq(folder / "a.fastq", 10, 1)
    out = str(tmp_path / "out")
    q = lambda: fastq.stream(spark, str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
    q().awaitTermination(60)
    write_fastq(folder / "b.fastq", 5, 1)
    q().awaitTermination(60)
    assert spark.read.parquet(out).count() == 15
    # a late file whose name sorts before those read
    write_fastq(folder / "Z.fastq", 4, 1)
    q().awaitTermination(60)
    assert spark.read.parquet(out).count() == 19


def test_fasta_and_headers(spark, tmp_path):
    (tmp_path / "p.fa").write_text(">0|WP_033990638.1|1|1|blaPDC-11|blaPDC|hydrolase|2|CEPHALOSPORIN|BETA-LACTAM|desc\nmk\nTA\n>x1 other\nAA\n")
    rec = tables.fasta(spark, str(tmp_path / "p.fa"))
    got = {r.gene_name: r for r in tables.amr_proteins(rec).collect()}
    assert (got["blaPDC-11"].accession, got["blaPDC-11"].gene_family, got["blaPDC-11"].drug_class, got["blaPDC-11"].seq) == ("WP_033990638.1", "blaPDC", "BETA-LACTAM", "MKTA")
    assert got["x1"].drug_class == "UNKNOWN"
    (tmp_path / "g.fna").write_text(">kraken:taxid|562|NC_1.1 Escherichia coli K-12\nACGT\n>NC_2 taxid=9 thing\nAC\n")
    g = {r.accession: (r.taxon, r.species) for r in tables.genomes(tables.fasta(spark, str(tmp_path / "g.fna"))).collect()}
    assert g == {"NC_1.1": (562, "Escherichia coli"), "NC_2": (9, None)}
    dna = spark.createDataFrame([("WP_033990638.2", "ACGT")], "accession string, seq string")
    m = tables.matched(dna, tables.amr_proteins(rec).select("accession", "gene_name"))
    assert {r.gene_name: r.dna for r in m.collect()} == {"blaPDC-11": "ACGT", "x1": None}


def test_taxonomy_files(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tphylum\t|\n")
    (tmp_path / "names.dmp").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tBac\t|\t\t|\tscientific name\t|\n2\t|\tother\t|\t\t|\tsynonym\t|\n")
    got = {r.id: (r.parent, r.rank, r.name) for r in tables.taxonomy_dump(spark, str(tmp_path / "nodes.dmp"), str(tmp_path / "names.dmp")).collect()}
    assert got == {1: (None, "no rank", "root"), 2: (1, "phylum", "Bac")}
    (tmp_path / "k.tsv").write_text("C\tread_1\t680797\t151|150\t0.026\t3|1\t117|100\nU\tr2\t0\t90\t0.0\t0\t60\n")
    k = tables.kraken_results(spark, str(tmp_path / "k.tsv")).orderBy("read_id").collect()
    assert k[1].length == [151, 150] and k[1].classified and not k[0].classified
    back = [r.value for r in sinks.kraken_lines(spark.createDataFrame([("read_1", 680797, [151], 0.026, [3], [117])], "read_id string, taxon long, length array<int>, confidence double, votes array<int>, kmers array<int>")).collect()]
    assert back == ["C\tread_1\t680797\t151\t0.026\t3\t117"]


@pytest.mark.parametrize("head", ["species,gene,location,wt,mut", "Species,Gene,Mutation Position,Wild-type Amino Acid,Mutant Amino Acid"])
def test_mutation_tables(spark, tmp_path, head):
    (tmp_path / "m.csv").write_text(head + "\nEscherichia coli,gyrA,83,S,L\nX,gyrA,NA,S,L\n")
    assert [(r.species, r.pos, r.wild, r.mutant) for r in tables.mutations(spark, str(tmp_path / "m.csv")).collect()] == [("Escherichia coli", 83, "S", "L")]


@pytest.mark.parametrize("sep", [",", "\t", ";"])
def test_sample_sheet(spark, tmp_path, sep):
    rows = [["SampleName", "FilePath", "R1 file", "R2 file", "Ward"], ["s1", "/d/", "a.fq", "b.fq", "w1"], ["s2", "/d", "c.fq", "", "w2"], ["s2", "/d", "e.fq", "", ""]]
    (tmp_path / "s.csv").write_text("\n".join(sep.join(r) for r in rows) + "\n")
    s = tables.sheet(spark, str(tmp_path / "s.csv"))
    got = [(r.sample_name, r.r1, r.r2, r.metadata["Ward"]) for r in s.orderBy("r1").collect()]
    assert got == [("s1", "/d/a.fq", "/d/b.fq", "w1"), ("s2", "/d/c.fq", None, "w2"), ("s2", "/d/e.fq", None, None)]
    assert [r.error for r in tables.sheet_errors(s).collect()] == ["name is repeated"]


def test_manifests(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"samples": [{"sample_id": "s1", "read1": "a", "read2": "b"}, {"sample_id": "s2", "r1": "c"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"files": {"s1": {"forward": "a", "reverse": "b"}}}))
    assert [tuple(r) for r in tables.manifest(spark, str(tmp_path / "a.json")).orderBy("sample_id").collect()] == [("s1", "a", "b"), ("s2", "c", None)]
    assert [tuple(r) for r in tables.manifest(spark, str(tmp_path / "b.json")).collect()] == [("s1", "a", "b")]


def test_config(tmp_path):
    c = tables.Config().overridden({"kmer": 21, "site": "x"})
    assert c.kmer == 21 and c.extra == {"site": "x"}
    c.save(str(tmp_path / "c.json"))
    assert tables.Config.load(str(tmp_path / "c.json")).kmer == 21
    with pytest.raises(ValueError):
        tables.Config().overridden({"kmer": 32})


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["S83L", "D87N"], {"A": 3, "C": 1})], "id int, m array<string>, n map<string,int>")
    assert rows.select(sinks.counts_cell(F.col("n")).alias("c")).head().c == "A:3;C:1"
    sinks.tsv(rows, str(tmp_path / "t"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).head()
    assert back.m == "S83L;D87N" and json.loads(back.n) == {"A": 3, "C": 1}
    edges = spark.createDataFrame([("a", "b", "x", 1.0)], "src string, dst string, type string, weight double")
    assert [r.value for r in sinks.dot(edges).collect()] == ["digraph resistance {", '  "a" -> "b" [label="x", weight=1.0];', "}"]
    for form in ("text", "html", "json"):
        assert "S83L" in sinks.report("R <1>", {"hits": spark.createDataFrame([("S83L", 0.5)], "m string, f double")}, ("note",), form)
    assert json.loads(sinks.summary_json(e=edges))["e"][0]["dst"] == "b"
    sinks.json_lines(rows, str(tmp_path / "j"))
    sinks.parquet(rows, str(tmp_path / "p"), "id")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    hit = spark.createDataFrame([(1, "g", 4, 24, False)], "read_id long, gene_name string, ref_start int, ref_end int, is_r2 boolean")
    assert sinks.sam_lines(hit).head().value.split("\t")[:6] == ["1", "99", "g", "5", "255", "20M"]


def test_synthetic_reads(spark):
    from strandline.functions.sequence import reverse_complement
    from strandline.sources import synthetic

    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(2000))
    r = synthetic.paired_reads(spark.createDataFrame([(1, seq), (2, "ACGT")], "genome_id int, seq string"), 40).withColumn("back", reverse_complement(F.col("seq_2"))).collect()
    assert len(r) == 40
    for x in r:
        assert 350 <= x.insert <= 1000 and seq[x.start : x.start + 150] == x.seq_1 and seq[x.start + x.insert - 150 : x.start + x.insert] == x.back


def test_packed_records(spark, tmp_path):
    import numpy as np

    rows = np.array([(2**40 + i, i) for i in range(1000)], [("kmer", "<u8"), ("taxon", "<u4")])
    (tmp_path / "i.bin").write_bytes(b"HEADER00" + rows.tobytes())
    got = tables.kmer_index(spark, str(tmp_path / "i.bin"), 8)
    assert {(r.kmer, r.taxon) for r in got.collect()} == {(2**40 + i, i) for i in range(1000)}
    with pytest.raises(Exception, match="no whole number"):
        tables.kmer_index(spark, str(tmp_path / "i.bin"), 7).collect()
    (tmp_path / "h.k2d").write_bytes(b"\0" * 32 + np.array([0, (5 << 16) | 9, 0, (7 << 16) | 3], "<u4").tobytes())
    assert sorted((r.prefix, r.value) for r in tables.hash_cells(spark, str(tmp_path / "h.k2d")).collect()) == [(5, 9), (7, 3)]
