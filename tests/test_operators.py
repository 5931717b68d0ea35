import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import genes as G
from strandline.operators import alleles, classify, coverage, em, features, graph, kmers, minimizers, taxonomy
from strandline.plans import catalog


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(1, None, "root", "root"), (2, 1, "phylum", "P"), (3, 2, "genus", "G"), (4, 3, "species", "G a"), (5, 3, "species", "G b"), (6, 2, "species", "H c"), (7, 1, "species", "Z z")]
    taxa = spark.createDataFrame(rows, "id long, parent long, rank string, name string")
    return taxa, taxonomy.closure(taxa, 3).persist()


def test_depths_and_lineages(tree):
    taxa, closed = tree
    assert {r.id: r.depth for r in taxonomy.depths(closed).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 3, 6: 2, 7: 1}
    assert {r.id: r.lineage for r in taxonomy.lineages(taxa, closed).collect()}[4] == "root|P|G|G a"


def test_closure_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 41)], "id long, parent long")
    closed = taxonomy.closure(chain, 6)
    assert closed.count() == 40 * 41 // 2 and closed.distinct().count() == 40 * 41 // 2
    assert closed.where("steps <> id - ancestor").count() == 0


def test_lca_is_commutative(spark, tree):
    _, closed = tree
    pairs = spark.createDataFrame([(4, 5), (5, 4), (4, 6), (6, 7), (4, 4), (3, 4)], "a long, b long")
    got = {(r.a, r.b): r.lca for r in taxonomy.lca_pairs(pairs, closed).collect()}
    assert got == {(4, 5): 3, (5, 4): 3, (4, 6): 2, (6, 7): 1, (4, 4): 4, (3, 4): 3}
    rows = spark.createDataFrame([("x", 4), ("x", 5), ("x", 6), ("y", 4)], "k string, t long")
    assert {r.k: (r.lca, r.n_taxa) for r in taxonomy.lca_groups(rows, closed, "k", "t").collect()} == {"x": (2, 3), "y": (4, 1)}


def test_diversity(spark):
    counts = spark.createDataFrame([(n,) for n in (10, 10, 1, 2)], "n long")
    d = taxonomy.diversity(counts, base=math.e).head()
    p = [10 / 23, 10 / 23, 1 / 23, 2 / 23]
    assert d.shannon == pytest.approx(-sum(x * math.log(x) for x in p))
    assert d.simpson == pytest.approx(1 - sum(x * x for x in p)) and d.richness == 4 and d.chao1 == 4.5


def test_kmer_screen(spark):
    ref = spark.createDataFrame([(1, "ACGTACGGTTAC")], "rid int, seq string")
    reads = spark.createDataFrame([(1, "TTACGTACGGTT"), (2, "GGGGGGGGGGGG"), (3, None), (4, "ACGTACGG")], "id int, seq string")
    got = {r.id: r.found for r in kmers.screen(reads, ref, 7, "id", least=2).collect()}
    assert got == {1: 4, 4: 2}
    assert {(r.id, r.rid, r.shared) for r in kmers.matches(reads, ref, 7, "id", "rid").collect()} == {(1, 1, 4), (4, 1, 2)}


def test_protein_matches(spark):
    protein = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGT"
    part = protein[5:35].replace("S", "T", 1)
    # two equal stretches of one frame are two matches
    frames = spark.createDataFrame([(1, 1, 0, part), (1, 1, 40, part), (2, 1, 0, "G" * 30)], "read_id int, frame int, start int, peptide string")
    proteins = spark.createDataFrame([(7, protein)], "protein_id int, protein string")
    r = kmers.protein_matches(frames, proteins).orderBy("start").collect()
    assert [x.start for x in r] == [0, 40] and r[0].read_id == 1 and r[0].length == 30 and len(r[0].mutations) == 1 and r[0].mutations[0].ref == "S"


def brute_minimizers(hs, w):
    out, last = [], None
    for i in range(len(hs)):
        if i >= w - 1 or i == len(hs) - 1:
            lo = max(0, i - w + 1)
            m = min(range(lo, i + 1), key=lambda j: (hs[j], j))
            if m != last:
                out.append(m)
                last = m
    return out


@pytest.mark.parametrize("w", [1, 4, 10, 50])
def test_minimizers(spark, w):
    rng = random.Random(w)
    hs = [rng.randrange(12) for _ in range(40)]
    rows = spark.createDataFrame([(1, i, f"k{i}", h) for i, h in enumerate(hs)], "key int, pos int, kmer string, h long")
    assert sorted(r.pos for r in minimizers.changes(rows, "key", w).collect()) == sorted(brute_minimizers(hs, w))
    got = {r.window: r.pos for r in minimizers.per_window(rows, "key", w).collect()}
    assert got == {i: min(range(i, i + w), key=lambda j: (hs[j], j)) for i in range(40 - w + 1)}


def test_minimizer_runs_do_not_cross_gaps(spark):
    rows = spark.createDataFrame([(1, p, "k", p % 7) for p in (0, 1, 2, 10, 11)], "key int, pos int, kmer string, h long")
    assert sorted(r.pos for r in minimizers.changes(rows, "key", 3).collect()) == [0, 10]


def test_unsigned_order(spark):
    df = spark.createDataFrame([(-1,), (0,), (5,)], "h long").orderBy(minimizers.unsigned_order(F.col("h")))
    assert [r.h for r in df.collect()] == [0, 5, -1]


def test_coverage_against_positions(spark):
    rng = random.Random(1)
    spans = [(g, s, s + rng.randint(1, 40)) for g in (1, 2) for s in (rng.randint(0, 90) for _ in range(30))]
    hits = spark.createDataFrame(spans, "gene_id int, ref_start int, ref_end int")
    genes = spark.createDataFrame([(1, 100), (2, 80), (3, 50)], "gene_id int, length int")
    got = {r.gene_id: r for r in coverage.coverage(hits, genes).collect()}
    assert set(got) == {1, 2}
    for g, n in ((1, 100), (2, 80)):
        depth = [sum(a == g and s <= p < e for a, s, e in spans) for p in range(n)]
        covered, total = sum(d > 0 for d in depth), sum(depth)
        mean = total / n
        sd = math.sqrt(sum((d - mean) ** 2 for d in depth) / n)
        assert (got[g].covered, got[g].bases) == (covered, total)
        assert got[g].uniformity == pytest.approx(1 - sd / (mean + 1e-6), abs=1e-6)


def test_tpm_sums_to_a_million(spark):
    hits = spark.createDataFrame([(i % 7,) for i in range(100)], "gene_id int")
    genes = spark.createDataFrame([(i, 50 + i) for i in range(7)], "gene_id int, length int")
    assert coverage.abundance(hits, genes, 100).agg(F.sum("tpm")).head()[0] == pytest.approx(1e6)


def test_em_conserves_reads(spark):
    candidates = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (3, 2, 0.5), (3, 3, 0.5), (4, 1, 1.0)], "read_id int, gene_id int, score double")
    genes = spark.createDataFrame([(1, 100, 1.0, "a"), (2, 100, 1.0, "a"), (3, 100, 1.0, "b"), (4, 100, 1.0, "b")], "gene_id int, length int, prior double, family string")
    out = em.run(candidates, genes, rounds=12, tolerance=1e-6)
    reads = {r.gene_id: r.reads for r in out.collect()}
    assert sum(reads.values()) == pytest.approx(4.0) and reads[1] > 2.5 and reads[4] == 0
    similar = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9)], "gene_id int, other int, similarity double")
    p = em.e_step(candidates, em.start(genes), similar).groupBy("read_id").agg(F.sum("p").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in p)
    assert sum(r.reads for r in em.m_step(em.e_step(candidates, em.start(genes)), em.start(genes), 2.0).collect()) == pytest.approx(8.0)


def test_pairs(spark):
    hits = spark.createDataFrame([(1, 1, False, 5.0, 0, 9), (1, 1, True, 4.0, 20, 30), (2, 1, False, 3.0, 0, 9), (2, 1, False, 2.0, 1, 9)], "pair_id int, gene_id int, is_r2 boolean, score double, ref_start int, ref_end int")
    scores = sorted(r.pair_score for r in em.concordance(hits).collect())
    assert scores == [1.0, 1.5, 8.0, 10.0]
    got = {r.pair_id: (r.h1 is not None, r.h2 is not None) for r in em.pairs(hits).collect()}
    assert got == {1: (True, True), 2: (True, False)}


def test_alleles(spark):
    matches = spark.createDataFrame([("e", "gyrA", 81, "GSSL"), ("e", "gyrA", 82, "LXA*"), *[("e", "gyrA", 82, "S")] * 6], "species string, gene string, ref_start int, peptide string")
    piled = alleles.pileup(matches, ["species", "gene"])
    at83 = {r.residue: r.n for r in piled.where("pos = 83").collect()}
    assert at83 == {"S": 7, "L": 1}
    known = spark.createDataFrame([("e", "gyrA", 83, "S", "L", 1), ("e", "gyrA", 83, "S", "W", 2), ("e", "gyrA", 83, "E", "K", 3)], "species string, gene string, pos int, wild string, mutant string, row long")
    table = alleles.wild_types(known, ["species", "gene", "pos"])
    w = table.head()
    assert (w.wild, w.resistant, w.conflict) == ("S", ["K", "L", "W"], True)
    f = alleles.frequencies(piled, table, ["species", "gene", "pos"]).head()
    assert (f.depth, f.dominant, f.summary) == (8, "L", "S83L(12%)") and f.resistant_share == pytest.approx(1 / 8)
    c = alleles.calls(piled, ["species", "gene", "pos"], known, least=0.1).collect()
    assert [(r.residue, r.n) for r in c] == [("L", 1)]


@pytest.mark.parametrize(("aa", "want"), [("L", True), ("K", False), ("S", False)])
def test_known_mutation(spark, aa, want):
    known = spark.createDataFrame([("Escherichia_coli", "gyrA", 83, "S", "L", 1), ("Escherichia_coli", "parC", 80, "S", "I", 2)], "species string, gene string, pos int, wild string, mutant string, row long")
    m = spark.createDataFrame([(1, "Escherichia_coli", "gyrA", [(83, aa)])], "id int, species string, gene string, mutations array<struct<pos:int,alt:string>>")
    assert (alleles.annotated(m, known, "id", ["species", "gene"]).head().known == 1) is want


def test_votes(spark):
    hits = spark.createDataFrame([(1, 5), (1, 5), (1, 3), (2, 9), (2, 4)], "read_id int, taxon int")
    got = {r.read_id: (r.taxon, r.confidence) for r in classify.by_vote(hits).collect()}
    assert got == {1: (5, pytest.approx(2 / 3)), 2: (4, 0.5)}
    paired = spark.createDataFrame([(1, 1, 5), (1, 1, 5), (1, 1, 5), (1, 2, 7), (1, 1, 7)], "pair_id int, mate int, taxon int")
    assert classify.by_pair(paired).head().taxon == 7


def test_cooccurrence_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randint(1, 2), rng.randint(0, 300), rng.choice("abc")) for _ in range(60)]
    hits = spark.createDataFrame(rows, "genome_id int, pos int, kmer string")
    got = {(r.a, r.b): (r.n, r.weight) for r in features.cooccurrence(hits, "genome_id", 20).collect()}
    want = {}
    for g, p, x in rows:
        for h, q, y in rows:
            if g == h and 0 < q - p <= 20 and x != y:
                n, w = want.get((x, y), (0, 0.0))
                want[(x, y)] = (n + 1, w + math.exp(-2 * (q - p) / 20))
    assert got == {k: (n, pytest.approx(w)) for k, (n, w) in want.items()}


def test_graph(spark):
    edges = spark.createDataFrame(
        [("E. coli", "gyrA", "carries", 4.0), ("gyrA", "S83L", "contains", 4.0), ("S83L", "ciprofloxacin", "confers", 8.0), ("gyrA", "E. coli", "back", 1.0)],
        "src string, dst string, type string, weight double",
    )
    s = graph.score(edges).head()
    assert (s.organism, s.drug, s.score) == ("E. coli", "ciprofloxacin", 16.0)
    found = graph.shortest(edges, spark.createDataFrame([("E. coli",)], "id string"))
    p = found.where("node = 'ciprofloxacin'").head()
    assert p.path == ["E. coli", "gyrA", "S83L", "ciprofloxacin"] and p.steps == 3
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51)], "src long, dst long")
    got = {r.id: r.component for r in graph.labels(chain).collect()}
    assert set(got[i] for i in range(1, 31)) == {1} and got[51] == 50


def test_pssm(spark):
    seqs = spark.createDataFrame([("ACGT",), ("ACGA",), ("ACGC",), ("ACGG",)], "seq string")
    m = graph.pssm(seqs, pseudo=0.001)
    bits = {r.pos: r.bits for r in graph.information(m).collect()}
    assert bits[0] == pytest.approx(2, abs=0.02) and bits[3] == pytest.approx(0, abs=1e-6)
    reads = spark.createDataFrame([(1, "TTACGTTT"), (2, "GGGGGGGG")], "id int, seq string")
    assert {(r.id, r.start) for r in graph.scan(reads, m, "id", "seq", 4, 1.0).collect()} == {(1, 3)}


def test_pssm_windows_read_whole_sequences(spark, tmp_path):
    rng = random.Random(21)
    head = "".join(rng.choice("abcdefgh") for _ in range(21))
    whole = [head + "".join(rng.choice(letters) for _ in range(60)) for letters in ("aaab", "cccd", "abcdefgh")]
    bits = {}
    for name, texts in (("whole", whole), ("heads", [head] * 3)):
        rows = [(i, t) for i, t in enumerate([*texts, "short"])]
        spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        seqs = [r.seq for r in catalog.reference(spark, f"{tmp_path}/{name}").collect()]
        windows = [s[i : i + 21] for s in seqs for i in range(len(s) - 20)]
        bits[name] = {r.pos: r.bits for r in catalog.pssm_information(spark, f"{tmp_path}/{name}").collect()}
        for pos in range(21):
            n = [sum(w[pos] == b for w in windows) + 1 for b in "ACGT"]
            assert bits[name][pos] == pytest.approx(2 + sum(x / sum(n) * math.log2(x / sum(n)) for x in n), abs=1e-5)
    assert bits["whole"] != bits["heads"]


def test_prior(spark):
    df = spark.createDataFrame([("CTX-M-15",), ("blaCTX-M-99",), ("zzz",)], "n string")
    assert [r.p for r in df.select(G.prior_weight(F.col("n")).alias("p")).collect()] == [3.0, 1.5, 1.0]


def test_shortest_paths_are_found_in_dense_graphs(spark):
    """Twelve layers of four nodes, all joined: 4 ** 11 simple paths, of which the frontier keeps one per node."""
    edges = spark.createDataFrame([(f"n{i}{a}", f"n{i + 1}{b}", 1.0) for i in range(10, 22) for a in range(4) for b in range(4)], "src string, dst string, weight double")
    got = {r.node: (r.steps, r.path) for r in graph.shortest(edges, spark.createDataFrame([("n100",)], "id string")).collect()}
    assert got["n223"] == (12, ["n100", *(f"n{i}0" for i in range(11, 22)), "n223"]) and len(got) == 49


def test_deep_taxonomies_are_whole_or_fail(spark):
    taxa = spark.createDataFrame([(i, i - 1 if i > 1 else None, "r", f"t{i}") for i in range(1, 10)], "id long, parent long, rank string, name string")
    assert {r.id: r.depth for r in taxonomy.depths(taxonomy.closure(taxa, 3)).collect()} == {i: i - 1 for i in range(1, 10)}
    with pytest.raises(Exception, match="deeper than 4"):
        taxonomy.closure(taxa, 2)


def test_cumulative_share_with_ties(spark):
    counts = spark.createDataFrame([(1, 5), (2, 3), (3, 3), (4, 1)], "id int, n long")
    got = {r.id: r.share for r in taxonomy.cumulative(counts, "id").collect()}
    assert got == {1: pytest.approx(5 / 12), 2: pytest.approx(8 / 12), 3: pytest.approx(11 / 12), 4: pytest.approx(1.0)}


def test_packed_windows(spark):
    rng = np.random.default_rng(2)
    text = "".join("ACGTN"[i] for i in rng.choice(5, 600, p=[0.24, 0.24, 0.24, 0.24, 0.04]))
    for k in (1, 2, 7, 12, 31):
        at, codes = kmers.packed_windows(text.encode(), k)
        want = [(i, int("".join(str("ACGT".index(c)) for c in text[i : i + k]), 4)) for i in range(len(text) - k + 1) if "N" not in text[i : i + k]]
        assert list(zip(at.tolist(), codes.tolist(), strict=True)) == want
    assert len(kmers.packed_windows(b"AC", 3)[0]) == 0


def test_em_classes_do_not_change_the_result(spark):
    rng = np.random.default_rng(4)
    rows = [(r, g, float(10 + g)) for r in range(60) for g in set(rng.integers(0, 3, 2).tolist())]
    candidates = spark.createDataFrame(rows, "read_id int, gene_id int, score double")
    assert em.classes(candidates).agg({"n": "max"}).head()[0] > 5
    genes = spark.createDataFrame([(g, 100 + 20 * g, 1.0, "f") for g in range(3)], "gene_id int, length int, prior double, family string")
    state = em.start(genes)
    for _ in range(3):
        state = em.m_step(em.e_step(candidates, state), state)
    got = em.run(candidates, genes, rounds=3, tolerance=0, smooth_every=0)
    assert {r.gene_id: pytest.approx(r.abundance) for r in got.collect()} == {r.gene_id: r.abundance for r in state.collect()}


def test_placements(spark):
    rng = np.random.default_rng(9)
    genome = {g: "".join("ACGT"[i] for i in rng.integers(0, 4, 3000)) for g in ("a", "b")}
    genomes = spark.createDataFrame(list(genome.items()), "genome string, seq string")
    reads = [(2 * i + m, genome["ab"[i % 2]][100 + 50 * i + 300 * m : 200 + 50 * i + 300 * m]) for i in range(8) for m in (0, 1)]
    placed = classify.placements(spark.createDataFrame(reads, "read_id long, seq string"), genomes)
    assert {(r.read_id, r.genome, r.place) for r in placed.collect()} == {(2 * i + m, "ab"[i % 2], 100 + 50 * i + 300 * m) for i in range(8) for m in (0, 1)}
    mates = placed.selectExpr("read_id div 2 AS pair_id", "CAST(read_id % 2 + 1 AS int) AS mate", "genome", "place", "identity", "n")
    best = classify.pair_placements(mates)
    assert {(r.pair_id, r.genome, r.insert, r.concordant, r.score) for r in best.collect()} == {(i, "ab"[i % 2], 400, True, 1.5) for i in range(8)}
    assert {r.genome: (r.concordant, r.discordant, r.score) for r in classify.placement_profile(best).collect()} == {g: (4, 0, 9.0) for g in "ab"}


def test_codon_scan(spark):
    known = spark.createDataFrame([("e", "gyrA", 83, "S", "L"), ("e", "gyrA", 87, "D", "N"), ("e", "parC", 80, "S", "I")], "species string, gene string, pos int, wild string, mutant string")
    seqs = spark.createDataFrame([(1, "gyrA", "A" * 246 + "TTG" + "A" * 9 + "AAC" + "A" * 100), (2, "parC", "A" * 237 + "ATC" + "A" * 100), (3, "parC", "A" * 238)], "id int, gene string, seq string")
    found = alleles.codon_scan(seqs, known)
    assert sorted((r.id, f"{r.wild}{r.pos}{r.mutant}") for r in found.collect()) == [(1, "D87N"), (1, "S83L"), (2, "S80I")]
    assert [(r.mutant, r.n) for r in alleles.mutation_report(found, ["mutant"]).collect()] == [("I", 1), ("L", 1), ("N", 1)]


def test_as_of_join_over_blocks(spark):
    import bisect
    import datetime as dt

    from strandline.operators import asof

    rng = random.Random(3)
    moment = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    events = [(rng.randint(0, 3), rng.randint(0, 400), i) for i in range(60)]
    asked = [(rng.randint(0, 4), rng.randint(-10, 500), i) for i in range(200)]
    e = spark.createDataFrame([(k, moment(h), i) for k, h, i in events], "k int, at timestamp, v int")
    a = spark.createDataFrame([(k, moment(h), i) for k, h, i in asked] + [(None, moment(3), 900), (1, None, 901)], "k int, at timestamp, id int")
    got = {r.id: r.v for r in asof.last_before(a, e, "k", "at", "v", "12 hours").collect()}
    by = {}
    for k, h, i in events:
        by.setdefault(k, []).append((h, i))
    want = {900: None, 901: None}
    for k, h, i in asked:
        rows = sorted(by.get(k, []))
        n = bisect.bisect_right(rows, (h, 10**9))
        want[i] = rows[n - 1][1] if n else None
    assert got == want


def test_clustered_at_block_edges(spark):
    rng = random.Random(5)
    rows = [(g, rng.randint(0, 900)) for g in (1, 2) for _ in range(80)]
    got = sorted((r.genome_id, r.pos, r.near) for r in features.clustered(spark.createDataFrame(rows, "genome_id int, pos int"), window=7).collect())
    assert got == sorted((g, p, sum(h == g and abs(q - p) <= 7 for h, q in rows) - 1) for g, p in rows)
