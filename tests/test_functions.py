import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import alignment as A
from strandline.functions import genes as G
from strandline.functions import hashing as H
from strandline.functions import scoring as S
from strandline.functions import sequence as Q


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_"))
    return df.select(column.alias("x")).head().x


def test_reverse_complement_is_an_involution(spark):
    assert one(spark, Q.reverse_complement(F.col("s")), s="AACGTU") == "AACGTT"
    assert one(spark, Q.reverse_complement(Q.reverse_complement(F.col("s"))), s="GATTACA") == "GATTACA"


def test_packing_round_trip(spark):
    for s in ("A", "ACGT", "T" * 31, "GATTACAGATTACA"):
        code = Q.pack(F.col("s"))
        assert one(spark, Q.unpack(code, len(s)), s=s) == s
        want = int("".join(str("ACGT".index(c)) for c in s), 4)
        assert one(spark, code, s=s) == want
    assert one(spark, Q.pack(F.col("s")), s="ACN") is None
    both = one(spark, Q.pack_both(F.col("s")), s="AAC")
    assert both.rc == one(spark, Q.pack(F.col("s")), s="GTT")


def test_kmers_cross_blocks(spark):
    seq = "".join("ACGT"[i * i % 4] for i in range(700)) + "N" + "GATTACA" * 10
    df = spark.createDataFrame([(1, seq), (2, "AC"), (3, None), (4, "")], "id int, seq string")
    got = {(r.pos, r.kmer) for r in Q.kmers(df, "seq", 21).where("id = 1").collect()}
    want = {(i, seq[i : i + 21]) for i in range(len(seq) - 20) if set(seq[i : i + 21]) <= set("ACGT")}
    assert got == want
    assert Q.kmers(df, "seq", 21).where("id > 1").count() == 0
    assert {r.pos for r in Q.kmers(df, "seq", 21, 7).where("id = 1").collect()} == {p for p, _ in want if p % 7 == 0}


def test_translation(spark):
    assert one(spark, Q.translate_codon(F.col("s")), s="TTG") == "L"
    assert one(spark, Q.translate_codon(F.col("s")), s="TAA") == "*"
    assert one(spark, Q.translate_codon(F.col("s")), s="TNA") == "X"
    assert one(spark, Q.translate_frame(F.col("s"), 1), s="AATGGCC") == "MA"
    gyra = "A" * 246 + "TTG" + "A" * 9 + "AAC" + "A" * 100
    p = one(spark, Q.translate_frame(F.col("s"), 0), s=gyra)
    assert p[82] == "L" and p[86] == "N"
    parc = "A" * 237 + "ATC" + "A" * 100
    assert one(spark, Q.translate_frame(F.col("s"), 0), s=parc)[79] == "I"


def test_six_frames_have_starts(spark):
    seq = "ATG" + "GCC" * 25 + "TAA" + "GGG" * 30
    rows = Q.six_frames(spark.createDataFrame([(1, seq)], "id int, seq string"), "seq", 20).collect()
    first = {(r.frame, r.start): r.peptide for r in rows}
    assert first[(1, 0)] == "M" + "A" * 25
    assert first[(1, 27)] == "G" * 30


def test_repeated_reads_have_their_own_stretches(spark):
    seq = "ATG" + "GCC" * 3 + "TAA" + "GGG" * 3 + "TAG" + "AAA" * 4
    df = spark.createDataFrame([(1, seq), (1, seq), (2, "AC"), (3, None), (4, "TAATAA")], "id int, seq string")
    rows = [(r.id, r.start, r.peptide) for r in Q.six_frames(df, "seq", 1).where("frame = 1").collect()]
    assert sorted(rows) == sorted([(1, 0, "MAAA"), (1, 5, "GGG"), (1, 9, "KKKK")] * 2)


def test_small_sequence_functions(spark):
    assert one(spark, Q.gc_percent(F.col("s")), s="GGAN") == pytest.approx(200 / 3)
    assert one(spark, Q.clean(F.col("s")), s="ac-gx*t!") == "ACNGNNT"
    assert one(spark, Q.valid_fraction(F.col("s")), s="ACNN") == 0.5
    assert one(spark, Q.spaced(F.col("s"), 2), s="ACGTAC") == "ACTA"
    assert one(spark, Q.is_homopolymer(F.col("s"), 10), s="AAAAAAAACG") is True
    assert one(spark, Q.is_homopolymer(F.col("s"), 10), s="AAAAAAACGT") is False
    assert one(spark, Q.is_low_complexity(F.col("s")), s="AAAAAAAACG") is True
    assert one(spark, Q.mean_quality(F.col("s")), s="I!") == 20.0
    assert one(spark, Q.residues_to_bases(F.col("s"), 2, 3), s="AAACCCGGGTTT") == "CCCGGG"


@pytest.mark.parametrize(
    ("name", "family", "variant"),
    [("blaKPC-2", "KPC", "2"), ("blaOXA-48", "OXA", "48"), ("blaNDM-1", "NDM", "1"), ("vanA", "vanA", ""), ("aac(6')-Ib", "aac6", "6')-Ib"), ("qnrS1", "qnrS", "1"), ("ctx-m-15", "CTX-M", "15"), ("abc12", "abc", "12"), ("floR", "flor", "")],
)
def test_gene_names(spark, name, family, variant):
    assert one(spark, G.gene_family(F.col("n")), n=name) == family
    assert one(spark, G.gene_variant(F.col("n")), n=name) == variant


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("KPC-2", "KPC-2", 1.0), ("KPC-2", "NDM-1", 0.05), ("CTX-M-1", "CTX-M-15", 0.9), ("CTX-M-1", "CTX-M-9", 0.6), ("CTX-M-1", "CTX-M-99", 0.7), ("TEM-1", "TEM-3", 0.8), ("TEM-2", "TEM-3", 0.75), ("qnrA1", "qnrA2", 0.8), ("KPC-2", "KPC-3", 0.7)],
)
def test_name_similarity(spark, a, b, want):
    assert one(spark, G.name_similarity(F.col("a"), F.col("b")), a=a, b=b) == want
    assert one(spark, G.name_similarity(F.col("a"), F.col("b")), a=b, b=a) == want


def test_mutation_codes(spark):
    r = one(spark, G.parse_mutation(F.col("c")), c="S83L")
    assert (r.wild, r.pos, r.mutant) == ("S", 83, "L")
    assert one(spark, G.parse_mutation(F.col("c")), c="83L") is None
    assert one(spark, G.mutation_code(F.lit("S"), F.lit(83), F.col("c")), c="L") == "S83L"
    assert one(spark, G.in_qrdr(F.col("g"), F.lit(83)), g="gyrA") is True
    assert one(spark, G.in_qrdr(F.col("g"), F.lit(60)), g="gyrA") is False
    conf = G.resistance_confidence(F.lit("gyrA"), F.expr("array(named_struct('pos', 83, 'blosum', -2), named_struct('pos', 5, 'blosum', 4))"), F.lit(0.9), F.lit(60))
    assert one(spark, conf) == pytest.approx(2 * 0.25 * 0.9)


@pytest.mark.parametrize(("w", "code"), [(0.0, 0), (0.1, 6553), (0.5, 32767), (0.9, 58981), (1.0, 65535), (2.0, 65535)])
def test_weights(spark, w, code):
    assert one(spark, S.encode_weight(F.col("w")), w=w) == code


def test_scores(spark):
    assert one(spark, S.category(F.col("x"), S.UNIQUENESS_CUTS), x=0.95) == 7
    assert one(spark, S.get_bits(S.set_bits(F.lit(255), F.lit(2), 3, 3), 3, 3)) == 2
    assert one(spark, S.fragment_probability(F.lit(100.0), F.lit(350.0), F.lit(50.0))) == 0.01
    assert one(spark, S.error_class(F.lit("Network timeout; file not found"), F.lit(0))) == "permanent"
    assert one(spark, S.error_class(F.lit("x"), F.lit(143))) == "transient"
    assert one(spark, S.error_class(F.lit(None).cast("string"), F.lit(None).cast("int"))) == "unknown"
    assert one(spark, S.retry_delay(F.lit(2), F.lit(0.0))) == pytest.approx(264)
    assert S.bloom_size(1000, 0.01) == (9586, 7)


def test_hashes(spark):
    assert H.murmur32(b"") == 0 and H.murmur32(b"hello") == 0x248BFA47 and H.murmur32(b"hello, world") == 0x149BBB7F
    x = np.array([1, 2**63], np.uint64)
    want = []
    for v in x.tolist():
        v ^= v >> 33
        v = v * 0xFF51AFD7ED558CCD % 2**64
        v ^= v >> 33
        v = v * 0xC4CEB9FE1A85EC53 % 2**64
        want.append(v ^ v >> 33)
    assert H.finalise(x).tolist() == want
    assert spark.range(3).select(H.murmur_finaliser("id").alias("h")).count() == 3


def brute(a, b, pair, gap, band):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], (0, -1, -1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            if band is not None and abs(i - j) > band:
                continue
            h[i][j] = max(0, h[i - 1][j - 1] + pair(a[i - 1], b[j - 1]), h[i - 1][j] + gap, h[i][j - 1] + gap)
            if h[i][j] > best[0]:
                best = (h[i][j], i - 1, j - 1)
    return best[0]


@pytest.mark.parametrize("band", [None, 3, 15])
def test_smith_waterman(band):
    rng = np.random.default_rng(3)
    a = ["".join(rng.choice(list(Q.RESIDUES[:20]), n)) for n in (1, 5, 30, 50, 17)]
    b = [x[3:] + "WW" if len(x) > 5 else x for x in a[::-1]][::-1]
    pair = lambda x, y: int(A.BLOSUM62[Q.RESIDUES.index(x), Q.RESIDUES.index(y)])
    got, _, _ = A.smith_waterman(a, b, gap=-3, band=band)
    assert got.tolist() == [brute(x, y, pair, -3, band) for x, y in zip(a, b, strict=True)]
    got, _, _ = A.smith_waterman(a, b, match=2, mismatch=-1, gap=-1, band=band)
    assert got.tolist() == [brute(x, y, lambda p, q: 2 if p == q else -1, -1, band) for x, y in zip(a, b, strict=True)]


def test_alignment_columns(spark):
    df = spark.createDataFrame([("MKTAYIAKQR", "MKTAYIAKQR"), ("AAAA", "WWWW")], "q string, t string")
    got = [r.s.score for r in df.select(A.local_score(band=None)("q", "t").alias("s")).collect()]
    assert got == [sum(int(A.BLOSUM62[Q.RESIDUES.index(c), Q.RESIDUES.index(c)]) for c in "MKTAYIAKQR"), 0]
    assert one(spark, A.blosum62(F.col("a"), F.col("b")), a="W", b="W") == 11
    assert one(spark, A.blosum62(F.col("a"), F.col("b")), a="j", b="A") == 0
    rows = spark.createDataFrame([("AAAASSSSSSSSAA", "AAAASSSSSSSSTA", 4, 4)], "q string, t string, i int, j int")
    m = rows.select(A.seed_extension(8, 3, 30, False)("q", "t", "i", "j").alias("m")).head().m
    assert (m.query_start, m.length, [(x.pos, x.ref, x.alt) for x in m.mutations]) == (0, 14, [(12, "T", "A")])


def test_scoring_matrix():
    at = Q.RESIDUES.index
    score = lambda a, b: int(A.BLOSUM62[at(a), at(b)])
    assert (A.BLOSUM62 == A.BLOSUM62.T).all()
    want = {"WW": 11, "CC": 9, "BN": 3, "BD": 4, "BB": 4, "ZE": 4, "ZQ": 3, "ZZ": 4, "BZ": 1, "XX": -1, "XA": 0, "XC": -2, "**": 1, "*A": -4, "BK": 0, "ZK": 1}
    assert {k: score(*k) for k in want} == want
