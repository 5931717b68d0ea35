"""Bloom filters and the screens that use them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import sequence as Q
from strandline.operators import bloom, kmers
from strandline.storage import written


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_false_positive_rate_is_the_stated_one():
    rng = np.random.default_rng(1)
    keys, others = np.split(rng.integers(0, 1 << 62, 400_000), 2)
    for bits in (8, 16, 24):
        words = bloom.words_for(len(keys), bits)
        table = np.zeros(words, np.int64)
        word, mask = bloom.places(keys, words)
        np.bitwise_or.at(table, word, mask)
        piece = bloom.Piece(words, 0, table)
        assert len(piece.among(keys)) == len(keys)
        rate, stated = len(piece.among(others)) / len(others), bloom.false_positive_rate(len(keys), words)
        assert 0.85 * stated <= rate <= 1.15 * stated + 1e-4


def test_filters_merge_and_pieces_cover_all(spark):
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 62, 3000)
    df = spark.createDataFrame([(int(x),) for x in [*keys, *keys[:100]]] + [(None,)], "kmer long").repartition(3)
    words = bloom.words_for(3000)
    whole = {r.word: r.bits for r in bloom.build(df, words).collect()}
    halves = bloom.merged(bloom.build(df.where("kmer % 2 = 0"), words), bloom.build(df.where("kmer % 2 <> 0"), words))
    assert whole == {r.word: r.bits for r in halves.collect()}
    cut = list(bloom.pieces(written(bloom.build(df, words), "bloom"), words, size=1000))
    assert len(cut) == -(-words * 8 // 1000) and sum(len(p.bits) for p in cut) == words
    assert sorted(i for p in cut for i in p.among(keys).tolist()) == list(range(len(keys)))


@pytest.mark.parametrize("exact, piece, most", [(10**6, 1 << 20, 8), (0, 1 << 20, 8), (0, 4096, 100), (0, 512, 2)])
def test_screens_are_exact_however_the_reference_travels(spark, monkeypatch, exact, piece, most):
    """As keys, as one piece, as several, and shuffled whole: the same reads."""
    monkeypatch.setattr(bloom, "PIECE_BYTES", piece)
    monkeypatch.setattr(kmers, "PIECES", most)
    rng = random.Random(3)
    ref = [dna(rng, 400) for _ in range(10)]
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = [(i, s) for i, s in enumerate([dna(rng, 150) for _ in range(20)] + [r[50:200] for r in ref] + [turned(ref[0][10:90]), "ACG", "", None, ref[1][:30] + "N" + ref[1][30:55]])]
    a, b = spark.createDataFrame(reads, "id long, seq string"), spark.createDataFrame(list(enumerate(ref)), "rid long, seq string")
    k = 21
    words = lambda s: {s[i : i + k] for i in range(len(s or "") - k + 1) if "N" not in s[i : i + k]}
    known = set().union(*map(words, ref))
    for both in (False, True):
        have = known | {turned(w) for w in known} if both else known
        got = {r.id: r.found for r in kmers.screen(a, b, k, "id", least=3, exact=exact, both_strands=both).collect()}
        assert got == {i: n for i, s in reads if (n := len(words(s) & have)) >= 3}
    pairs = {(r.id, r.rid): r.shared for r in kmers.matches(a, b, k, "id", "rid", exact=exact).collect()}
    assert pairs == {(i, j): n for i, s in reads for j, r in enumerate(ref) if (n := len(words(s) & words(r)))}
    for mask in (0, 0x2A5F1C3D7):
        least = {i: len(minimizers(s, k, 6, mask) & set().union(*(minimizers(r, k, 6, mask) for r in ref))) for i, s in reads}
        got = {r.id: r.found for r in kmers.minimizer_screen(a, b, k, 6, "id", exact=exact, mask=mask).collect()}
        assert got == {i: n for i, n in least.items() if n}


def minimizers(s, k, w, mask):
    out = set()
    for run in (s or "").split("N"):
        code = [sum("ACGT".index(c) << 2 * (k - 1 - j) for j, c in enumerate(run[i : i + k])) for i in range(len(run) - k + 1)]
        out |= {min(code[i : i + w], key=lambda x: x ^ mask) for i in range(max(1, len(code) - w + 1)) if code}
    return out


def test_what_is_shuffled_is_hits_and_the_stated_rate(spark):
    rng = random.Random(4)
    ref = [dna(rng, 5000) for _ in range(8)]
    reads = [(i, dna(rng, 1000)) for i in range(200)] + [(900 + i, r[:1000]) for i, r in enumerate(ref)]
    a, b = spark.createDataFrame(reads, "id long, seq string"), spark.createDataFrame(list(enumerate(ref)), "rid long, seq string")
    known = written(kmers.packed_kmers(b, "rid", "seq", 25).select("kmer").distinct(), "known")
    n, total = known.count(), kmers.packed_kmers(a, "id", "seq", 25).count()
    true = sum(1000 - 24 for _ in ref)
    out = kmers.may_meet(a, known, "id", "seq", 25, exact=0).count()
    rate = bloom.false_positive_rate(n, bloom.words_for(n))
    assert rate < 0.01 and true <= out <= true + 1.5 * rate * (total - true) + 20


def test_a_larger_reference_is_screened_by_the_reads(spark):
    """Of a reference with more bases than the reads only k-mers that reads may have are kept, and no match is lost."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    refs = [(i, text(400)) for i in range(60)]
    found = [(f"r{i}", refs[i][1][50:90]) for i in range(0, 60, 7)] + [("none", text(40)), ("null", None)]
    reads, reference = spark.createDataFrame(found, "id string, seq string"), spark.createDataFrame(refs, "ref long, seq string")
    for exact in (0, None):
        kept = kmers._met(reads, reference, 20, "id", "ref", "seq", exact)[1]
        got = {(r.id, r.ref, r.shared) for r in kmers.matches(reads, reference, 20, "id", "ref", exact=exact).collect()}
        assert got == {(f"r{i}", i, 21) for i in range(0, 60, 7)}
        assert kept.count() < 0.1 * 60 * 381


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.mark.parametrize("k", [6, 7])
def test_of_short_kmers_each_has_its_own_bit_and_none_is_shuffled(spark, monkeypatch, k):
    """Reads are counted where they are packed, also where an id has several rows, or none; no k-mer is joined."""
    monkeypatch.setattr(kmers, "_met", None)
    rng = random.Random(21)
    ref = [dna(rng, 800) for _ in range(4)] + [None, "", "ACGTNACG"]
    reads = [(i % 25, dna(rng, 60)) for i in range(40)] + [(90, None), (91, "AC"), (None, ref[0][:30]), (None, turned(ref[0][20:50])), (92, "ACGTN" + ref[1][:20] + "N" + ref[1][:20])]
    a, b = spark.createDataFrame(reads, "id long, seq string").repartition(5), spark.createDataFrame(list(enumerate(ref)), "rid long, seq string")
    words = lambda s: {s[i : i + k] for i in range(len(s or "") - k + 1) if "N" not in s[i : i + k]}
    known = set().union(*map(words, ref))
    by_id = {}
    for i, s in reads:
        by_id.setdefault(i, set()).update(words(s))
    for both in (False, True):
        have = known | {turned(x) for x in known} if both else known
        for rows, of in ((a, by_id), (a.where("id = 92"), {92: by_id[92]})):
            got = [(r.id, r.found) for r in kmers.screen(rows, b, k, "id", least=3, exact=0, both_strands=both).collect()]
            assert sorted(got, key=str) == sorted(((i, n) for i, x in of.items() if (n := len(x & have)) >= 3), key=str)
    single = list({i: s for i, s in reads}.items())
    least = {i: len(minimizers(s, k, 4, 0) & set().union(*(minimizers(r, k, 4, 0) for r in ref))) for i, s in single}
    got = {r.id: r.found for r in kmers.minimizer_screen(spark.createDataFrame(single, "id long, seq string"), b, k, 4, "id", exact=0).collect()}
    assert got == {i: n for i, n in least.items() if n}


def test_neither_side_keeps_what_the_other_cannot_have(spark):
    """Whichever side is larger; and the k-mers of the conversations beside 6 GB of documents, some 600 million, still go as a filter."""
    rng = random.Random(22)
    long, short = [(i, dna(rng, 900)) for i in range(30)], [(100 + i, dna(rng, 200)) for i in range(30)]
    short += [(200, long[3][1][10:60])]
    for reads, reference in ((long, short), (short, long)):
        a, b = spark.createDataFrame(reads, "id long, seq string"), spark.createDataFrame(reference, "ref long, seq string")
        for exact in (0, None):
            kept = kmers._met(a, b, 20, "id", "ref", "seq", exact)
            assert all(31 <= rows.count() < 31 + 0.03 * 30 * 900 for rows in kept)
            assert [r.shared for r in kmers.matches(a, b, 20, "id", "ref", exact=exact).collect()] == [31]
    assert bloom.words_for(600_000_000) * 8 <= kmers.PIECES * bloom.PIECE_BYTES


def test_blocks_are_the_same_however_they_travel(spark):
    """Few bits of a block go as places, many as they are; ranges of a direct filter make up the whole."""
    rng = np.random.default_rng(5)
    bits = np.zeros(5 * bloom.BLOCK + 7, np.int64)
    bits[: bloom.BLOCK] = rng.integers(-(1 << 62), 1 << 62, bloom.BLOCK)
    bits[3 * bloom.BLOCK + 5], bits[-1] = -1, 1
    blocks = bloom._sent(bits, 7 * bloom.BLOCK)
    assert [(w - 7 * bloom.BLOCK, b is None, p is None) for w, b, p in blocks] == [(0, False, True), (3 * bloom.BLOCK, True, False), (5 * bloom.BLOCK, True, False)]
    rows = spark.createDataFrame(blocks + blocks, "word long, bits binary, places binary")
    piece = bloom._piece(bloom._ored(rows), 20 * bloom.BLOCK, 7 * bloom.BLOCK, 7 * bloom.BLOCK + len(bits))
    assert (piece.bits == bits).all()
    keys = np.unique(rng.integers(0, 1 << 20, 3000))
    table = spark.createDataFrame([(int(x),) for x in keys], "kmer long").repartition(3)
    cut = [bloom._piece(bloom.build(table, 1 << 14, start=s, stop=s + 3000 if s < 12000 else 1 << 14, direct=True), 1 << 14, s, s + 3000 if s < 12000 else 1 << 14, True) for s in range(0, 15000, 3000)]
    assert sum(int(np.bitwise_count(p.bits.view(np.uint64)).sum()) for p in cut) == len(keys)
    assert sorted(i for p in cut for i in p.among(keys).tolist()) == list(range(len(keys)))
    assert not any(len(p.among(np.setdiff1d(np.arange(1 << 20), keys))) for p in cut)


def test_distinct_keys_are_counted_by_their_least_hashes(spark):
    for n in (0, 5, 4000, 60_000):
        rows = spark.range(n).select(F.explode(F.array(F.col("id") * 7919, F.col("id") * 7919)).alias("kmer")).repartition(3)
        assert bloom.distinct(rows) == n if n < bloom.SKETCH else abs(bloom.distinct(rows) - n) < 0.08 * n
        assert bloom.listed(rows).count() == n


def test_reverse_complements_of_every_length():
    rng = random.Random(23)
    for k in range(1, 32):
        texts = [dna(rng, k) for _ in range(20)]
        code = lambda s: kmers.packed_windows(s.encode(), k)[1][0]
        assert kmers.reverse_complements(np.array([code(s) for s in texts]), k).tolist() == [code(turned(s)) for s in texts]


def test_letters_become_the_same_bases_over_batches(spark):
    texts = ["", None, "Abc xyz, Z!", "caf\u00e9 \u212aelvin \u0130stanbul \u00df\u017f \U0001f600k", "a\nb\0c\u0301", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(Q.dna_of_text(F.col("text")).alias("a"), Q.dna_of_long_text("text").alias("b"))
    assert all(r.a == r.b for r in rows.collect())
