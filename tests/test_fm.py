"""The FM index against plain search, whatever the shards."""

import random

import numpy as np
import pytest

from strandline.operators import fm


def dna(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_suffixes_and_places():
    rng = random.Random(1)
    for _ in range(40):
        text = dna(rng, rng.randint(1, 300), rng.choice(["A", "AC", "ACGT", "ACGTN"]))
        codes = fm._CODE[np.frombuffer(text.encode(), np.uint8)]
        ended = [*codes.tolist(), 0]
        order = fm.suffix_array(np.append(codes, np.uint8(0))).tolist()
        assert order == sorted(range(len(ended)), key=lambda i: ended[i:])
        index = {k: v.tobytes() for k, v in fm.index_of(codes).items()} | {"refs": [7], "starts": [0]}
        shard = fm.Shard(index)
        assert shard.located(np.arange(len(ended))).tolist() == order
        asked = dna(rng, 50)
        n, low, high = shard.longest(fm._CODE[np.frombuffer(asked.encode(), np.uint8)])
        for e in range(50):
            want = max((k for k in range(e + 2) if asked[e + 1 - k : e + 1] in text), default=0)
            assert n[e] == want
            if want:
                piece = asked[e + 1 - want : e + 1]
                assert sorted(shard.located(np.arange(low[e], high[e])).tolist()) == [i for i in range(len(text)) if text.startswith(piece, i)]


def brute(read, refs, least):
    text = [t for _, t in refs]
    size = [max(k for k in range(e + 2) if k == 0 or ("N" not in read[e + 1 - k : e + 1] and any(read[e + 1 - k : e + 1] in t for t in text))) for e in range(len(read))]
    out = set()
    for e, n in enumerate(size):
        if n >= least and (e + 1 == len(read) or e + 1 - size[e + 1] + 1 > e - n + 1):
            piece = read[e - n + 1 : e + 1]
            out |= {(e - n + 1, n, r, i) for r, t in refs for i in range(len(t)) if t.startswith(piece, i)}
    return out


@pytest.mark.parametrize("shard, sent", [(1 << 20, 1 << 25), (300, 1 << 25), (300, 2000), (1, 1)])
def test_maximal_matches(spark, monkeypatch, shard, sent):
    """One shard, many in one pass, many passes: the same stretches at the same places."""
    monkeypatch.setattr(fm, "SENT_BYTES", sent)
    monkeypatch.setattr(fm, "READ_BASES", 150)
    rng = random.Random(2)
    base = dna(rng, 200)
    refs = [(i, dna(rng, rng.choice([5, 90, 250])) + base[i * 10 : i * 10 + 60] + rng.choice(["", "N", "NN"]) + dna(rng, 30)) for i in range(10)]
    reads = [(i, dna(rng, 40) + base[s : s + 50] + rng.choice(["", "N"]) + refs[i % 10][1][:30]) for i, s in enumerate(rng.randrange(150) for _ in range(20))]
    reads += [(50, ""), (51, None), (52, "ACG"), (53, "N" * 10), (54, refs[3][1]), (55, base)]
    a, b = spark.createDataFrame(reads, "read_id long, seq string").repartition(3), spark.createDataFrame([*refs, (77, None), (78, "")], "ref_id long, seq string").coalesce(1)
    index = fm.build(b, shard_bases=shard)
    assert (index.count() > 1) == (shard < 1 << 20)
    got = fm.maximal_matches(a, index, least=9).collect()
    assert {(r.read_id, r.q, r.length, r.ref_id, r.t) for r in got} == {(i, *m) for i, s in reads for m in brute(s or "", refs, 9)} and len(set(got)) == len(got)


def test_reads_are_searched_once_by_many_tasks(spark, monkeypatch):
    """Shards that are sent together need one pass, whatever their number, and reads of one file are many tasks' work."""
    monkeypatch.setattr(fm, "TASK_BASES", 100)
    rng = random.Random(4)
    refs, reads = [(i, dna(rng, 200)) for i in range(5)], [(i, dna(rng, 60)) for i in range(50)]
    index = fm.build(spark.createDataFrame(refs, "ref_id long, seq string").coalesce(1), shard_bases=250)
    assert index.count() == 5
    found = fm.maximal_matches(spark.createDataFrame(reads, "read_id long, seq string").coalesce(1), index, least=5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and found.rdd.getNumPartitions() == 30
    assert {(r.read_id, r.q, r.length, r.ref_id, r.t) for r in found.collect()} == {(i, *m) for i, s in reads for m in brute(s, refs, 5)}


def test_ranks_count_letters():
    rng = random.Random(6)
    for n in (0, 1, 30, 31, 32, 63, 64, 65, 200):
        index = fm.index_of(np.array([rng.randint(1, 5) for _ in range(n)], np.uint8))
        shard = fm.Shard({**index, "refs": [1], "starts": [0]})
        for c in range(6):
            want = [int((index["bwt"][:i] == c).sum()) for i in range(n + 2)]
            assert shard.rank(np.full(n + 2, c), np.arange(n + 2)).tolist() == want


def test_no_references(spark):
    empty = fm.build(spark.createDataFrame([], "ref_id long, seq string"))
    assert fm.maximal_matches(spark.createDataFrame([(1, "ACGT")], "read_id long, seq string"), empty).count() == 0
