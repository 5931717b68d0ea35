"""Chains against all chains, anchor pairs, and best paths against all paths."""

import itertools
import random

import numpy as np
import pytest

from strandline.operators import chaining, graph


def brute(seeds, gap):
    """Every seed linked to every one before it."""
    best = {}
    for q, t, n in sorted(seeds):
        before = [s - gap * (q - a - m + t - b - m) for (a, b, m), s in best.items() if a + m <= q and b + m <= t]
        best[q, t, n] = chaining.MATCH * n + max([0, *before])
    return max(best.values())


@pytest.mark.parametrize("gap", [0, 1, 7])
def test_chain_scores(gap):
    rng = random.Random(gap)
    for _ in range(200):
        seeds = list({(rng.randrange(60), rng.randrange(60), rng.choice([3, 3, 5, 9])) for _ in range(rng.randint(1, 40))})
        q, t, n = (np.array(x) for x in zip(*seeds, strict=True))
        score, chain = chaining.best_chain(q, t, n, gap)
        assert score == brute(seeds, gap)
        told = chaining.MATCH * int(n[chain].sum())
        for a, b in itertools.pairwise(chain):
            assert q[a] + n[a] <= q[b] and t[a] + n[a] <= t[b]
            told -= gap * int(q[b] - q[a] - n[a] + t[b] - t[a] - n[a])
        assert told == score


def test_chains_of_many_pairs(spark):
    """Pairs of one seed and of thousands, runs that cross Arrow batches, null keys and repeated seeds."""
    rng = random.Random(1)
    rows = [(i % 50, None if i % 7 == 0 else "r", rng.randrange(300), rng.randrange(300), 4) for i in range(1500)]
    rows += [(99, "long", 5 * i, 6 * i, 5) for i in range(3000)] + rows[:100]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "170")
    try:
        df = spark.createDataFrame(rows, "read_id long, ref string, q int, t int, size int")
        got = {(r.read_id, r.ref): r for r in chaining.chains(df, ["read_id", "ref"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs = {}
    for a, b, *seed in rows:
        pairs.setdefault((a, b), set()).add(tuple(seed))
    assert got.keys() == pairs.keys()
    assert all(got[k].score == brute(v, 1) for k, v in pairs.items() if k[0] != 99)
    long = got[99, "long"]
    assert (long.seeds, long.score, long.q_start, long.q_end, long.t_end) == (3000, 50 * 3000 - 2999, 0, 15000, 6 * 2999 + 5)


def test_anchor_pairs(spark):
    rows = [(1, 1, 10, 80), (1, 1, 11, 80), (1, 1, 20, 50), (1, 2, 21, 60), (1, 2, 10, 40), (2, 1, 10, 90), (3, 1, 20, 5), (3, 2, 10, 90), (4, 1, 10, 80), (4, 1, 20, 80)]
    chained = spark.createDataFrame(rows, "pair_id long, mate int, ref_id long, score long")
    genes = spark.createDataFrame([(10, True), (11, True), (20, False), (21, False)], "ref_id long, gene boolean")
    got = {tuple(r) for r in chaining.anchor_pairs(chained, genes).collect()}
    assert got == {(1, 1, 10, 21, 140), (1, 2, 10, 20, 90), (3, 2, 10, 20, 95)}
    assert {tuple(r) for r in chaining.anchor_pairs(chained, genes, least=10).collect()} == {(1, 1, 10, 21, 140), (1, 2, 10, 20, 90)}


def test_best_paths_are_those_of_all_paths(spark):
    rng = random.Random(2)
    edges = [(f"{a:02d}", f"{b:02d}", float(rng.randint(-3, 9))) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.5]
    cover = {f"{i:02d}": (rng.randint(1, 3) / 2, rng.randint(1, 4) / 4) for i in range(14)}
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    scores = spark.createDataFrame([(k, *v) for k, v in cover.items()], "id string, coverage double, identity double")
    sources = spark.createDataFrame([("00",), ("01",), ("00",)], "id string")
    got = {(r.start, r.node, r.place): (r.score, r.path) for r in graph.best_paths(df, scores, sources, k=3).collect()}
    out = {}
    for s in ("00", "01"):
        stack, all_ = [(0.0, [s])], []
        while stack:
            score, path = stack.pop()
            for a, b, w in edges:
                if a == path[-1]:
                    stack.append((score + w * cover[b][0] * cover[b][1], [*path, b]))
                    all_.append(stack[-1])
        for node in {p[-1] for _, p in all_}:
            best = sorted(((x, p) for x, p in all_ if p[-1] == node), key=lambda x: (-x[0], x[1]))[:3]
            out |= {(s, node, i): b for i, b in enumerate(best, 1)}
    assert got == out


def test_a_million_paths_are_not_listed(spark):
    """Twelve layers of four nodes: 4 ** 12 paths to each node of the last."""
    edges = [(100 * layer + a, 100 * layer + 100 + b, float(a + b)) for layer in range(12) for a in range(4) for b in range(4)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    scores = spark.createDataFrame([(100 * layer + a, 1.0, 1.0) for layer in range(13) for a in range(4)], "id long, coverage double, identity double")
    got = graph.best_paths(df, scores, spark.createDataFrame([(3,)], "id long"), k=2).where("node = 1203").orderBy("place").collect()
    assert got[0].score == 6.0 * 12 and got[0].path == [100 * i + 3 for i in range(13)] and got[1].score == 6.0 * 12 - 2


def test_cycles_raise(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, weight double")
    scores = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0)], "id long, coverage double, identity double")
    with pytest.raises(RuntimeError):
        graph.best_paths(df, scores, spark.createDataFrame([(1,)], "id long"), most=4)
