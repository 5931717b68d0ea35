"""Groups by read or pair take tasks by their rows, not by the session's shuffle partitions."""

import random

import pytest

from strandline import storage
from strandline.operators import classify, em, taxonomy

TAXA = [(1, None), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3), (7, 4), (90, None), (91, 90)]
PARENT = dict(TAXA)


def up(x):
    out = []
    while x is not None:
        out.append(x)
        x = PARENT.get(x)
    return out


def lca(a, b):
    """(ancestor, steps from a, steps from b)."""
    if a in PARENT and b in PARENT:
        for i, x in enumerate(up(a)):
            if x in up(b):
                return x, i, up(b).index(x)
    return None, None, None


@pytest.fixture
def tree(spark):
    rows = [(i, p, "rank", f"t{i}") for i, p in TAXA]
    return taxonomy.closure(spark.createDataFrame(rows, "id long, parent long, rank string, name string"), 3)


@pytest.fixture
def few_rows(monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 10)


def hits(spark, n=300):
    rng = random.Random(3)
    rows = [(rng.randrange(60), rng.randrange(4), rng.random() < 0.5, float(rng.randrange(9)), rng.randrange(5)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "pair_id long, gene_id long, is_r2 boolean, score double, taxon long").coalesce(1)


def test_tasks_grow_with_rows(spark, few_rows):
    _, df = hits(spark)
    assert em.concordance(df).groupBy("pair_id", "gene_id", "concordant").count().rdd.getNumPartitions() == 30
    assert classify.by_pair(df, mate="is_r2").rdd.getNumPartitions() == 30
    assert classify.by_vote(df, read="pair_id").rdd.getNumPartitions() == 30
    assert classify.within_best(df, read="pair_id").rdd.getNumPartitions() == 30


def test_dealt_rows_give_the_same_pairs(spark, few_rows):
    rows, df = hits(spark)
    mates = {}
    for p, g, m, _, _ in rows:
        mates.setdefault((p, g), set()).add(m)
    got = sorted((r.pair_id, r.gene_id, r.concordant, r.pair_score) for r in em.concordance(df).collect())
    assert got == sorted((p, g, len(mates[p, g]) == 2, s * (2.0 if len(mates[p, g]) == 2 else 0.5)) for p, g, _, s, _ in rows)


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_ancestors_with_a_tree_sent_or_joined(spark, tree, few_rows, monkeypatch, sent):
    """Of pairs and of groups; nulls, unknown taxa and other roots have none."""
    monkeypatch.setattr(taxonomy, "TREE_BYTES", sent)
    ids = [*PARENT, 55, None]
    pairs = [(a, b, i) for i, (a, b) in enumerate((a, b) for a in ids for b in ids)]
    got = {r.x: (r.lca, r.up_a, r.up_b) for r in taxonomy.lca_pairs(spark.createDataFrame(pairs, "a long, b long, x long"), tree).collect()}
    assert got == {x: lca(a, b) for a, b, x in pairs}
    rng = random.Random(8)
    groups = {k: [rng.choice(ids if rng.random() < 0.2 else list(PARENT)[:7]) for _ in range(rng.randint(1, 4))] for k in range(60)}
    df = spark.createDataFrame([(k, t) for k, ts in groups.items() for t in ts] + [(None, 2)], "k long, t long")
    want = {}
    for k, ts in groups.items():
        shared = [x for x in up(ts[0]) if all(t in PARENT and x in up(t) for t in ts)] if all(t in PARENT for t in ts) else []
        if shared:
            steps = [up(t).index(shared[0]) for t in ts]
            want[k] = (shared[0], len(set(ts)), max(steps) - min(steps))
    out = taxonomy.lca_groups(df, tree, "k", "t")
    assert {r.k: (r.lca, r.n_taxa, r.spread) for r in out.collect()} == want
    assert out.rdd.getNumPartitions() >= 12


def test_consistency_needs_no_shuffle_of_its_own(spark, tree, few_rows):
    votes = [(r, t, (r * t) % 5 + 1) for r in range(40) for t in (2, 4, 6, 55)]
    df = storage.dealt(spark.createDataFrame(votes, "read_id long, taxon long, votes long"), "read_id")
    out = taxonomy.consistency(df, tree)
    assert out.rdd.getNumPartitions() == 16
    for row in out.collect():
        own = [(t, n) for r, t, n in votes if r == row.read_id]
        best = min(own, key=lambda x: (-x[1], x[0]))[0]
        far = {t: (1.0 if lca(best, t)[0] is None else min(1.0, sum(lca(best, t)[1:]) / 20)) for t, _ in own}
        assert row.best == best and row.linear == pytest.approx(sum((1 - far[t]) * n for t, n in own) / sum(n for _, n in own))
