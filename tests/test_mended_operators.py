"""As-of joins with events that hold nothing, running shares over ranges, placements over tiles, reports that say what they leave out."""

import datetime as dt
import json
import random

import pytest

from strandline.operators import asof, classify, em, taxonomy
from strandline.sources import sinks
from strandline.streaming import jobs


def test_an_event_without_a_value_is_an_event(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rng = random.Random(4)
    events = [("a", at(1), 1), ("a", at(2), None), ("b", at(1), None), ("b", at(1), 7), ("c", at(0), 5), ("c", at(40), None)]
    events += [("d", at(rng.randrange(200)), rng.choice([None, i])) for i in range(60)]
    asked = [(0, "a", at(3)), (1, "a", at(1)), (2, "b", at(1)), (3, "c", at(39)), (4, "c", at(90)), (5, "z", at(1)), (6, "a", None), (7, None, at(9))]
    asked += [(100 + i, "d", at(rng.randrange(220))) for i in range(40)]
    got = asof.last_before(spark.createDataFrame(asked, "id int, k string, at timestamp"), spark.createDataFrame(events, "k string, at timestamp, v int"), "k", "at", "v", "12 hours")
    want = {}
    for i, k, t in asked:
        mine = [(e, v is not None, v or 0) for x, e, v in events if k is not None and x == k and t is not None and e <= t]
        want[i] = max(mine)[2] if mine and max(mine)[1] else None
    assert {r.id: r.v for r in got.collect()} == want


@pytest.mark.parametrize("kind", ["long", "double"])
def test_running_shares_go_on_over_ranges(spark, kind):
    """Most rows of one value, and many values: shares in order, whatever the ranges."""
    rng = random.Random(6)
    rows = [(i, 1) for i in range(300)] + [(1000 + i, rng.randrange(2, 500)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, n long").selectExpr("id", f"CAST(n AS {kind}) AS n").repartition(7)
    total, done, want = sum(n for _, n in rows), 0, {}
    for i, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        done += n
        want[i] = done / total
    assert {r.id: r.share for r in taxonomy.cumulative(df, "id").collect()} == pytest.approx(want)


@pytest.mark.parametrize("tile", [7, 64, 4096])
def test_placements_do_not_depend_on_tiles(spark, tile):
    rng = random.Random(7)
    genome = {g: "".join(rng.choice("ACGT") for _ in range(500)) for g in ("a", "b")}
    reads = [(i, genome[rng.choice("ab")][s : s + 60]) for i, s in enumerate([0, 440, *(rng.randrange(440) for _ in range(10))])]
    reads = [(i, s[:20] + rng.choice("ACGT") + s[21:]) for i, s in reads] + [(90, genome["a"][460:] + "ACGTACGTAC" * 2)]
    k, want = 8, {}
    for i, s in reads:
        for g, text in genome.items():
            places = {t - q for q in range(0, len(s) - k + 1, k) for t in range(len(text) - k + 1) if text[t : t + k] == s[q : q + k] and t >= q and t - q + len(s) <= len(text)}
            rated = [(sum(x == y for x, y in zip(s, text[p:], strict=False)) / len(s), -p) for p in places]
            if rated and max(rated)[0] >= 0.5:
                want[i, g] = (-max(rated)[1], max(rated)[0])
    placed = classify.placements(spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(list(genome.items()), "genome string, seq string"), k, None, 0.5, tile)
    assert {(r.read_id, r.genome): (r.place, r.identity) for r in placed.collect()} == want


def test_reports_say_what_they_leave_out(spark):
    df = spark.range(130).selectExpr("id", "id * 2 AS twice").orderBy("id")
    assert "30 more rows are left out" in sinks.report("R", {"all": df}) and "<p>30 more rows are left out</p>" in sinks.report("R", {"all": df}, form="html")
    assert "left out" not in sinks.report("R", {"all": df.limit(100)})
    assert len(json.loads(sinks.report("R", {"all": df}, form="json"))["all"]) == 130


def test_samples_in_tasks(spark):
    def work(row):
        if row["k"] % 3 == 0:
            raise ValueError(f"bad {row['k']}")

    df = spark.range(20).selectExpr("CAST(id AS string) AS sample_name", "id AS k").repartition(4)
    assert {r.sample_name: r.error for r in jobs.samples_apart(df, work).collect()} == {str(i): None if i % 3 else f"bad {i}" for i in range(20)}


def test_em_beyond_the_broadcast_limit(spark, monkeypatch):
    """A state too large to be sent is joined by a shuffle, with the same abundances."""
    rng = random.Random(8)
    hits = {(r, rng.randrange(12)): rng.randint(1, 9) for r in range(80) for _ in range(3)}
    candidates = spark.createDataFrame([(r, g, float(s)) for (r, g), s in hits.items()], "read_id long, gene_id long, score double")
    genes = spark.createDataFrame([(g, 300 + 40 * g, f"f{g % 3}", 1.0) for g in range(12)], "gene_id long, length int, family string, prior double")
    want = {r.gene_id: r.abundance for r in em.run(candidates, genes, rounds=5, tolerance=0).collect()}
    monkeypatch.setattr(em, "BROADCAST_BYTES", 12 * 16 * 5)
    monkeypatch.setattr(em.F, "broadcast", None)
    assert {r.gene_id: r.abundance for r in em.run(candidates, genes, rounds=5, tolerance=0).collect()} == pytest.approx(want)
