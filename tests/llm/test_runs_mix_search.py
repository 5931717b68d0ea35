"""Periodic runs, mixing and lexical search against brute force, on small and odd tables."""

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing, periodic, queries, search
from tests.llm.conftest import SCHEMA, odd_rows, words

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

# periodic runs


def brute_runs(w):
    """Every maximal stretch of a lag, and whether a smaller one holds all of it."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                run = w[i : i + length]
                if not any(run[:-d] == run[d:] for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("sampled", [8, 64])
def test_runs_of_random_words(monkeypatch, sampled):
    monkeypatch.setattr(periodic, "SAMPLED", sampled)
    rng = random.Random(sampled)
    for _ in range(300):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 60))]
        assert [tuple(r) for r in periodic.runs_of(np.array(w, np.int32)).tolist()] == brute_runs(w)
    for _ in range(15):
        w = []
        while len(w) < 500:  # long periods, cut off anywhere, beside each other
            base = [rng.randrange(rng.choice([1, 2, 40])) for _ in range(rng.randint(1, 90))]
            w += (base * 8)[: rng.randint(1, len(base) * 8)]
        runs = periodic.runs_of(np.array(w, np.int32))
        assert [tuple(r) for r in runs.tolist()] == brute_runs(w)
        kept = periodic.kept_words(len(w), runs)
        assert " ".join(str(x) for x, k in zip(w, kept, strict=True) if k) == collapsed(list(map(str, w)), brute_runs(w))


def test_runs_of_very_long_texts(monkeypatch):
    monkeypatch.setattr(periodic, "_CHARS", 100)
    rng = np.random.default_rng(2)
    w = [f"w{x}" for x in rng.integers(0, 3000, 40_000)]
    w[10_000:30_000] = [w[10_000 + i % 4_700] for i in range(20_000)]
    ids, names = periodic.numbered_words(" ".join(w))
    assert [names[i] for i in ids.tolist()] == w
    found = [tuple(r) for r in periodic.runs_of(ids).tolist()]
    (start, length, period), *rest = [r for r in found if r[1] > 1000]
    assert period == 4_700 and not rest and start <= 10_000 and start + length >= 30_000 and all(w[i] == w[i + 4_700] for i in range(start, start + length - 4_700))
    same, _ = periodic.numbered_words("x " * 20_000)
    assert periodic.runs_of(same).tolist() == [[0, 20_000, 1]]


def test_runs_of_odd_rows(spark, odd, empty):
    got = periodic.periodic_runs(odd).collect()
    want = []
    for r in odd_rows():
        w = SPACE.findall(r[1] or "")
        runs = brute_runs(w) if len(w) < 2000 else []
        want.append((r[0], len(w), runs, collapsed(w, runs)))
    assert collections.Counter((r.doc_id, r.n_words, str([tuple(x) for x in r.runs]), r.collapsed) for r in got) == collections.Counter((a, b, str(c), d) for a, b, c, d in want)
    assert any(r.runs for r in got) and periodic.periodic_runs(empty).count() == 0


def test_op11(spark):
    docs = {d["doc_id"]: d["text"] for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    got = {r.doc_id: r for r in queries.queries()["op11_periodic_runs"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    planted = 0
    for i, text in docs.items():
        w, h = SPACE.findall(text or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
            planted += 1
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if runs else None
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, milli)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert planted > 5


# mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """{source: words}: share by weight, cut at the top, share what is above again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left, parts = total - sum(most * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        above = {s for s in order if s not in full and weight[s] * left / parts > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in full else weight[s] * left / parts for s in order}
        full |= above


def documents(rng, n=3000):
    """One source with a third of all rows, small ones, an empty one, nulls, and repeated rows."""
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", "Z", None, "tiny"]) if i % 50 else "tiny"
        rows.append((i, None if source == "tiny" and i % 2 else words(rng, rng.choice([0, 1, 5, 20, 300])), "en", source, 1))
    rows += [rows[0]] * 400 + [(None, "a b c", None, None, None)] * 300
    return [(*r, "k", 1, "f", "l", "s") for r in rows] + [(9_000, None, None, "void", None, "k", 1, "f", "l", "s")]


def test_mix_meets_targets(spark):
    rows = documents(random.Random(4))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mix(df).collect()
    size = lambda r: len(SPACE.findall(r[1] or ""))
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == collections.Counter((r[0], size(r)) for r in rows)
    sizes, longest = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r[3]] += size(r)
        longest[r[3]] = max(longest[r[3]], size(r))
    want = brute_targets(sizes)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values())) and any(t == 2 * sizes[s] > 0 for s, t in want.items())
    of = {r[0]: r[3] for r in rows}
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[of[r.doc_id]] and r.target == pytest.approx(want[of[r.doc_id]])
        assert r.taken == r.copies * r["size"] and r.copies <= 2
        assert r.source_size == 0 or r.copies in (math.floor(r.target / r.source_size), math.ceil(r.target / r.source_size))
        taken[of[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= longest[s] + 1
    again = mixing.mix(df.repartition(3)).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, got))
    other = mixing.mix(df, seed=1).collect()
    assert collections.Counter(map(tuple, other)) != collections.Counter(map(tuple, got))


def test_mix_crosses_integers(spark):
    """The copies of one source are the integers between successive sums."""
    rows = [(i, words(random.Random(i), i % 40), "en", "ab"[i % 2], 1, "k", 1, "f", "l", "s") for i in range(200)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    for source in "ab":
        mine = [r for r in rows if r[3] == source]
        order = sorted(mine, key=lambda r: (-len(SPACE.findall(r[1])), hashlib.md5(str(r[0]).encode()).hexdigest()))
        one = got[mine[0][0]]
        at = int(hashlib.md5(f"0+{source}".encode()).hexdigest()[:15], 16) % one.source_size
        for r in order:
            crossed = (at + math.floor(one.target)) // one.source_size - at // one.source_size
            assert got[r[0]].copies == crossed
            at += math.floor(one.target)


def test_mixed_rows(spark, odd, empty):
    copies = collections.Counter()
    for r in mixing.mix(odd).collect():
        copies[r.doc_id] += r.copies
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == +copies
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


# search


def brute_search(docs, items, k=10):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    bags = [(i, collections.Counter(TERM.findall(lower(t)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_words = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = {}
    for item in {i for i, _ in items}:
        asked = collections.Counter()
        for text in {t for i, t in items if i == item}:
            asked.update(TERM.findall(lower(text)))
        scores = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // n_words
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, c in asked.items() if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        for rank, (s, none, i) in enumerate(heapq.nsmallest(k, scores), 1):
            out[item, rank] = (None if none else i, -s)
    return out


def test_postings_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 5, 1 << 40, (1 << 62) - 1, 0], np.int64)
    raw, ends = search.packed(values)
    assert search.unpacked(raw).tolist() == values.tolist() and ends[-1] == len(raw)
    assert len(search.unpacked(np.zeros(0, np.uint8))) == 0 and len(search.packed(values[:0])[0]) == 0


def test_long_products_of_lengths():
    n = np.array([3, 1 << 40], np.int64)
    assert search.length_norms(n, 1 << 40, 1 << 50).tolist() == [25 + 75 * x * (1 << 40) // (1 << 50) for x in n.tolist()]


@pytest.mark.parametrize("shard, block", [(1 << 23, 1 << 22), (400, 1 << 22), (1, 300)])
def test_search_of_odd_rows(spark, odd, empty, monkeypatch, shard, block):
    """Many shards, many blocks of queries, ties, null ids and repeated rows on both sides."""
    monkeypatch.setattr(search, "SHARD_BYTES", shard)
    monkeypatch.setattr(search, "QUERY_BYTES", block)
    rng = random.Random(8)
    rows = odd_rows() + [(100 + i // 2, words(rng, rng.randint(1, 30), "ab"), "en", "a", 1, "k", 1, "f", "l", "s") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    texts = [words(rng, 8, "ab"), "Aa aa b É é tail", rows[4][1], None, "", "unknownterm", "a b ab ba", "ß same LINE", words(rng, 40, "ab")]
    items = [*enumerate(texts), (0, texts[0]), (1, "same line"), (None, "ab ba a")]
    asked = spark.createDataFrame([(*x, 5, "s") for x in items], "item_id long, text string, score int, rank string")
    got = search.search(search.build(df), asked).collect()
    assert {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got} == brute_search([r[:2] for r in rows], items) and len(got) == len({(r.item_id, r["rank"]) for r in got})
    few = search.search(search.build(df), asked, k=3).collect()
    assert {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in few} == brute_search([r[:2] for r in rows], items, 3)


def test_search_of_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "a b"), (2, None)], "item_id long, text string")
    assert search.search(search.build(empty), items).count() == 0
    assert search.search(search.build(odd), items.where("false")).count() == 0
    assert search.search(search.build(odd.where(F.length("text") == 0)), items).count() == 0
