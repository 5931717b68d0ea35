"""Near and substring deduplication against brute force, and the pipeline's stages."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import common, components, simhash, suffix_dedup
from tests.llm.conftest import odd_rows, words

# SimHash


def brute_fingerprint(text, size):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize(("n", "radius"), [(2, 3), (17, 3), (200, 3), (1500, 3), (300, 8)])
def test_gray_index(n, radius):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    f = base[rng.integers(0, 6, n)].copy()
    for _ in range(radius + 1):
        f ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    f = np.unique(f)
    bucket = rng.integers(0, 3, len(f))
    i, j = (np.concatenate(x) for x in zip(*simhash.GrayIndex(f, bucket).links(radius)))
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    close = (np.bitwise_count(f[:, None] ^ f[None, :]) <= radius) & (bucket[:, None] == bucket[None, :])
    assert got == {(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(close, 1))), strict=True)}


def test_gray_rank_is_the_gray_order():
    n = np.arange(1024, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_simhash(spark, odd, empty):
    got = simhash.near_duplicates(odd).collect()
    rows = odd_rows()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(r[1], 3) for r in rows]
    groups = brute_components(fps, 3)
    low = {}
    for g, r in zip(groups, rows, strict=True):
        low[g] = min((x for x in (low.get(g), r[0]) if x is not None), default=None)
    want = collections.Counter((r[0], f"{f:016x}", low[g]) for r, f, g in zip(rows, fps, groups, strict=True))
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("hot", [20_000, 3])
@pytest.mark.parametrize(("radius", "agree"), [(3, 1), (4, 2)])
def test_links_and_hot_buckets(spark, hot, radius, agree):
    rng = np.random.default_rng(7)
    f = np.repeat(rng.integers(0, 2**63, 8, dtype=np.uint64), 30)
    for _ in range(5):
        f ^= np.where(rng.random(len(f)) < 0.7, np.uint64(1) << rng.integers(0, 64, len(f)).astype(np.uint64), np.uint64(0))
    f = np.unique(f)
    prints = spark.createDataFrame([(i, int(x)) for i, x in enumerate(f.view(np.int64))], "key long, fp long")
    got = {r.fp: r.component_id for r in simhash.clusters(prints, radius, agree, hot).collect()}
    groups = brute_components(f.tolist(), radius)
    low = {}
    for i, g in enumerate(groups):
        low[g] = min(low.get(g, i), i)
    assert got == {int(x): low[g] for x, g in zip(f.view(np.int64), groups, strict=True)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(20)] + [(200, i) for i in range(201, 230)] + [(7, 7)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicate_stage(spark, odd, empty):
    rng = random.Random(3)
    base = [words(rng, 300) for _ in range(4)]
    rows = [(i, b) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        w = b.split()
        w[150] = "changed"
        rows += [(10 + i, " ".join(w)), (20 + i, b.upper())]
    rows += [(0, base[0]), (None, words(rng, 200))]
    docs = spark.createDataFrame([(i, t, "x", "k") for i, t in rows], "doc_id long, text string, drop string, first string")
    kept = simhash.survivors(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "1", "2", "3", "None"]
    left = simhash.survivors(odd)
    assert left.columns == odd.columns and 0 < left.count() < odd.count()
    assert simhash.survivors(empty).count() == 0


@pytest.mark.parametrize("options", [{}, {"block_rows": 5}])
def test_near_duplicates_of_chains(spark, options):
    """No two rows of a chain that are alike both stay, and none goes that is like no row that stays."""
    rng = random.Random(12)
    rows = []
    for c in range(3):
        w = words(rng, 300).split()
        for i in range(25):  # each step changes two words: near rows are alike, far ones are not
            rows.append((100 * c + i, " ".join(w)))
            for at in rng.sample(range(300), 2):
                w[at] = words(rng, 1) + "q"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # so many tables link each chain from end to end
    kept = {r.doc_id for r in simhash.survivors(docs, recall=0.99999, **options).collect()}
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5)) for i, t in rows}
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    close = {(a, b) for a in sets for b in sets if a < b and like(a, b)}
    assert len(close) > 100 and not [p for p in close if set(p) <= kept]
    assert all(any(like(a, b) for b in kept) for a in set(sets) - kept) and len(kept) > 6
    if not options:
        want = []
        for i in sorted(sets):
            if not any(like(i, b) for b in want):
                want.append(i)
        assert kept == set(want)


def test_near_duplicates_beyond_the_broadcast_limit(spark, odd, empty, monkeypatch):
    """Members, marks and hot buckets too many to be sent are joined by a shuffle, with the same result."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(simhash.F, "broadcast", None)
    test_near_duplicate_stage(spark, odd, empty)
    monkeypatch.setattr(simhash.candidates, "__defaults__", (3,))
    test_near_duplicates_of_chains(spark, {})


def test_near_duplicates_found_from_a_similarity_of_0_8(spark):
    """Of pairs from 0.80 on, brute force tells how similar, nine in ten and more are found."""
    rng = random.Random(31)
    rows = []
    for c in range(500):
        w = words(rng, rng.choice([60, 150, 400]), "abcdefghijklmnopqrstuvwxyz").split()
        rows.append((2 * c, " ".join(w)))
        for at in rng.sample(range(len(w)), max(1, len(w) * rng.randint(4, 24) // 1000)):
            w[at] += "x"
        rows.append((2 * c + 1, " ".join(w)))
    kept = {r.doc_id for r in simhash.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [set(simhash.shingle_hashes(t.encode(), 5)) for _, t in rows]
    alike = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(rows), 2)]
    near = [c for c, x in enumerate(alike) if 0.8 <= x < 0.85]
    every = [c for c, x in enumerate(alike) if x >= 0.8]
    assert len(near) > 60 and len(every) > 150
    found = lambda cs: sum(2 * c + 1 not in kept for c in cs) / len(cs)
    assert found(near) >= 0.9 and found(every) >= 0.95
    assert all({2 * c, 2 * c + 1} <= kept for c, x in enumerate(alike) if x < 0.8)


# suffix sort


def brute_repeats(texts):
    n = suffix_dedup.SPAN
    seen = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def repeat_texts():
    rng = random.Random(5)
    base = [words(rng, 200, "abcdeéß") for _ in range(4)]
    texts = ["", None, "x" * 199, "x" * 200, "y" * 500, "ab" * 400, *base]
    passage = words(rng, 60)
    for _ in range(40):
        t, i, n = rng.choice(base), rng.randint(0, 600), rng.choice([150, 195, 199, 200, 201, 205, 230, 260, 500])
        texts.append(words(rng, rng.randint(1, 50)) + t[i : i + n] + words(rng, rng.randint(1, 50)) + (passage if rng.random() < 0.5 else ""))
    for _ in range(8):
        t = list(base[0])
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(len(t))] = "Z"
        texts.append("".join(t))
    return [*texts, base[1], base[1], base[2] + words(rng, 5)]


@pytest.mark.parametrize(("hot", "pack"), [(20_000, 1 << 23), (2, 3000)])
def test_suffix_dedup(spark, hot, pack):
    texts = repeat_texts()
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, pack string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(docs, hot_core=hot, pack_bytes=pack).collect()}
    assert got == dict(enumerate(brute_repeats([(t or "").encode() for t in texts])))


@pytest.mark.parametrize(("hot", "pack"), [(20_000, 1 << 23), (2, 3000)])
def test_suffix_dedup_beyond_the_broadcast_limit(spark, monkeypatch, hot, pack):
    """Verdicts and masks too large to be sent are joined by a shuffle, with the same result."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(suffix_dedup.F, "broadcast", None)
    test_suffix_dedup(spark, hot, pack)


def test_suffix_dedup_of_odd_tables(spark, odd, empty):
    docs = odd.where("text IS NULL OR length(text) < 20000")
    rows = docs.collect()
    want = collections.Counter((r.doc_id, *w) for r, w in zip(rows, brute_repeats([(r.text or "").encode() for r in rows]), strict=True))
    got = suffix_dedup.deduplicated(docs, with_text=True).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert suffix_dedup.deduplicated(odd).count() == odd.count()
    assert suffix_dedup.deduplicated(empty).count() == 0


def test_suffix_sort_against_sorted():
    rng = random.Random(4)
    for letters in ("a", "ab", "abc"):
        raw = "".join(rng.choice(letters) for _ in range(3000)).encode()
        n = 150
        start = np.array([rng.randint(0, 2900) for _ in range(n)])
        length = np.array([rng.randint(0, 63) for _ in range(n)])
        group = np.sort(np.array([rng.randint(0, 9) for _ in range(n)]))
        order, shared = suffix_dedup.suffix_sort(np.frombuffer(raw, np.uint8), start, length, group)
        want, lcp = suffix_dedup._byte_sort(np.frombuffer(raw, np.uint8), start, length, group)
        key = lambda i: (group[i], raw[start[i] : start[i] + length[i]])
        assert [key(i) for i in order] == [key(i) for i in want] and shared.tolist() == lcp.tolist()


def test_sections_do_not_change_anchors(monkeypatch):
    rng = random.Random(6)
    texts = [words(rng, n).encode() for n in (3, 50, 400, 2000)]
    ends = np.cumsum([len(t) for t in texts])
    buf, starts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], ends[:-1]])

    def all_of():
        found = [np.stack([p.astype(np.uint64), c, r]) for p, c, _, _, r in suffix_dedup.anchors(buf, starts, ends)]
        return np.concatenate(found, axis=1).tolist()

    whole = all_of()
    monkeypatch.setattr(suffix_dedup, "_SECTION", 700)
    assert all_of() == whole and len(whole[0]) > 100


def in_process(texts, buckets, hot_core):
    """The stages of op7 one after the other in this process, so that hashes can be broken."""
    raw = [t.encode() for t in texts]
    rows = []
    for k in range(0, len(raw), 9):
        part = raw[k : k + 9]
        data = suffix_dedup.zstandard.ZstdCompressor().compress(b"".join(part))
        rows.append({"pack": k, "lengths": np.array([len(x) for x in part], "<i8").tobytes(), "size": sum(map(len, part)), "data": data, "told": [], "again": [], "masks": [], "whole": []})

    def by_bucket(step, run):
        made = [r for b in step(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()]
        out = []
        for b in sorted({r["bucket"] for r in made}):
            out += run(pa.Table.from_pylist([r for r in made if r["bucket"] == b])).to_pylist()
        return out

    def tell(name, found):
        for row in rows:
            row[name] = [x for x in found if x["pack"] == row["pack"]]

    tell("told", by_bucket(suffix_dedup._entry_rows(buckets, False), suffix_dedup._judge(hot_core)))
    tell("masks", by_bucket(suffix_dedup._asked(buckets, False), suffix_dedup._settle))
    if any(x["hot"] for r in rows for x in r["told"]):
        tell("again", by_bucket(suffix_dedup._entry_rows(buckets, True), suffix_dedup._judge(float("inf"))))
        tell("whole", by_bucket(suffix_dedup._asked(buckets, True), suffix_dedup._settle))
    for k, row in enumerate(rows):
        row["keys"] = list(range(9 * k, min(9 * k + 9, len(raw))))
    kinds = pa.schema([("pack", pa.int64()), ("keys", pa.list_(pa.int64())), ("lengths", pa.binary()), ("size", pa.int64()), ("data", pa.binary())])
    verdict = pa.list_(pa.struct([("bucket", pa.int32()), ("ask", pa.binary()), ("hot", pa.binary())]))
    mask = pa.list_(pa.struct([("bucket", pa.int32()), ("mask", pa.binary())]))
    for name, kind in (("told", verdict), ("again", verdict), ("masks", mask), ("whole", mask)):
        kinds = kinds.append(pa.field(name, kind))
    done = suffix_dedup._cut_texts(buckets, False)(iter([pa.RecordBatch.from_pylist(rows, schema=kinds)]))
    return [tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for b in done for r in b.to_pylist()]


@pytest.mark.parametrize("hot", [20_000, 2])
@pytest.mark.parametrize("bits", [64, 6, 0])
def test_hash_collisions_remove_nothing(monkeypatch, hot, bits):
    """With hashes of so few bits nearly all cores, regions and extensions collide; every removal rests on bytes."""
    texts = [t or "" for t in repeat_texts()]
    few = np.uint64((1 << bits) - 1)
    whole_hash, whole_mix = suffix_dedup.PrefixHash.of, suffix_dedup.mixed
    monkeypatch.setattr(suffix_dedup, "mixed", lambda h: whole_mix(h) & few)
    monkeypatch.setattr(suffix_dedup.PrefixHash, "of", lambda self, a, b: whole_hash(self, a, b) & few)
    assert in_process(texts, 3, hot) == brute_repeats([t.encode() for t in texts])


# pipeline


def test_pipeline(spark, odd, empty):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    good = [words(rng, 120) + " the of and to in" * 3 for _ in range(12)]
    w = good[0].split()
    w[60] = "changed"
    passage = " ".join(words(rng, 60).split())
    texts = [*good, good[1], good[2].upper().lower(), " ".join(w), "short", "*** " * 80, good[3][:300] + passage + good[4][300:500] + " the of and", good[5][:200] + passage + good[6][200:400] + " the of in"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = docs
    sizes = []
    for _, stage in pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, out, "").collect(), docs.schema)
        assert out.columns == docs.columns
        sizes.append(out.count())
    assert sizes[0] == len(texts) - 2 and sizes[1] == sizes[0] - 2 and sizes[2] == sizes[1] - 1 and sizes[3] == sizes[2]
    kept = {r.doc_id: r.text for r in out.collect()}
    assert passage not in kept[17] and passage not in kept[18] and kept[7] == good[7]
    packed = pipeline.STAGES[-1][1](spark, out, "")
    assert packed.select("doc_id").distinct().count() == sizes[3]
    for _, stage in pipeline.STAGES:
        stage(spark, odd, "").count()
        assert stage(spark, empty, "").count() == 0


def test_pipeline_against_brute_force(spark):
    """Each stage on all that its predecessor kept of the smallest documents."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from strandline.llm import quality_rules
    from tests.llm.test_small_operators import brute_quality

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stages = dict(pipeline.STAGES)

    def after(name, rows):
        return [r.asDict() for r in stages[name](spark, spark.createDataFrame(rows, docs.schema), "").collect()]

    rows = [r.asDict() for r in docs.collect()]
    kept = after("quality_rules", rows)
    ids = {r["doc_id"] for r in kept}
    for r in rows:
        n, _, _, _, again = brute_quality(r["text"])
        assert r["doc_id"] not in ids or (n >= 50 and 100 * again <= 50 * n)
    verdicts = {r.doc_id: r.kept for r in quality_rules.apply(docs).collect()}
    assert ids == {i for i, k in verdicts.items() if k}

    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    rows, best = kept, {}
    for r in rows:
        best[lower(r["text"])] = max(r["doc_id"], best.get(lower(r["text"]), -1))
    kept = after("exact_dedup", rows)
    assert {r["doc_id"] for r in kept} == set(best.values()) and len(kept) == len(best)

    rows = sorted(kept, key=lambda r: r["doc_id"])
    sets = {r["doc_id"]: set(simhash.shingle_hashes((r["text"] or "").encode(), 5)) for r in rows}
    want: list[int] = []
    for r in rows:
        own = sets[r["doc_id"]]
        if not any(len(own & sets[i]) >= 0.8 * len(own | sets[i]) for i in want):
            want.append(r["doc_id"])
    kept = after("near_dedup", rows)
    assert sorted(r["doc_id"] for r in kept) == want and len(want) < len(rows)

    rows = kept
    kept = after("suffix_dedup", rows)
    told = brute_repeats([(r["text"] or "").encode() for r in rows])
    assert sum(t[1] for t in told) > 0
    got = {r["doc_id"]: r for r in kept}
    for r, (_, removed, _, digest) in zip(rows, told, strict=True):
        left = got[r["doc_id"]]["text"]
        assert removed or left == (r["text"] or "")
        assert got[r["doc_id"]]["n_chars"] == len(left)
        if (r["text"] or "").isascii():
            assert hashlib.sha256(left.encode()).hexdigest() == digest

    packed = stages["packing"](spark, spark.createDataFrame(kept, docs.schema), "").collect()
    from tokenizers import Tokenizer

    import public_tokenizers

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = collections.Counter()
    for p in packed:
        lengths[p.doc_id] += p.length
    assert lengths == {r["doc_id"]: len(slow.encode(r["text"], add_special_tokens=False).ids) + 1 for r in kept}


def test_n_chars_follow(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(1, "x" * 300, "en", None, 300), (2, "abc", None, "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.repeats(spark, docs, "").collect()}
    assert got == {1: ("", 0), 2: ("abc", 3)}
    assert F is not None


def test_near_copies_settle_in_few_turns(spark, monkeypatch):
    """The turns of a component of near copies do not grow with its blocks, whose size stays bounded."""
    rng = random.Random(41)
    base = words(rng, 300).split()
    rows = []
    for i in range(600):
        w = list(base)
        w[rng.randrange(300)] = f"q{i}"
        rows.append((i, " ".join(w)))
    turns, loads, real = [], [], simhash._blocks

    def counted(crowd, *options):
        out = real(crowd, *options)
        turns.append(out.count())
        loads.append(out.groupBy("first", "block").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(simhash, "_blocks", counted)
    monkeypatch.setattr(simhash, "MOST_LOAD", 4)
    kept = simhash.survivors(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block_rows=5)
    assert kept.count() == 1
    assert len(turns) <= 3 and turns[0] > 500 and turns[1:] == sorted(turns[1:], reverse=True) and max(loads) <= 60
