"""Quality rules, exact dedup, tokens, packing, language, classifier, lists and archives on small and odd tables."""

import collections
import datetime as dt
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandline.llm import bpe, cotraining, exact_dedup, mixture_lid, packing, quality_rules, url_filter, warc
from tests.llm.conftest import SCHEMA, odd_rows, words

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


# quality rules


def brute_quality(text):
    t = text or ""
    w = SPACE.findall(t)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd, empty):
    got = quality_rules.apply(odd, keep=("text",)).collect()
    assert len(got) == odd.count()
    for r in got:
        want = brute_quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    assert quality_rules.apply(empty).count() == 0


def test_quality_windows_with_equal_hashes(spark, monkeypatch):
    """The slow path for windows that share a hash gives the same counts."""
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(0).cast("long") + F.length(c[0]) * 0)
    rng = random.Random(3)
    texts = [words(rng, n, "ab") for n in (0, 2, 3, 4, 30, 200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.n_repeat_words for r in quality_rules.measures(df, keep=("text",)).collect()}
    assert got == {t: brute_quality(t)[4] for t in texts}


def test_quality_filter_keeps_columns(odd):
    kept = quality_rules.passing(odd)
    assert kept.columns == odd.columns and kept.count() <= odd.count()


# exact dedup


def test_perfect_hash():
    rng = np.random.default_rng(0)
    d = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    mph = exact_dedup.PerfectHash.load(exact_dedup.PerfectHash.build(d).dump())
    assert sorted(mph.slots(d).tolist()) == list(range(5000))
    stranger = rng.integers(0, 256, (2000, 32), dtype=np.uint8)
    assert (mph.slots(stranger) < 5000).all()
    assert len(exact_dedup.PerfectHash.build(d[:0]).slots(d)) == 5000


@pytest.mark.parametrize("history", ["default", "all", "none"])
def test_exact_dedup(spark, odd, history):
    is_history = {"default": None, "all": F.lit(True), "none": F.lit(False)}[history]
    got = exact_dedup.decide(odd, is_history).collect()
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = collections.defaultdict(list)
    for r in odd_rows():
        groups[hashlib.sha256(lower(r[1]).encode()).hexdigest()].append(r[0])
    assert len(got) == len(odd_rows())
    assert collections.Counter((r.text_sha256, r.doc_id) for r in got) == collections.Counter((k, i) for k, v in groups.items() for i in v)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == collections.Counter(dict.fromkeys(groups, 1))
    if history == "all":
        assert all(r.known for r in got)
    kept = exact_dedup.survivors(odd, is_history)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.kept)


def test_exact_dedup_of_rows_with_maps(spark):
    docs = spark.sql("SELECT id DIV 2 AS doc_id, 'Same' AS text, map('a', id) AS m FROM range(4)")
    assert [(r.doc_id, r.m) for r in exact_dedup.survivors(docs).collect()] == [(1, {"a": 3})]


def test_exact_dedup_empty(empty):
    assert exact_dedup.decide(empty).count() == 0 and exact_dedup.survivors(empty).count() == 0


# tokens


HARD = ["", "a" * 50_000, " " * 3000 + "x", "don't we'll\n\n  x  ", "ab12 é ü !  ??", "日本語" * 500, "🙂 x́ y", "x\x1cy \x85z", "<|endoftext|> a", "\r\n \t\x0b"]


def test_split_is_safe():
    rng = random.Random(2)
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for t in [*HARD, *("".join(rng.choice(" \n\t.,ab1é'st ") for _ in range(400)) for _ in range(30))]:
        for n in (1, 7, 50):
            for pattern in ("", public_tokenizers.PATTERN):
                parts = bpe.split_safely(t, n, pattern)
                assert "".join(parts) == t
                assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)
    assert bpe.LETTERS == public_tokenizers.PATTERN
    assert max(map(len, bpe.split_safely("ab1.9," * 5000, 100, bpe.LETTERS))) <= 110


def test_bpe_round_trip(spark, odd, empty):
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string"))
    tokens = bpe.encoded(docs, RANKS, public_tokenizers.PATTERN)
    back = sorted(bytes(r.bytes) for r in bpe.decoded(tokens, RANKS, public_tokenizers.PATTERN).collect())
    assert back == sorted((r.text or "").encode() for r in docs.collect())
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    some = {r.doc_id: r.ids for r in tokens.where("doc_id >= 100").collect()}
    assert some == {100 + i: enc.encode_ordinary(t) for i, t in enumerate(HARD)}
    assert bpe.encoded(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# packing


def test_packing_tokens_are_those_of_the_file():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(JSON), packing.tokens_of(JSON, public_tokenizers.PATTERN)
    for t in [*HARD, *(words(random.Random(i), 300) for i in range(5))]:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_other_token_files_go_to_tokenizers(tmp_path):
    import json

    spec = json.load(open(JSON, encoding="utf-8"))
    assert packing._is_plain(spec, public_tokenizers.PATTERN) and not packing._is_plain(spec, r"\S+|\s+")
    spec["model"]["merges"][10], spec["model"]["merges"][11] = spec["model"]["merges"][11], spec["model"]["merges"][10]
    assert not packing._is_plain(spec, public_tokenizers.PATTERN)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    from tokenizers import Tokenizer

    own, slow = packing.tokens_of(str(tmp_path / "t.json"), public_tokenizers.PATTERN), Tokenizer.from_file(str(tmp_path / "t.json"))
    assert own.fast is None and own("hello world").tolist() == slow.encode("hello world", add_special_tokens=False).ids


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixture_lid, "MAX_LANGUAGES", 3)
    train = spark.createDataFrame([("text", f"l{i}") for i in range(5)], "text string, lang string")
    with pytest.raises(ValueError, match="more than 3 languages"):
        mixture_lid.fit(train)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 1025, 2000) if seed % 2 else np.minimum(1024, rng.geometric(0.004, 3000))
    histogram = dict(collections.Counter(lengths.tolist()))
    planned = packing.plan(histogram)
    used = collections.Counter()
    for p, n in planned:
        assert sum(p) <= 1024 and n > 0
        for x in p:
            used[x] += n
    assert used == histogram
    # no plan can do with fewer than the tokens need, nor than there are lengths over half a sequence
    least = max(-(-sum(k * v for k, v in histogram.items()) // 1024), sum(v for k, v in histogram.items() if k > 512))
    assert sum(n for _, n in planned) <= 1.02 * least + 2
    assert packing.plan({1: 1}) and packing.plan({}) == []


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    rows = packing.packed(odd, JSON, public_tokenizers.PATTERN, with_ids=True).collect()
    at = collections.defaultdict(list)
    for r in rows:
        assert r.ids is not None and len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        at[r.sequence_id].append((r.offset, r.length))
    for spans in at.values():
        spans.sort()
        end = 0
        for s, n in spans:
            assert s == end
            end += n
        assert end <= 1024
    slow = Tokenizer.from_file(JSON)
    want = collections.Counter(tuple([*slow.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in odd_rows() if len(r[1] or "") < 5000)
    whole = collections.Counter(tuple(r.ids) for r in rows if r.piece == 0 and r.length < 1024)
    assert all(whole[k] >= n for k, n in want.items() if len(k) < 1024)
    assert packing.packed(empty, JSON, public_tokenizers.PATTERN).count() == 0
    assert packing.cut(2048) == [(0, 1024), (1024, 1024)] and packing.cut(1500) == [(0, 476), (476, 1024)] and packing.cut(1) == [(0, 1)]


# language


def test_language(spark, odd, empty):
    rng = random.Random(4)
    train = spark.createDataFrame([(i, words(rng, 80, "abcd" if i % 2 else "wxyz"), "ab" if i % 2 else "yz", None, None) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    model = mixture_lid.fit(train)
    assert model.languages == ("ab", "yz")
    a, b = words(rng, 60, "abcd"), words(rng, 60, "wxyz")
    lang, score, mixture = mixture_lid.identify([a, b, a + " " + b + " " + b, "", "12 !?", "日"], model)
    assert lang[:3] == ["ab", "yz", "yz"] and lang[3:5] == ["und", "und"] and lang[5] in model.languages
    assert score[0] > 0.95 and 0.55 < score[2] < 0.8 and score[3] == 0 and "ab:" in mixture[2]
    got = mixture_lid.train_and_predict(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got} <= {"en", "de", "und"}
    assert mixture_lid.train_and_predict(empty).count() == 0
    alone = mixture_lid.predict(train, mixture_lid.fit(empty)).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in alone] == ["und"]


def test_six_languages_in_one_text(spark):
    rng = random.Random(14)
    letters = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]
    train = spark.createDataFrame([(words(rng, 80, x), x) for x in letters for _ in range(10)], "text string, lang string")
    model = mixture_lid.fit(train)
    texts = [" ".join(words(rng, 50, x) for x in letters[:k]) for k in range(1, 7)]
    _, score, mixture = mixture_lid.identify(texts, model)
    for k in range(1, 7):
        assert {x.split(":")[0] for x in mixture[k - 1].split(",")} == set(letters[:k])
        assert score[k - 1] == pytest.approx(1 / k, abs=0.02)


def test_a_documents_mixture_does_not_depend_on_its_neighbours():
    rng = np.random.default_rng(3)
    fast = np.tile(np.float32([1, 1e-6, 1e-6]), (40, 1))
    slow = [np.float32(rng.uniform(0.3, 1, (n, 3))) for n in (30, 90, 200)]
    docs = [fast, slow[0], fast[:7], slow[1], slow[2], np.concatenate([fast, slow[0], fast[:, ::-1]])]
    counts = np.array([len(d) for d in docs])
    starts = np.cumsum(counts) - counts
    every = np.ones((len(docs), 3), np.float32)
    share, likelihood = mixture_lid._em(np.concatenate(docs), starts, counts, every)
    for i, d in enumerate(docs):
        alone, of = mixture_lid._em(d, np.array([0]), counts[i : i + 1], every[:1])
        assert np.array_equal(alone[0], share[i]) and of[0] == likelihood[i]


def test_language_of_long_texts():
    rng = random.Random(9)
    model = mixture_lid.Model(("a", "b"), np.log(np.full((mixture_lid.BINS, 2), 0.5, np.float32)))
    lang, _, _ = mixture_lid.identify([words(rng, 400_000), "x"], model)
    assert lang == ["a", "a"]


# classifier


def test_cotraining(spark, odd, empty):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        good = i % 3 != 0
        text = words(rng, 90) + " the of and to in a is" * 4 if good else " ".join(w.upper() + "!!" for w in words(rng, 90).split())
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(150)] + [(0, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = cotraining.classify(docs, labels, rounds=1).collect()
    assert len(got) == 300 and sum(r.kept == (r.doc_id % 3 != 0) for r in got if r.doc_id >= 150) >= 147
    assert all(0 <= r.score <= 1 for r in got)
    assert cotraining.classify(odd, labels, rounds=1).count() == odd.count()
    assert cotraining.classify(empty, labels).count() == 0
    none = cotraining.classify(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}


def test_cotraining_learns_words_from_the_other_view(spark):
    """No label has the words of the last documents; their sources tell the metadata view, which teaches the text view."""
    rng = random.Random(16)
    known, strange = {1: "abcd", 0: "efgh"}, {1: "ijkl", 0: "mnop"}
    rows = [(i, words(rng, 60, known[i % 2]), "en", f"s{i % 2}") for i in range(300)]
    rows += [(1000 + i, words(rng, 60, strange[i % 2]), "en", f"s{i % 2}") for i in range(300)]
    rows += [(2000 + i, words(rng, 60, strange[i % 2]), "en", None) for i in range(100)]  # no source: only words tell
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    right = {}
    for rounds in (0, 2):
        got = {r.doc_id: r for r in cotraining.classify(docs, labels, rounds=rounds).collect()}
        right[rounds] = sum((got[2000 + i].text_score >= 0.5) == (i % 2 == 1) for i in range(100))
    assert right[0] < 75 and right[2] >= 98


def test_pseudo_labels_weigh_no_more_than_labels():
    labels, pseudo = np.array([4.0]), np.array([1000.0])
    assert cotraining._weighed(labels, pseudo, 10, 10)[0] == 254
    assert cotraining._weighed(labels, pseudo, 10, 10_000)[0] == 5
    assert cotraining._weighed(labels, pseudo * 0, 10, 0)[0] == 4


# lists


def test_url_rules(spark):
    df = spark.createDataFrame([("http://u@A.b.Example.com:80/x/y/?q=1#z",), ("https://h.com",), ("nonsense",)], "url string")
    got = [set(r.r) for r in df.select(url_filter.rules_of(F.col("url")).alias("r")).collect()]
    assert {"host:a.b.example.com", "domain:example.com", "domain:b.example.com", "path:a.b.example.com/x", "path:a.b.example.com/x/y"} <= got[0]
    assert "host:h.com" in got[1] and got[2] == {"url:nonsense"}


def test_temporal_join(spark, pages):
    rng = random.Random(8)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    hosts = ["a.com", "b.com", "c.d.com"]
    entries = [(f"host:{rng.choice(hosts)}", rng.choice(["add", "remove"]), day(rng.randint(0, 400))) for _ in range(60)]
    entries += [("domain:d.com", "add", day(100)), ("domain:d.com", "remove", day(100)), (None, "add", day(1)), ("host:a.com", "add", None), ("domain:d.com", "add", day(200))]
    captures = [(i, f"http://{rng.choice(hosts)}/p{i % 3}", day(rng.randint(-20, 450))) for i in range(200)]
    captures += [captures[0], (None, None, day(3)), (7, "http://a.com/", None)]
    e = spark.createDataFrame(entries, "rule string, action string, day date")
    c = spark.createDataFrame(captures, "page_id long, url string, day date")
    got = collections.Counter((r.page_id, r.url, r.day, r.rules, r.n_rules, r.blocked) for r in url_filter.judge(c, e).collect())

    def active(rule, at):
        state = {}
        for r, a, d in entries:
            if r == rule and d is not None and d <= at:
                state.setdefault(d, []).append(a)
        return bool(state) and "remove" not in state[max(state)]

    def want(p, u, d):
        if u is None or d is None:
            return (p, u, d, "", 0, False)
        host = u.split("/")[2]
        rules = [r for r in sorted({f"host:{host}", *(["domain:d.com"] if host.endswith("d.com") else [])}) if active(r, d)]
        return (p, u, d, ",".join(sorted(rules)), len(rules), bool(rules))

    assert got == collections.Counter(want(*x) for x in captures)
    assert url_filter.judge(c, e.where("false")).where("blocked").count() == 0
    assert url_filter.judge(c.where("false"), e).count() == 0


# archives


def test_warc(spark, pages, tmp_path):
    folder = "file://" + str(tmp_path / "w")
    manifest = warc.write(pages, folder, roll_bytes=1500)
    got = warc.read(spark, folder)
    rows = pages.collect()
    top = {}
    for r in rows:
        h = (r.html or "").encode()
        if len(h) >= 1000:
            top[h] = max((x for x in (top.get(h), r.page_id) if x is not None), default=None)
    want = collections.Counter()
    for r in rows:
        h = (r.html or "").encode()
        again = top.get(h) is not None and top[h] != r.page_id
        want[(r.page_id, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", top[h] if again else None)] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == want
    names = sorted(p.name for p in (tmp_path / "w").glob("*.gz"))
    assert names == sorted(r.name for r in manifest.collect())
    for r in manifest.collect():
        assert hashlib.sha1((tmp_path / "w" / r.name).read_bytes()).hexdigest() == r.sha1
    warc.write(pages.repartition(7), "file://" + str(tmp_path / "again"), roll_bytes=1500)
    assert {p.name: p.read_bytes() for p in (tmp_path / "again").glob("*.gz")} == {n: (tmp_path / "w" / n).read_bytes() for n in names}


def test_warc_shards_follow_the_bytes_alone(spark, tmp_path):
    """An outlying id does not crowd the rest into one shard, and the session's settings do not change a file."""
    rng = random.Random(15)
    rows = [(i, f"http://a/{i}", words(rng, 40)) for i in range(400)] + [(1 << 60, "http://far/", "far")] + [(7, "http://same/", words(rng, 400)) for _ in range(6)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = []
    for n in ("4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        folder = tmp_path / n
        made = warc.write(docs.repartition(int(n)), f"file://{folder}", shard_bytes=40_000).collect()
        files.append({p.name: p.read_bytes() for p in folder.glob("*.gz")})
        assert len({r.shard for r in made}) > 5 and max(r.records for r in made) < 120
        assert warc.read(spark, f"file://{folder}").count() == len(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert files[0] == files[1]
    assert warc.shard_count(0) == 1 and warc.shard_count(1 << 47) == warc.MAX_SHARDS


def test_warc_empty_and_damaged(spark, pages, tmp_path):
    assert warc.round_trip(pages.where("false"), "file://" + str(tmp_path / "e")).count() == 0
    record = warc.page_record(1, 0, "http://a/", b"x", "response", None, "2024-01-01T00:00:00Z")
    warc.parse(record)
    with pytest.raises(ValueError):
        warc.parse(record.replace(b"x\r\n\r\n", b"y\r\n\r\n"))


def test_fixture_columns_clash():
    assert {"kept", "digest", "fp", "length", "score"} <= set(re.findall(r"(\w+) \w+", SCHEMA))


def test_cotraining_sums_in_a_tree(spark, monkeypatch):
    """More tasks than may meet in one group: the same sums, and no group holds more than its share of them."""
    monkeypatch.setattr(cotraining, "MEET", 3)
    df = spark.range(1000).selectExpr("id AS x").repartition(10)
    gather = lambda batch: np.bincount(batch.column(0).to_numpy() % 2500, minlength=2500).astype(float)
    assert df.rdd.getNumPartitions() > 3
    assert cotraining._summed(df, 2500, gather).tolist() == [1.0] * 1000 + [0.0] * 1500


def test_exact_dedup_with_a_null_mark(spark):
    """A null mark is no history, and its row has its result like every other."""
    rows = [(1, "a"), (2, "a"), (None, "a"), (None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.decide(df, F.col("doc_id") == 1).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == [("1", "2", 3, False), ("2", "2", 3, True), ("None", "2", 3, False), ("None", "None", 1, True)]
    assert sorted(str(r.doc_id) for r in exact_dedup.survivors(df, F.col("doc_id") == 1).collect()) == ["2", "None"]


def brute_mixture(words_p):
    """One document, word by word in plain loops: the languages in order of the full mixture, then sets of one, two, ... of them."""

    def em(active):
        share = [1 / len(active) if k in active else 0.0 for k in range(len(words_p[0]))]
        for _ in range(mixture_lid.ROUNDS):
            new = [0.0] * len(share)
            for p in words_p:
                part = [a * b for a, b in zip(p, share, strict=True)]
                for k, x in enumerate(part):
                    new[k] += x / sum(part) / len(words_p)
            moved = max(abs(a - b) for a, b in zip(new, share, strict=True))
            share = new
            if moved < 1e-3:
                break
        return share, sum(math.log(sum(a * b for a, b in zip(p, share, strict=True))) for p in words_p)

    full, _ = em(range(len(words_p[0])))
    order = sorted(range(len(full)), key=lambda k: -full[k])
    fits = []
    for k in range(1, len(full) + 1):
        share, likelihood = em(order[:k])
        fits.append((likelihood - 0.5 * k * math.log(len(words_p) + 1), -k, share))
    return max(fits)[2]


def test_mixtures_against_plain_loops(spark):
    rng = random.Random(61)
    alphabets = {"x": "abcdef", "y": "defghi", "z": "klmnop"}
    train = spark.createDataFrame([(words(rng, 200, a), x) for x, a in alphabets.items() for _ in range(3)], "text string, lang string")
    model = mixture_lid.fit(train)
    texts = [words(rng, n, "".join(rng.sample(list(alphabets.values()), m))) for n in (1, 3, 20, 80) for m in (1, 2, 3)] + [" ".join(words(rng, 30, a) for a in "abcdef klmnop".split())]
    lang, score, _ = mixture_lid.identify(texts, model)
    for t, got, share in zip(texts, lang, score, strict=True):
        p, _ = model.word_likelihoods([t])
        want = brute_mixture(p.astype(float).tolist())
        assert abs(max(want) - share) < 0.01 and (sorted(want)[-1] - sorted(want)[-2] < 0.02 or model.languages[want.index(max(want))] == got)


def test_mixture_of_a_long_text_is_that_of_its_words(spark, monkeypatch):
    """Read in pieces and folded, a text has the mixture it has as a whole, and holds no more rows than different words."""
    rng = random.Random(62)
    train = spark.createDataFrame([(words(rng, 300, a), x) for x, a in (("x", "abcdef"), ("y", "efghij"))], "text string, lang string")
    model = mixture_lid.fit(train)
    some = [words(rng, 1, "abcdefghij") for _ in range(60)]
    texts = ["short abc", " ".join(rng.choice(some) for _ in range(5000)), "", words(rng, 40, "efghij")]
    want = mixture_lid.identify(texts, model)
    monkeypatch.setattr(mixture_lid, "_BLOCK", 300)
    monkeypatch.setattr(mixture_lid, "_FOLD", 50)
    p, times = mixture_lid._long_text(texts[1], model)
    assert len(p) <= 60 and times.sum() == 5000
    got = mixture_lid.identify(texts, model)
    assert got[0] == want[0] and np.allclose(got[1], want[1], atol=2e-3)


def brute_cotraining(docs, labels, rounds):
    """The same formulas, a document at a time in plain loops.  ``docs`` has (id, text, source, lang, part, half)."""
    C = cotraining
    sig = lambda z: 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))
    all_ = [{"x": C.text_features(t), "bins": C.grams(t).tolist(), "meta": C.meta_value(s, x), "y": labels.get(i), "part": p, "half": h} for i, t, s, x, p, h in docs]

    def taught(d, teacher):
        """(target, 0 for a label or 1 for a pseudo-label), or nothing."""
        if d["y"] is not None:
            return (d["y"], 0) if d["part"] == 0 else None
        p = sig(teacher(d)) if teacher else 0.5
        return (int(p >= 0.5), 1) if p >= C.SURE_GOOD or p <= C.SURE_BAD else None

    def weights(told):
        n = [sum(1 for _, (_, k) in told if k == j) for j in (0, 1)]
        return [1.0, min(C.PSEUDO_WEIGHT, n[0] / n[1]) if n[1] else 0.0]

    def newton(w, rows):
        for _ in range(C.STEPS):
            slope, curve = -C.RIDGE * w, C.RIDGE * np.eye(len(w))
            for x, good, n in rows:
                p = sig(float(x @ w))
                slope, curve = slope + (good - n * p) * x, curve + n * p * (1 - p) * np.outer(x, x)
            step = np.linalg.solve(curve, slope)
            step *= min(1, C.LONGEST_STEP / np.abs(step).max()) if np.abs(step).max() else 1
            w = w + step
            if np.abs(step).max() < 1e-3:
                return w

    def learn(text, teacher):
        told = [(d, t) for d in all_ if (t := taught(d, teacher))]
        share, have, every = weights(told), collections.Counter(), collections.Counter()
        for d, (y, k) in told:
            every[d["half"], y] += share[k]
            for b in d["bins"]:
                have[d["half"], y, b] += share[k]
        odds = lambda h, b: math.log((have[h, 1, b] + 1) / (every[h, 1] + 2)) - math.log((have[h, 0, b] + 1) / (every[h, 0] + 2)) if have[h, 1, b] + have[h, 0, b] else 0.0
        for d in all_:
            total, n = sum(odds(1 - d["half"], b) for b in d["bins"]), max(1, len(d["bins"]))
            d["view"] = np.array([*d["x"], max(-4, min(4, total / n)), max(-40, min(40, total / math.sqrt(n))) / 10])
        return newton(text, [(d["view"], y * share[k], share[k]) for d, (y, k) in told])

    def learn_meta(teacher):
        told = [(d, t) for d in all_ if (t := taught(d, teacher))]
        share, counts = weights(told), collections.defaultdict(lambda: [0.0, 0.0])
        for d, (y, k) in told:
            counts[d["meta"]][0] += y * share[k]
            counts[d["meta"]][1] += share[k]
        w = newton(np.zeros(C.META_DIM), [(C.meta_matrix(np.array([m]))[0], good, n) for m, (good, n) in counts.items()])
        return lambda d: float(C.meta_matrix(np.array([d["meta"]]))[0] @ w)

    text = learn(np.zeros(C.TEXT_DIM), None)
    meta = learn_meta(None)
    for _ in range(rounds):
        text = learn(text, meta)
        now = text
        meta = learn_meta(lambda d, now=now: float(d["view"] @ now))

    def calibrated(z):
        held = collections.defaultdict(lambda: [0, 0])
        for d in all_:
            if d["y"] is not None and d["part"] == 1:
                b = held[math.floor(max(-35.0, min(35.0, z(d))) / C.BIN + 0.5)]
                b[0] += d["y"]
                b[1] += 1
        w = np.array([1.0, 0.0])
        for _ in range(30):
            slope, curve = -np.array([w[0] - 1, 0.01 * w[1]]), np.diag([1.0, 0.01])
            for b, (good, n) in held.items():
                x = np.array([b * C.BIN, 1.0])
                p = sig(float(x @ w))
                slope, curve = slope + (good - n * p) * x, curve + n * p * (1 - p) * np.outer(x, x)
            w = w + np.clip(np.linalg.solve(curve, slope), -2, 2)
        return lambda d: max(0.0, w[0]) * z(d) + w[1]

    views = [calibrated(lambda d: float(d["view"] @ text)), calibrated(meta)]
    prior = math.log(sum(labels.values()) / (len(labels) - sum(labels.values())))
    plain = lambda z: 1 / (1 + math.exp(-z))
    return {doc[0]: (plain(views[0](d)), plain(views[1](d)), plain(views[0](d) + views[1](d) - prior)) for doc, d in zip(docs, all_, strict=True)}


@pytest.mark.parametrize("rounds", [0, 2])
def test_cotraining_against_plain_loops(spark, rounds):
    rng = random.Random(71)
    rows = []
    for i in range(240):
        good = rng.random() < 0.6
        text = words(rng, rng.randint(20, 60), "abcdefgh" if rng.random() < (0.8 if good else 0.2) else "efghijkl")
        rows.append((i, text if good else text.upper() + "!" * rng.randint(0, 3), "s" + str(rng.randrange(2) if rng.random() < 0.3 else int(good)), rng.choice(["en", "de", None]), int(good)))
    docs = spark.createDataFrame([(i, t, x, s) for i, t, s, x, _ in rows], "doc_id long, text string, lang string, source string").repartition(3)
    labels = {i: y for i, *_, y in rows if i < 100}
    marks = docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).cast("int").alias("p"), F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id")), F.lit(2)).alias("h"))
    mark = {r.doc_id: (r.p, r.h) for r in marks.collect()}
    want = brute_cotraining([(i, t, s, x, *mark[i]) for i, t, s, x, _ in rows], labels, rounds)
    got = {r.doc_id: r for r in cotraining.classify(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), rounds=rounds).collect()}
    assert got.keys() == want.keys()
    for i, (text, meta, both) in want.items():
        r = got[i]
        assert (r.text_score, r.meta_score, r.score) == pytest.approx((text, meta, both), abs=1e-4) and r.kept == (r.score >= 0.5)
