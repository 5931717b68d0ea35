"""The registered queries on the smallest tables, against their SQL or brute force."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from strandline.llm import packing, queries
from tests.llm.test_dedup_and_pipeline import brute_components, brute_fingerprint, brute_repeats
from tests.llm.test_small_operators import brute_quality

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def cells(rows):
    return collections.Counter(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert cells(df.select(*columns).collect()) == cells(want)


def test_url_rules_of_odd_addresses(spark, tmp_path):
    """The SQL and the query agree on addresses without a host, with empty steps, and on repeated ones."""
    urls = ["http://a.b.c.com//x//y/z?q", "nothing", "http://", None, "http://a.b.c.com//x//y/z?q", "HTTP://User@A.B.C.com:8/x", "//x", "http://localhost/", "", "http://c.com/x/y"]
    rows = [(i * 31, u, "h") for i, u in enumerate(urls * 4)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = QUERIES["op3_url_filter"](spark, str(tmp_path))
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({SQL['op3_url_filter']})").fetchall()
    got = df.select(*columns).collect()
    assert cells(got) == cells(want)
    assert {rule.split(":")[0] for r in got for rule in r.rules.split(",") if rule} == {"domain", "host", "path", "url"}
    assert any(not r.rules for r in got)


def test_op1(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op1_cotraining"](spark, SF).collect()}
    assert len(got) == len(documents)
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    assert sum(got[i].kept == bool(y) for i, y in labels.items()) >= 0.9 * len(labels)


def test_op2(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op2_mixture_lid"](spark, SF).collect()}
    assert len(got) == len(documents)
    held = [d for d in documents if zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == {d["doc_id"] for d in held}
    known = [d for d in held if d["lang"] and d["text"] and any(c.isalpha() for c in d["text"])]
    assert sum(got[d["doc_id"]].lang_pred == d["lang"] for d in known) >= 0.95 * len(known)
    assert all((r.lang_pred == "und") == (r.score == 0) and 0 <= r.score <= 1 for r in got.values())


def test_op4(spark, documents):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op4_best_fit_packing"](spark, SF).collect()
    want = set()
    for d in documents:
        ids = np.array([*slow.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want |= {(d["doc_id"], k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids)))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    at = collections.defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for spans in at.values():
        spans.sort()
        assert [s for s, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 1024
    assert len(at) <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1


def test_op7(spark, documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op7_suffix_dedup"](spark, SF).collect()}
    assert got == dict(zip((d["doc_id"] for d in documents), brute_repeats([(d["text"] or "").encode() for d in documents]), strict=True))


def test_op8(spark, documents):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op8_simhash_near_dedup"](spark, SF).collect()}
    fps = [brute_fingerprint(d["text"], 3) for d in documents]
    groups = brute_components(fps, 3)
    low = {}
    for g, d in zip(groups, documents, strict=True):
        low[g] = min(low.get(g, d["doc_id"]), d["doc_id"])
    assert got == {d["doc_id"]: (f"{f:016x}", low[g]) for d, f, g in zip(documents, fps, groups, strict=True)}


def test_op9(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op9_quality_rules"](spark, SF).collect()}
    for d in documents:
        r = got[d["doc_id"]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(d["text"])


def test_op10(spark, documents):
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op10_byte_bpe"](spark, SF).collect()}
    for d in documents:
        ids = np.array(enc.encode_ordinary(d["text"] or ""), "<u4")
        assert got[d["doc_id"]] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest())
