"""The driver's queries for this subpackage and the SQL they are held against."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import (
    bpe, cotraining, exact_dedup, mixing, mixture_lid, packing, periodic, quality_rules, search, simhash, suffix_dedup, url_filter, warc,
)
from strandline.llm.common import SPACE_CLASS, table

Query = Callable[[SparkSession, str], DataFrame]


def op2_mixture_lid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_lid.train_and_predict(table(spark, sf_dir, "documents"))


def list_history(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts, parent domains, paths and some addresses of ``pages``, by the first page of each."""
    rules = F.explode(url_filter.rules_of(F.col("url")))
    first = pages.where(F.col("url").isNotNull()).select("page_id", rules.alias("rule")).groupBy("rule").agg(F.min("page_id").alias("p"))
    some = first.where((F.col("p") % 3 != 2) & (~F.col("rule").startswith("url:") | (F.col("p") % 5 == 0)))
    start = F.to_date(F.lit("2024-01-01"))
    day = lambda shift: F.date_add(start, ((F.col("p") * 7) % 300 + shift).cast("int"))
    dated = F.explode(
        F.array(
            F.struct(F.lit("add").alias("action"), day(0).alias("day")),
            F.struct(F.lit("remove").alias("action"), day(45).alias("day")),
            F.struct(F.lit("add").alias("action"), day(90).alias("day")),
        )
    )
    return some.select("rule", dated.alias("e")).select("rule", "e.action", "e.day")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") % 365).cast("int"))
    out = url_filter.judge(pages.select("page_id", "url", day.alias("day")), list_history(pages))
    return out.withColumn("day", F.col("day").cast("string"))


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.packed(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.decide(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply(table(spark, sf_dir, "documents")).drop("n_lines", "n_stop_words")


def _token_digests(_: str, ids: np.ndarray, enc) -> tuple:
    raw = bpe.decode(ids, enc)
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return bpe.with_tokens(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, _token_digests, columns)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the contract's repeats: in one text of ten, by its id's CRC-32, the words from some word on repeat."""
    words = F.filter(F.split("text", f"{SPACE_CLASS}+"), lambda w: w != "")
    some = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    some = some.select("doc_id", "text", F.when(F.col("h") % 10 == 0, words).alias("w"), F.expr("h div 10").alias("g"))
    some = some.withColumn("n", F.when(F.size("w") > 0, F.size("w"))).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    some = some.withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    again = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda i: F.element_at("w", F.col("a") + i % F.col("p") + 1))
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")
    return some.select("doc_id", F.when(F.col("n").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    out = found.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("b"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return out.select(
        "doc_id", "n_words", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"),
        F.expr("(1000 * b.length) div (-b.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build(table(spark, sf_dir, "documents"))
    return search.search(index, table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {
        "op1_cotraining": op1_cotraining,
        "op3_url_filter": op3_url_filter,
        "op2_mixture_lid": op2_mixture_lid,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_warc": op5_warc,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_quality_rules": op9_quality_rules,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_mixing": op12_mixing,
        "op13_lexical_search": op13_lexical_search,
    }


_OP3 = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS day,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS steps
  FROM pages
), labels AS (
  SELECT *, string_split(host, '.') AS parts FROM p WHERE url IS NOT NULL
), keys AS (
  SELECT page_id, url, day, 'url:' || url AS rule FROM labels
  UNION SELECT page_id, url, day, 'host:' || host FROM labels WHERE host <> ''
  UNION SELECT page_id, url, day, 'domain:' || array_to_string(parts[i:], '.')
  FROM (SELECT *, unnest(range(1, greatest(len(parts) - 1, 1) + 1)) AS i FROM labels WHERE host <> '')
  UNION SELECT page_id, url, day, 'path:' || host || '/' || array_to_string(steps[1:i], '/')
  FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS i FROM labels WHERE host <> '')
), f AS (
  SELECT rule, min(page_id) AS p FROM keys GROUP BY rule
), s AS (
  SELECT rule, DATE '2024-01-01' + CAST((p * 7) % 300 AS INTEGER) AS d FROM f WHERE p % 3 <> 2 AND (rule NOT LIKE 'url:%' OR p % 5 = 0)
), iv AS (
  SELECT rule, d AS since, d + 45 AS until FROM s UNION ALL SELECT rule, d + 90, NULL FROM s
), hit AS (
  SELECT url, day, count(DISTINCT keys.rule) AS n, string_agg(DISTINCT keys.rule, ',' ORDER BY keys.rule) AS rules
  FROM keys JOIN iv ON keys.rule = iv.rule AND since <= day AND (until IS NULL OR day < until) GROUP BY url, day
)
SELECT p.page_id, p.url, CAST(p.day AS VARCHAR) AS day, coalesce(n, 0) AS n_rules, coalesce(rules, '') AS rules, n IS NOT NULL AS blocked
FROM p LEFT JOIN hit ON p.url = hit.url AND p.day = hit.day
"""

_OP5 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), t AS (
  SELECT h, max(page_id) AS top FROM p WHERE octet_length(encode(h)) >= 1000 GROUP BY h
)
SELECT p.page_id, octet_length(encode(p.h))::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN top IS NOT NULL AND top <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> p.page_id THEN top END AS refers_to
FROM p LEFT JOIN t ON p.h = t.h
"""

_OP6 = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

_STOPS = ", ".join(f"'{w}'" for w in sorted({w for ws in quality_rules.STOP_WORDS.values() for w in ws.split()}))

_OP9 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM hit) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT
           AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
         len(list_filter(w, lambda x: x IN ({_STOPS}))) AS n_stop
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words
        AND word_chars / n_words BETWEEN 2.0 AND 16.0 AND n_symbols / n_words <= 0.10
        AND n_stop / n_words >= 0.01 AND n_dup_lines / n_lines <= 0.50) AS kept
FROM m
"""


_OP12 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS words, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM d GROUP BY source
), t AS (
  SELECT *, row_number() OVER (ORDER BY words / weight, source NULLS LAST) AS i FROM s
), p AS (
  SELECT *, 1.5::DOUBLE * (sum(words) OVER ())::DOUBLE - 2 * (coalesce(sum(words) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING), 0) - words)::DOUBLE AS remains,
         sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS parts FROM t
), level AS (
  SELECT remains, parts FROM p WHERE weight * remains / parts <= 2 * words ORDER BY i LIMIT 1
), g AS (
  SELECT source, words, least(2 * words, weight * level.remains / level.parts) AS target,
         ('0x' || substr(md5('0' || CASE WHEN source IS NULL THEN '-' ELSE '+' END || coalesce(source, '')), 1, 15))::BIGINT % greatest(words, 1) AS shift
  FROM p, level
), r AS (
  SELECT doc_id, d.source, size, words, target, shift,
         row_number() OVER (PARTITION BY d.source ORDER BY size DESC, md5(doc_id::VARCHAR)) - 1 AS k
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), c AS (
  SELECT *, CASE WHEN words > 0 THEN (((k + 1)::HUGEINT * floor(target)::HUGEINT + shift) // words - (k::HUGEINT * floor(target)::HUGEINT + shift) // words)::BIGINT ELSE 0 END AS copies
  FROM r
)
SELECT doc_id, size, words AS source_size, target, copies, copies * size AS taken FROM c
"""

_OP13 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), n AS (
  SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0
), q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY item_id, term
), o AS (
  SELECT doc_id, term, length, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term, length
), f AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM o, n GROUP BY term, docs
), p AS (
  SELECT doc_id, o.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * length * docs) // words))) AS part FROM o JOIN f ON o.term = f.term, n
), s AS (
  SELECT item_id, doc_id, sum(times * part)::BIGINT AS score FROM q JOIN p ON q.term = p.term GROUP BY item_id, doc_id
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": _OP3, "op5_warc": _OP5, "op6_exact_dedup": _OP6, "op9_quality_rules": _OP9,
        "op12_mixing": _OP12, "op13_lexical_search": _OP13,
    }
