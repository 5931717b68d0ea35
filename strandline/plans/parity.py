"""Driver queries for functions, alignments, sources and sinks, each with its SQL.

What reads or writes files makes a round trip: a table goes out through the
writer under test into the shared folder, comes back through the reader, and the
SQL is that of the table itself.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import alignment as A
from strandline.functions import genes as G
from strandline.functions import hashing as H
from strandline.functions import scoring as S
from strandline.functions import sequence as Q
from strandline.operators import alleles, chaining, classify, coverage, fm, graph, kmers, taxonomy
from strandline.plans.catalog import _DNA, _HITS, _PEPTIDES, _REF, _kmers_sql, genes, hits, query, reads, reference, table
from strandline.sources import fastq, sinks, synthetic, tables, topics
from strandline.storage import file_system, shared_folder
from strandline.streaming import jobs, state

# scalar functions

_M64 = "18446744073709551616::UHUGEINT"


def _finalised(x: str, source: str) -> str:
    """CTEs f1 to f5: the 64-bit finaliser of column ``x`` of ``source``, in 128-bit arithmetic."""
    half = lambda n, s, c: f"{n} AS (SELECT * REPLACE (xor(x, x >> 33) AS x) FROM {s})" if c is None else f"{n} AS (SELECT * REPLACE ((xor(x, x >> 33) * {c}::UHUGEINT) % {_M64} AS x) FROM {s})"
    return f"f0 AS (SELECT *, {x} AS x FROM {source}), " + ", ".join(
        [half("f1", "f0", 18397679294719823053), half("f2", "f1", 14181476777654086739), half("f3", "f2", None)]
    )


_SIGNED = "CAST(CASE WHEN x >= 9223372036854775808::UHUGEINT THEN CAST(x AS HUGEINT) - 18446744073709551616::HUGEINT ELSE CAST(x AS HUGEINT) END AS BIGINT)"


@query("hash_finaliser", f"WITH {_finalised('CAST(o_orderkey AS UHUGEINT)', 'orders')} SELECT o_orderkey AS id, {_SIGNED} AS h FROM f3")
def hash_finaliser(spark, sf):
    """FN11."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), H.murmur_finaliser(F.col("o_orderkey")).alias("h"))


@query("hash_seeded", f"WITH {_finalised('CAST(xor(o_orderkey, o_custkey) AS UHUGEINT)', 'orders')} SELECT o_orderkey AS id, {_SIGNED} AS h FROM f3")
def hash_seeded(spark, sf):
    """FN12."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), H.murmur_seeded(F.col("o_orderkey"), F.col("o_custkey")).alias("h"))


_M32 = 4294967296
_ROT = lambda x, r: f"((({x}) << {r}) % {_M32} | (({x}) >> {32 - r}))"
_MIX = lambda k: f"{_ROT(f'({k} * {0xCC9E2D51} % {_M32})', 15)} * {0x1B873593} % {_M32}"
_BYTES = lambda at, n: "(" + " + ".join(f"(CASE WHEN {n} > {i} THEN ord(substr(t, {at} + {i}, 1)) ELSE 0 END::HUGEINT << {8 * i})" for i in range(4)) + ")"


@query(
    "hash_text",
    f"""WITH k AS (SELECT o_orderkey AS id, substr(o_orderpriority || o_orderkey, 1, CAST(o_orderkey % 8 AS INTEGER)) AS t FROM orders),
    a AS (SELECT id, t, length(t) AS n, CASE WHEN length(t) >= 4 THEN {_MIX(_BYTES("1", "4"))} ELSE 0 END AS k1, {_MIX(_BYTES("1 + 4 * (length(t) // 4)", "length(t) % 4"))} AS k2 FROM k),
    b AS (SELECT id, n, k2, CASE WHEN n >= 4 THEN ({_ROT("k1", 13)} * 5 + {0xE6546B64}) % {_M32} ELSE 0 END AS h FROM a),
    f AS (SELECT id, xor(xor(h::HUGEINT, k2::HUGEINT), n::HUGEINT) AS h FROM b),
    g AS (SELECT id, xor(h, h >> 16) * {0x85EBCA6B} % {_M32} AS h FROM f), i AS (SELECT id, xor(h, h >> 13) * {0xC2B2AE35} % {_M32} AS h FROM g)
    SELECT id, CAST(xor(h, h >> 16) AS BIGINT) AS h FROM i""",
)
def hash_text(spark, sf):
    """FN13 over texts of none to seven characters: a whole word or none, and every length of the rest."""
    text = F.substring(F.concat("o_orderpriority", F.col("o_orderkey").cast("string")), F.lit(1), (F.col("o_orderkey") % 8).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), H.murmur_text(text).alias("h"))


_JENKINS = f"""k AS (SELECT o_orderkey AS id, o_orderkey * 8191 AS key FROM orders), a AS (SELECT id, xor(key, key >> 32) % {_M32} AS h FROM k), b AS (SELECT id, (h + (h << 10)) % {_M32} AS h FROM a),
    c AS (SELECT id, xor(h, h >> 6) AS h FROM b), d AS (SELECT id, (h + (h << 3)) % {_M32} AS h FROM c), e AS (SELECT id, xor(h, h >> 11) AS h FROM d), f AS (SELECT id, (h + (h << 15)) % {_M32} AS h FROM e)"""


@query("hash_compact", f"WITH {_JENKINS} SELECT id, h, h % 2147483648 AS compact FROM f")
def hash_compact(spark, sf):
    """FN14."""
    key = F.col("o_orderkey") * 8191
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), H.jenkins(key).alias("h"), H.compact_hash(key).alias("compact"))


@query(
    "base_codes",
    f"""WITH {_REF}, c AS (SELECT item_id, unnest(string_split(seq, '')) AS b FROM ref WHERE length(seq) >= 12),
    s AS (SELECT item_id, array_to_string(list_transform(range(1, length(seq) - 10), lambda i: substr(seq, i, 2) || substr(seq, i + 3, 2) || substr(seq, i + 6, 2) || substr(seq, i + 9, 2)), ' ') AS w FROM ref WHERE length(seq) >= 12)
    SELECT c.item_id, sum(strpos('ACGT', b) - 1)::BIGINT AS codes, md5(any_value(w)) AS spaced, true AS back FROM c JOIN s ON c.item_id = s.item_id GROUP BY c.item_id""",
)
def base_codes(spark, sf):
    """FN01, FN02, FN15: codes of bases, there and back, and the spaced seed of every twelve bases."""
    r = reference(spark, sf).where(F.length("seq") >= 12)
    seeds = F.transform(F.sequence(F.lit(1), F.length("seq") - 11), lambda i: Q.spaced(F.substring(F.col("seq"), i, F.lit(12)), 2))
    each = r.select("item_id", F.md5(F.array_join(seeds, " ")).alias("spaced"), F.explode(F.split("seq", "")).alias("b"))
    code = Q.encode_base(F.col("b"))
    return each.groupBy("item_id").agg(F.sum(code).cast("long").alias("codes"), F.first("spaced").alias("spaced"), F.bool_and(Q.decode_base(code) == F.col("b")).alias("back"))


_BLOSUM = "[" + ", ".join(map(str, A.BLOSUM62.ravel().tolist())) + "]"
_AT = lambda c: f"CASE WHEN strpos('{Q.RESIDUES}', {c}) > 0 THEN strpos('{Q.RESIDUES}', {c}) - 1 ELSE {Q.RESIDUES.index('X')} END"


@query(
    "residue_scores",
    f"""WITH p AS (SELECT p_partkey AS id, chr(CAST(65 + p_partkey % 26 AS INTEGER)) AS a, chr(CAST(65 + p_size % 26 AS INTEGER)) AS b, upper(replace(p_name, ' ', ''))[1:8] AS w FROM part)
    SELECT id, CAST({_AT("a")} AS INTEGER) AS place, CAST({_BLOSUM}[({_AT("a")}) * 24 + ({_AT("b")}) + 1] AS INTEGER) AS score,
    CAST(list_sum(list_transform(range(1, length(w) + 1), lambda i: ({_AT("substr(w, i, 1)")}) * pow(31, length(w) - i)::BIGINT)) AS BIGINT) AS word FROM p""",
)
def residue_scores(spark, sf):
    """FN19, FN20, FN21: a residue's place, the score of two, and a word's polynomial hash."""
    letter = lambda c: F.chr(F.lit(65) + c % 26)
    a, b = letter(F.col("p_partkey")), letter(F.col("p_size"))
    word = F.substring(F.upper(F.regexp_replace("p_name", " ", "")), 1, 8)
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), Q.residue_index(a).cast("int").alias("place"), A.blosum62(a, b).alias("score"), H.residue_hash(word).alias("word")
    )


_FAMILIES = ["CTX-M-", "TEM-", "KPC-", "qnrB", "NDM-"]
_CTXM = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in G.CTXM_GROUPS.items()) + "}"


@query(
    "name_similarity",
    f"""WITH p AS (SELECT p_partkey AS id, p_partkey % 5 AS fa, p_partkey // 7 % 5 AS fb, CAST(p_size AS VARCHAR) AS va, CAST(p_partkey % 45 AS VARCHAR) AS vb, p_name FROM part),
    n AS (SELECT *, CASE WHEN id % 2 = 0 AND fa <> 3 THEN 'bla' ELSE '' END || {_FAMILIES}[fa + 1] || va AS a, {_FAMILIES}[fb + 1] || vb AS b, {_CTXM} AS m FROM p)
    SELECT id, a, b, CAST(CASE WHEN a = b THEN 1 WHEN fa <> fb THEN 0.05 WHEN va = vb THEN 0.95 WHEN fa = 0 THEN CASE WHEN m[va] IS NULL OR m[vb] IS NULL THEN 0.7 WHEN m[va] = m[vb] THEN 0.9 ELSE 0.6 END
      WHEN fa = 1 THEN CASE WHEN va = '1' OR vb = '1' THEN 0.8 ELSE 0.75 END WHEN fa = 3 THEN 0.8 ELSE 0.7 END AS DOUBLE) AS similarity, replace(trim(p_name), ' ', '_') AS species FROM n""",
)
def name_similarity(spark, sf):
    """FN24, FN27: names whose families and variants come from the parts."""
    family = lambda i: F.element_at(F.array(*map(F.lit, _FAMILIES)), (i + 1).cast("int"))
    k = F.col("p_partkey")
    a = F.concat(F.when((k % 2 == 0) & (k % 5 != 3), "bla").otherwise(""), family(k % 5), F.col("p_size").cast("string"))
    b = F.concat(family(F.floor(k / 7) % 5), (k % 45).cast("string"))
    t = table(spark, sf, "part").select(k.alias("id"), a.alias("a"), b.alias("b"), G.normalised_species(F.col("p_name")).alias("species"))
    return t.select("id", "a", "b", G.name_similarity(F.col("a"), F.col("b")).alias("similarity"), "species")


@query(
    "mutation_confidence",
    """SELECT l_orderkey AS read_id, l_linenumber AS n, round(greatest(0.0, coalesce(CASE WHEN 75 + l_partkey % 15 IN (83, 87) THEN 2.0 * ((l_suppkey % 9 - 4 + 4.0) / 8.0) * (1 - l_discount) * least(1.0, l_quantity / 30.0) END, 0.0)), 6) AS confidence FROM lineitem""",
)
def mutation_confidence(spark, sf):
    """FN39: weight of a mutation at a known position."""
    m = F.array(F.struct((F.lit(75) + F.col("l_partkey") % 15).cast("int").alias("pos"), (F.col("l_suppkey") % 9 - 4).cast("int").alias("blosum")))
    c = G.resistance_confidence(F.lit("gyrA"), m, 1 - F.col("l_discount"), F.col("l_quantity"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("n"), F.round(c, 6).alias("confidence"))


@query(
    "progress_records",
    """SELECT CAST(event_id AS VARCHAR) AS job_id, '{"stage":"' || event_type || '","progress":0.5,"message":"m' || user_id || '","timestamp":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '"}' AS record FROM events""",
)
def progress_records(spark, sf):
    """FN42, FN46: progress as JSON with a formatted time."""
    e = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("job_id"), F.col("event_type").alias("stage"), F.lit(0.5).alias("progress"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("message"), F.col("ts").cast("timestamp").alias("ts"),
    )
    return jobs.progress(e)


_BITS, _HASHES = S.bloom_size(100_000, 0.01)


@query(
    "bloom_sizes",
    "SELECT s_suppkey AS id, CAST(ceil(-100000 * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS bits, CAST(round(ceil(-100000 * ln(0.01) / (ln(2) * ln(2))) / 100000 * ln(2)) AS INTEGER) AS hashes, round(pow(1 - exp(-7.0 * s_suppkey * 100 / ceil(-100000 * ln(0.01) / (ln(2) * ln(2)))), 7), 8) AS rate FROM supplier",
)
def bloom_sizes(spark, sf):
    """FLT04: bits, hashes and the expected rate of false positives."""
    n = F.col("s_suppkey") * 100
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.lit(_BITS).cast("long").alias("bits"), F.lit(_HASHES).alias("hashes"), F.round(S.bloom_fpr(n, _BITS, _HASHES), 8).alias("rate")
    )


@query(
    "checked_settings",
    """WITH s AS (SELECT p_partkey AS id, 'kmer' AS name, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'window', p_size % 3 FROM part UNION ALL SELECT p_partkey, 'min_identity', p_size / 40 FROM part)
    SELECT id, name, value, CASE name WHEN 'kmer' THEN value BETWEEN 1 AND 31 WHEN 'window' THEN value >= 1 ELSE value BETWEEN 0 AND 1 END AS fine FROM s""",
)
def checked_settings(spark, sf):
    """FLT18, SRC28: settings that the configuration takes or refuses, a set of them for each part."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fine = []
            for r in batch.to_pylist():
                try:
                    tables.Config().overridden({r["name"]: r["value"] if r["name"] == "min_identity" else int(r["value"])})
                    fine.append(True)
                except ValueError:
                    fine.append(False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fine)], [*batch.schema.names, "fine"])

    setting = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"))
    sets = F.array(setting("kmer", F.col("p_size")), setting("window", F.col("p_size") % 3), setting("min_identity", F.col("p_size") / 40))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(sets).alias("s")).select("id", "s.name", "s.value")
    return rows.mapInArrow(run, "id long, name string, value double, fine boolean")


# seeds and alignments

# screens against a reference that is too large to send

_SAID = f"""docs AS (SELECT doc_id, {_DNA} AS seq FROM documents),
    said AS (SELECT 'b' || item_id AS id, {_DNA} AS seq FROM benchmark UNION ALL SELECT 'c' || conv_id || '.' || turn, {_DNA} FROM conversations)"""
_TURNED = "reverse(translate(kmer, 'ACGT', 'TGCA'))"


def _said(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items and turns of conversations as reads; all documents are their reference."""
    items = table(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text")
    turns = table(spark, sf, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("id"), "text")
    return items.unionByName(turns).select("id", Q.dna_of_long_text(F.col("text")).alias("seq"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", Q.dna_of_long_text(F.col("text")).alias("seq"))


@query(
    "bloom_screen",
    f"""WITH {_SAID}, b AS (SELECT DISTINCT kmer FROM ({_kmers_sql("docs", "doc_id", 15)})), r AS (SELECT kmer FROM b UNION SELECT {_TURNED} FROM b),
    a AS (SELECT DISTINCT id, kmer FROM ({_kmers_sql("said", "id", 15)}))
    SELECT id, count(*) AS found FROM a WHERE kmer IN (SELECT kmer FROM r) GROUP BY id HAVING count(*) >= 3""",
)
def bloom_screen(spark, sf):
    """FLT01, FLT02: reads with three 15-mers of all documents on either strand, through a Bloom filter whatever their number."""
    return kmers.screen(_said(spark, sf), _documents(spark, sf), 15, "id", exact=0, both_strands=True)


@query(
    "bloom_matches",
    f"""WITH {_SAID}, a AS (SELECT DISTINCT id, kmer FROM ({_kmers_sql("said", "id", 20)})), b AS (SELECT DISTINCT doc_id, kmer FROM ({_kmers_sql("docs", "doc_id", 20)}))
    SELECT id, doc_id, count(*) AS shared FROM a JOIN b USING (kmer) GROUP BY ALL HAVING count(*) >= 2""",
)
def bloom_matches(spark, sf):
    """FLT01, JN01: the reads and documents that share two 20-mers, through a Bloom filter."""
    return kmers.matches(_said(spark, sf), _documents(spark, sf), 20, "id", "doc_id", least=2, exact=0)


def _minimizers_sql(source: str, key: str, k: int, w: int) -> str:
    """Distinct (key, kmer): the first in order of every full window of ``w`` k-mers, and of sequences with fewer."""
    over = f"PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING"
    each = f"SELECT {key}, pos, min(kmer) OVER ({over}) AS kmer, count(*) OVER ({over}) AS n, count(*) OVER (PARTITION BY {key}) AS all_n FROM ({_kmers_sql(source, key, k)})"
    return f"SELECT DISTINCT {key}, kmer FROM ({each}) WHERE n = {w} OR (all_n < {w} AND pos = 0)"


@query(
    "bloom_minimizers",
    f"""WITH {_SAID}, b AS (SELECT DISTINCT kmer FROM ({_minimizers_sql("docs", "doc_id", 15, 10)})), a AS ({_minimizers_sql("said", "id", 15, 10)})
    SELECT id, count(*) AS found FROM a WHERE kmer IN (SELECT kmer FROM b) GROUP BY id""",
)
def bloom_minimizers(spark, sf):
    """FLT01, FLT03: reads with any minimizer of all documents, through a Bloom filter."""
    return kmers.minimizer_screen(_said(spark, sf), _documents(spark, sf), 15, 10, "id", exact=0)


_FRAMES = _PEPTIDES + """, parts AS (SELECT item_id, CAST(frame AS INTEGER) AS frame, string_split(p, '*') AS ps FROM fr),
    st AS (SELECT item_id, frame, unnest(range(1, len(ps) + 1)) AS i, ps FROM parts), open AS (SELECT item_id AS read_id, frame, CAST(coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x) + 1)), 0) AS INTEGER) AS start, ps[i] AS peptide FROM st WHERE length(ps[i]) >= 20),
    prot AS (SELECT read_id * 1000 + start AS protein_id, peptide AS protein FROM open WHERE frame = 2),
    w AS (SELECT read_id, frame, start, CAST(i - 1 AS INTEGER) AS q, substr(peptide, i, 8) AS word FROM (SELECT *, unnest(range(1, length(peptide) - 6)) AS i FROM open)),
    v AS (SELECT protein_id, CAST(i - 1 AS INTEGER) AS t, substr(protein, i, 8) AS word FROM (SELECT *, unnest(range(1, length(protein) - 6)) AS i FROM prot)),
    seeds AS (SELECT read_id, frame, start, protein_id, q, t FROM w JOIN v USING (word))"""


def _open_frames(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    frames = Q.six_frames(reference(spark, sf), "seq", 20).withColumnRenamed("item_id", "read_id")
    proteins = frames.where("frame = 2").select((F.col("read_id") * 1000 + F.col("start")).alias("protein_id"), F.col("peptide").alias("protein"))
    return frames, proteins


@query("protein_seeds", _FRAMES + " SELECT read_id, frame, start, protein_id, count(*) AS n, min(q) AS first_q, sum(t)::BIGINT AS places FROM seeds GROUP BY ALL")
def protein_seeds(spark, sf):
    """JN02: words of eight residues that frames and proteins share."""
    s = kmers.seeds(*_open_frames(spark, sf))
    return s.groupBy("read_id", "frame", "start", "protein_id").agg(F.count("*").alias("n"), F.min("q").alias("first_q"), F.sum("t").alias("places"))


def _short(n: int) -> str:
    """The open stretches and their seeds, with words of ``n`` residues in place of eight."""
    return _FRAMES.replace("i, 8)", f"i, {n})").replace("(peptide) - 6", f"(peptide) - {n - 2}").replace("(protein) - 6", f"(protein) - {n - 2}")


_SHORT = _short(4)
_CHAINS = f"""pairs AS (SELECT read_id, frame, start, protein_id, list({{'q': CAST(q AS BIGINT), 't': CAST(t AS BIGINT), 's': 0::BIGINT}} ORDER BY q, t) AS l FROM seeds GROUP BY ALL),
    steps AS (SELECT read_id, frame, start, protein_id, list_transform(l, lambda x: [x]) AS l FROM pairs),
    run AS (SELECT read_id, frame, start, protein_id, list_reduce(l, lambda a, b: list_append(a, {{'q': b[1].q, 't': b[1].t, 's': {chaining.MATCH * 3}::BIGINT
      + greatest(0, coalesce(list_max(list_transform(list_filter(a, lambda y: y.q + 3 <= b[1].q AND y.t + 3 <= b[1].t), lambda y: y.s - (b[1].q - y.q - 3) - (b[1].t - y.t - 3))), 0))}}),
      [{{'q': -1000000::BIGINT, 't': 1000000::BIGINT, 's': 0::BIGINT}}]) AS l FROM steps)"""


def _chained(spark: SparkSession, sf: str) -> DataFrame:
    frames, proteins = _open_frames(spark, sf)
    return chaining.chains(kmers.seeds(frames, proteins, 3).withColumn("size", F.lit(3)), ["read_id", "frame", "start", "protein_id"])


@query("chained_seeds", _short(3) + ", " + _CHAINS + " SELECT read_id, frame, start, protein_id, list_max(list_transform(l, lambda y: y.s)) AS score FROM run")
def chained_seeds(spark, sf):
    """JN23: the best chain of the seeds of each open stretch and protein."""
    return _chained(spark, sf).select("read_id", "frame", "start", "protein_id", "score")


@query(
    "anchor_pairs",
    _short(3) + ", " + _CHAINS + """, c AS (SELECT read_id AS pair_id, frame % 2 AS mate, protein_id AS ref_id, max(list_max(list_transform(l, lambda y: y.s))) AS score FROM run GROUP BY ALL),
    b AS (SELECT *, ref_id % 3 = 0 AS gene, row_number() OVER (PARTITION BY pair_id, mate, ref_id % 3 = 0 ORDER BY score DESC, ref_id) AS place FROM c)
    SELECT g.pair_id, CAST(g.mate AS INTEGER) AS mate, g.ref_id AS gene, a.ref_id AS anchor, CAST(g.score + a.score AS BIGINT) AS score
    FROM b g JOIN b a ON g.pair_id = a.pair_id AND g.mate <> a.mate AND g.place = 1 AND a.place = 1 AND g.gene AND NOT a.gene""",
)
def anchor_pairs(spark, sf):
    """JN23: mates (here the odd and the even frames of a read) of which one chains to a gene and the other to an anchor."""
    chained = _chained(spark, sf).select(F.col("read_id").alias("pair_id"), (F.col("frame") % 2).cast("int").alias("mate"), F.col("protein_id").alias("ref_id"), "score")
    proteins = _open_frames(spark, sf)[1]
    gene = proteins.select(F.col("protein_id").alias("ref_id"), (F.col("protein_id") % 3 == 0).alias("gene")).distinct()
    return chaining.anchor_pairs(chained, gene)


_LAYERS = """e AS (SELECT 'b' || p_brand AS src, 't' || p_type AS dst, count(*)::DOUBLE AS weight FROM part GROUP BY ALL UNION ALL SELECT 't' || p_type, 's' || p_size, count(*) FROM part GROUP BY ALL
    UNION ALL SELECT 's' || p_size, 'n' || s_nationkey, count(*) FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    c AS (SELECT dst AS id, sum(weight) % 7 + 1 AS coverage, count(*) % 5 + 1 AS identity FROM e GROUP BY dst),
    w AS (SELECT src, dst, weight * coverage * identity AS w FROM e JOIN c ON dst = id)"""


@query(
    "best_paths",
    f"""WITH {_LAYERS}, p AS (SELECT src AS start, dst AS node, src || '>' || dst AS path, w AS score FROM w WHERE src LIKE 'b%'
    UNION ALL SELECT a.src, b.dst, a.src || '>' || a.dst || '>' || b.dst, a.w + b.w FROM w a JOIN w b ON a.dst = b.src WHERE a.src LIKE 'b%'
    UNION ALL SELECT a.src, c.dst, a.src || '>' || a.dst || '>' || b.dst || '>' || c.dst, a.w + b.w + c.w FROM w a JOIN w b ON a.dst = b.src JOIN w c ON b.dst = c.src WHERE a.src LIKE 'b%')
    SELECT start, node, CAST(row_number() OVER (PARTITION BY start, node ORDER BY score DESC, path) AS INTEGER) AS place, path, score FROM p QUALIFY place <= 3""",
)
def best_paths(spark, sf):
    """RM12: the three best paths from every brand to every type, size and nation, of which there are hundreds of thousands."""
    part, line, supplier = (table(spark, sf, n) for n in ("part", "lineitem", "supplier"))
    met = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
    pair = lambda df, a, x, b, y: df.groupBy(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    e = pair(part, "b", "p_brand", "t", "p_type").unionByName(pair(part, "t", "p_type", "s", "p_size")).unionByName(pair(met, "s", "p_size", "n", "s_nationkey"))
    scores = e.groupBy(F.col("dst").alias("id")).agg((F.sum("weight") % 7 + 1).alias("coverage"), (F.count("*") % 5 + 1).alias("identity"))
    sources = e.where(F.col("src").startswith("b")).select(F.col("src").alias("id")).distinct()
    return graph.best_paths(e, scores, sources).withColumn("path", F.array_join("path", ">"))


_NAME = _DNA.replace("text", "c_mktsegment || p_name")


@query(
    "maximal_matches",
    f"""WITH {_REF}, g AS (SELECT string_agg(seq, '|') AS t FROM ref), r AS (SELECT p_partkey AS read_id, {_NAME} AS s FROM part JOIN customer ON p_partkey = c_custkey),
    e AS (SELECT read_id, s, unnest(range(1, length(s) + 1)) AS e FROM r),
    m AS (SELECT read_id, s, e, coalesce(list_max(list_filter(range(1, e + 1), lambda n: contains(t, substr(s, e - n + 1, n)))), 0) AS n FROM e, g),
    w AS (SELECT *, lead(e - n) OVER (PARTITION BY read_id ORDER BY e) AS later FROM m),
    k AS (SELECT read_id, e - n AS q, n AS length, substr(s, e - n + 1, n) AS x FROM w WHERE n >= 7 AND (later IS NULL OR later > e - n)),
    d AS (SELECT DISTINCT x FROM k), o AS (SELECT x, item_id, unnest(list_filter(range(0, length(seq)), lambda i: substr(seq, i + 1, length(x)) = x)) AS t FROM d, ref)
    SELECT read_id, q, length, item_id, t FROM k JOIN o USING (x)""",
)
def maximal_matches(spark, sf):
    """GR18: the places of all maximal matches of seven bases and more of short reads (segments and names of parts) in the reference, by an FM index in shards."""
    part, customer = table(spark, sf, "part"), table(spark, sf, "customer")
    named = part.join(customer, part.p_partkey == customer.c_custkey)
    r = named.select(F.col("p_partkey").alias("read_id"), Q.dna_of_text(F.concat("c_mktsegment", "p_name")).alias("seq"))
    index = fm.build(reference(spark, sf).withColumnRenamed("item_id", "ref_id"), shard_bases=1 << 12)
    return fm.maximal_matches(r, index, least=7).withColumnRenamed("ref_id", "item_id")


def _extension_sql(same: str, most: int, side: int, identity: float, least: int) -> str:
    score = f"{_BLOSUM}[({_AT('x')}) * 24 + ({_AT('y')}) + 1]"
    step = lambda name, q, t: f"""{name}s AS (SELECT f.*, k, substr(peptide, CAST({q} AS INTEGER) + 1, 1) AS x, substr(protein, CAST({t} AS INTEGER) + 1, 1) AS y FROM f, range(0, {side}) r(k) WHERE {q} >= 0 AND {t} >= 0 AND {q} < length(peptide) AND {t} < length(protein)),
    {name}b AS (SELECT *, coalesce(sum(CASE WHEN {same} THEN 0 ELSE 1 END) OVER (PARTITION BY read_id, frame, start, protein_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bad FROM {name}s),
    {name} AS (SELECT read_id, frame, start, protein_id, count(*) AS n FROM {name}b WHERE bad <= {most} GROUP BY ALL)"""  # noqa: E731
    return (
        _FRAMES
        + f""", f AS (SELECT s.*, peptide, protein FROM (SELECT read_id, frame, start, protein_id, min(struct_pack(q := q, t := t)) AS s, count(*) AS n_seeds FROM seeds GROUP BY ALL) s JOIN open USING (read_id, frame, start) JOIN prot USING (protein_id)),
    {step("l", "s.q - 1 - k", "s.t - 1 - k")}, {step("r", "s.q + 8 + k", "s.t + 8 + k")},
    g AS (SELECT f.*, s.q - coalesce(l.n, 0) AS query_start, s.t - coalesce(l.n, 0) AS ref_start, coalesce(l.n, 0) + 8 + coalesce(r.n, 0) AS length
      FROM f LEFT JOIN l USING (read_id, frame, start, protein_id) LEFT JOIN r USING (read_id, frame, start, protein_id)),
    c AS (SELECT g.*, substr(peptide, CAST(query_start + i + 1 AS INTEGER), 1) AS x, substr(protein, CAST(ref_start + i + 1 AS INTEGER), 1) AS y FROM (SELECT *, unnest(range(0, length)) AS i FROM g) g)
    SELECT read_id, frame, start, protein_id, n_seeds, CAST(any_value(query_start) AS INTEGER) AS query_start, CAST(any_value(ref_start) AS INTEGER) AS ref_start, CAST(any_value(length) AS INTEGER) AS length,
      round(count(*) FILTER (WHERE {same}) / count(*), 6) AS identity, CAST(sum({score}) AS DOUBLE) AS score, CAST(count(*) FILTER (WHERE x <> y) AS INTEGER) AS mutations
    FROM c GROUP BY read_id, frame, start, protein_id, n_seeds HAVING count(*) FILTER (WHERE {same}) / count(*) >= {identity} AND count(*) >= {least}"""
    )


def _matches(found: DataFrame) -> DataFrame:
    return found.select("read_id", "frame", "start", "protein_id", "n_seeds", "query_start", "ref_start", "length", F.round("identity", 6).alias("identity"), "score", F.size("mutations").alias("mutations"))


@query("extended_seeds", _extension_sql(f"{_BLOSUM}[({_AT('x')}) * 24 + ({_AT('y')}) + 1] > 0", 3, 30, 0.85, 20))
def extended_seeds(spark, sf):
    """JN03: the first seed of a frame and a protein, extended while pairs of positive score last."""
    return _matches(kmers.protein_matches(*_open_frames(spark, sf), 8, 1, 0.85, 20, 3, 30, True))


@query("extended_seeds_exact", _extension_sql("x = y", 2, 50, 0.8, 20))
def extended_seeds_exact(spark, sf):
    """JN04: the same with equal residues only, fewer mismatches and longer sides."""
    return _matches(kmers.protein_matches(*_open_frames(spark, sf), 8, 1, 0.8, 20, 2, 50, False))


def _local_sql(pair: str, gap: int, band: int) -> str:
    """Local alignment of open stretches and the proteins they share a word with: a row of scores per residue of the query, gaps along it by a running maximum."""
    row = f"""list_transform(range(1, nt + 1), lambda j: CASE WHEN abs(j - 1 - i) <= {band} THEN greatest(0, coalesce(h[j - 1], 0) + ({pair}), h[j] + {gap}) ELSE 0 END)"""
    run = f"""list_transform(range(1, nt + 1), lambda j: CASE WHEN abs(j - 1 - i) <= {band} THEN list_max(list_transform(range(greatest(1, j - {2 * band}), j + 1), lambda k: CASE WHEN abs(k - 1 - i) <= {band} THEN g[k] + {gap} * (j - k) ELSE 0 END)) ELSE 0 END)"""
    return _SHORT.replace("WITH ", "WITH RECURSIVE ", 1) + f""", z AS (SELECT DISTINCT s.read_id, s.frame, s.start, s.protein_id, o.peptide AS x, p.protein AS y, length(o.peptide) AS nq, length(p.protein) AS nt
      FROM seeds s JOIN open o ON s.read_id = o.read_id AND s.frame = o.frame AND s.start = o.start JOIN prot p ON s.protein_id = p.protein_id),
    rows_ AS (SELECT *, CAST(-1 AS BIGINT) AS i, list_transform(range(1, nt + 1), lambda j: CAST(0 AS BIGINT)) AS h FROM z
      UNION ALL SELECT * EXCLUDE (g), {run} AS h FROM (SELECT * EXCLUDE (h), {row} AS g FROM (SELECT * REPLACE (i + 1 AS i) FROM rows_ WHERE i + 1 < nq))),
    found AS (SELECT read_id, frame, start, protein_id, CAST(max(list_max(h)) AS BIGINT) AS score FROM rows_ GROUP BY ALL)
    SELECT * FROM found"""


def _seeded(spark: SparkSession, sf: str) -> DataFrame:
    """Open stretches and the proteins that they share a word of four residues with."""
    frames, proteins = _open_frames(spark, sf)
    key = ["read_id", "frame", "start"]
    pairs = kmers.seeds(frames, proteins, 4).select(*key, "protein_id").distinct()
    return pairs.join(frames.select(*key, "peptide"), key).join(proteins, "protein_id")


def _local(spark, sf, *rule):
    return _seeded(spark, sf).select("read_id", "frame", "start", "protein_id", A.local_score(*rule)(F.col("peptide"), F.col("protein"))["score"].alias("score"))


_RESIDUE_PAIR = f"{_BLOSUM}[({_AT('substr(x, CAST(i + 1 AS INTEGER), 1)')}) * 24 + ({_AT('substr(y, CAST(j AS INTEGER), 1)')}) + 1]"
_LETTER_PAIR = lambda match, other: f"CASE WHEN substr(x, CAST(i + 1 AS INTEGER), 1) = substr(y, CAST(j AS INTEGER), 1) THEN {match} ELSE {other} END"


@query("local_residues", _local_sql(_RESIDUE_PAIR, -3, 15))
def local_residues(spark, sf):
    """JN05: local alignment by residue scores, gap 3, band 15."""
    return _local(spark, sf, None, -1, -3, 15)


@query("local_residues_narrow", _local_sql(_RESIDUE_PAIR, -2, 10))
def local_residues_narrow(spark, sf):
    """JN06: gap 2, band 10."""
    return _local(spark, sf, None, -1, -2, 10)


@query("local_letters", _local_sql(_LETTER_PAIR(2, -1), -1, 15))
def local_letters(spark, sf):
    """JN07: match 2, mismatch 1, gap 1."""
    return _local(spark, sf, 2, -1, -1, 15)


@query("local_bases", _local_sql(_LETTER_PAIR(5, -3), -8, 15) + " QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY score DESC, frame, start, protein_id) <= 10")
def local_bases(spark, sf):
    """RM01: match 5, mismatch 3, gap 8, the ten best per read at most."""
    found = _local(spark, sf, 5, -3, -8, 15)
    return kmers.first_n(found, ["read_id"], [F.desc("score"), F.col("frame"), F.col("start"), F.col("protein_id")], 10)


@query(
    "ungapped_runs",
    _SHORT + f""", p AS (SELECT DISTINCT s.read_id, s.frame, s.start, s.protein_id, o.peptide AS x, p.protein AS y
      FROM seeds s JOIN open o ON s.read_id = o.read_id AND s.frame = o.frame AND s.start = o.start JOIN prot p ON s.protein_id = p.protein_id),
    c AS (SELECT * EXCLUDE (x, y), {_BLOSUM}[({_AT("substr(x, CAST(i + 1 AS INTEGER), 1)")}) * 24 + ({_AT("substr(y, CAST(j + 1 AS INTEGER), 1)")}) + 1] AS s FROM (SELECT *, unnest(range(0, length(y))) AS j FROM (SELECT *, unnest(range(0, length(x))) AS i FROM p))),
    t AS (SELECT *, sum(s) OVER (PARTITION BY read_id, frame, start, protein_id, j - i ORDER BY i) AS total FROM c),
    m AS (SELECT *, total - least(0, coalesce(min(total) OVER (PARTITION BY read_id, frame, start, protein_id, j - i ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS gain FROM t)
    SELECT read_id, frame, start, protein_id, CAST(max(gain) AS BIGINT) AS score FROM m GROUP BY ALL HAVING max(gain) >= 25""",
)
def ungapped_runs(spark, sf):
    """JN08, RM30: the best run without gaps over all offsets, of open stretches and the proteins they share a word with."""
    key = ["read_id", "frame", "start", "protein_id"]
    found = _seeded(spark, sf).select(*key, A.best_ungapped(25, 1)(F.col("peptide"), F.col("protein")).alias("m"))
    return found.select(*key, "m.score").where("score IS NOT NULL")


@query(
    "scanned_codons",
    f"""WITH {_REF}, k(pos, mutant) AS (VALUES (3, 'L'), (7, 'S'), (12, 'K'), (20, 'R'), (31, 'T'))
    SELECT item_id AS id, pos, mutant FROM ref, k WHERE length(seq) >= pos * 3 AND substr('{Q.AMINO_ACIDS}', 1 + 16 * (strpos('TCAG', substr(seq, pos * 3 - 2, 1)) - 1) + 4 * (strpos('TCAG', substr(seq, pos * 3 - 1, 1)) - 1) + strpos('TCAG', substr(seq, pos * 3, 1)) - 1, 1) = mutant""",
)
def scanned_codons(spark, sf):
    """RM31: known mutations at a sequence's own codons."""
    known = spark.createDataFrame([("g", p, "W", m) for p, m in ((3, "L"), (7, "S"), (12, "K"), (20, "R"), (31, "T"))], "gene string, pos int, wild string, mutant string")
    found = alleles.codon_scan(reference(spark, sf).select(F.col("item_id").alias("id"), F.lit("g").alias("gene"), "seq"), known)
    return found.select("id", "pos", "mutant")


# lookups, reports and placements


@query(
    "looked_up_taxa",
    f"WITH {_HITS}, t AS (SELECT s_suppkey % 25 AS taxon, max(s_nationkey) AS nation FROM supplier WHERE s_suppkey % 25 < 20 GROUP BY 1) SELECT hits.taxon, coalesce(nation, 0) AS nation, count(*) AS n, round(sum(identity), 4) AS weight FROM hits LEFT JOIN t USING (taxon) GROUP BY ALL",
)
def looked_up_taxa(spark, sf):
    """JN15, JN16, JN17, RM11, RM28: exact lookups with a default, weighted."""
    t = table(spark, sf, "supplier").where("s_suppkey % 25 < 20").groupBy((F.col("s_suppkey") % 25).alias("taxon")).agg(F.max("s_nationkey").alias("nation"))
    found = kmers.looked_up(hits(spark, sf).select("taxon", "identity"), t, "taxon", "nation")
    return found.groupBy("taxon", "nation").agg(F.count("*").alias("n"), F.round(F.sum("identity"), 4).alias("weight"))


@query(
    "known_mutations",
    """WITH m AS (SELECT l_orderkey AS id, l_linenumber AS n, 'g' || l_suppkey % 3 AS gene, 80 + l_partkey % 9 AS pos, chr(CAST(65 + l_suppkey % 7 AS INTEGER)) AS alt FROM lineitem)
    SELECT id, gene, count(*) FILTER (WHERE (gene = 'g0' AND pos = 83 AND alt = 'C') OR (gene = 'g1' AND pos = 87 AND alt = 'D') OR (gene = 'g2' AND pos = 80 AND alt = 'A')) AS known, count(*) AS mutations FROM m GROUP BY ALL""",
)
def known_mutations(spark, sf):
    """RM03, FLT09: mutations looked up by gene, position and residue."""
    known = spark.createDataFrame([("g0", 83, "C"), ("g1", 87, "D"), ("g2", 80, "A")], "gene string, pos long, mutant string")
    m = F.struct((F.lit(80) + F.col("l_partkey") % 9).alias("pos"), F.chr(F.lit(65) + F.col("l_suppkey") % 7).alias("alt"))
    each = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("g"), (F.col("l_suppkey") % 3).cast("string")).alias("gene"), m.alias("m"))
    return alleles.annotated(each.groupBy("id", "gene").agg(F.collect_list("m").alias("mutations")), known, "id", ["gene"])


@query(
    "depth_of_covered",
    f"""WITH {_HITS}, d AS (SELECT gene_id, p, count(*) AS depth FROM (SELECT gene_id, unnest(range(ref_start, ref_end)) AS p FROM hits) GROUP BY ALL)
    SELECT gene_id, round(sum(depth) / (count(*) * 3.0), 6) AS depth_covered FROM d JOIN genes USING (gene_id) WHERE p < length GROUP BY gene_id""",
)
def depth_of_covered(spark, sf):
    """AG04."""
    return coverage.abundance_by_coverage(hits(spark, sf), genes(spark, sf)).select("gene_id", F.round("depth_covered", 6).alias("depth_covered"))


@query(
    "sampled_orders",
    "SELECT o_orderkey AS id FROM orders WHERE ('0x' || md5(CAST(o_orderkey AS VARCHAR))[1:8])::BIGINT % 10000 < 1000",
)
def sampled_orders(spark, sf):
    """ST13: one key in ten, the same in every engine."""
    return kmers.sampled(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id", 0.1)


_TPM = f"""{_HITS}, r AS (SELECT gene_id, count(*) AS reads, avg(identity) AS identity FROM hits GROUP BY gene_id), k AS (SELECT *, reads / (length * 3 / 1000.0) AS rpk FROM r JOIN genes USING (gene_id)),
    t AS (SELECT *, rpk / (SELECT sum(rpk) FROM k) * 1e6 AS tpm FROM k)"""


@query(
    "family_report",
    f"WITH {_TPM}, f AS (SELECT family, count(*) AS variants, sum(reads)::BIGINT AS reads, sum(tpm) AS tpm, sum(identity * reads) / sum(reads) AS identity FROM t GROUP BY family) SELECT row_number() OVER (ORDER BY tpm DESC, family) AS place, family, variants, reads, round(tpm, 3) AS tpm, round(identity, 6) AS mean_identity FROM f",
)
def family_report(spark, sf):
    """ST02: gene families by falling TPM."""
    from pyspark.sql import Window

    h, g = hits(spark, sf), genes(spark, sf)
    rows = coverage.abundance(h.select("read_id", "gene_id"), g, 1).join(g.select("gene_id", "family"), "gene_id").join(h.groupBy("gene_id").agg(F.avg("identity").alias("mean_identity")), "gene_id")
    f = coverage.family_report(rows)
    return f.select(
        F.row_number().over(Window.orderBy(F.desc("tpm"), "family")).cast("long").alias("place"), "family", F.size(F.split("variants", ", ")).cast("long").alias("variants"), "reads",
        F.round("tpm", 3).alias("tpm"), F.round("mean_identity", 6).alias("mean_identity"),
    )


@query(
    "co_occurring_nodes",
    "SELECT DISTINCT a.s_suppkey AS id, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_suppkey = a.s_suppkey + 25",
)
def co_occurring_nodes(spark, sf):
    """GR13."""
    s = table(spark, sf, "supplier")
    a, b = s.select("s_nationkey", F.col("s_suppkey").alias("src")), s.select("s_nationkey", F.col("s_suppkey").alias("dst"))
    edges = a.join(b, "s_nationkey").where("dst = src + 25").select("src", "dst", F.lit("co_occurs").alias("type"))
    other = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("carries").alias("type"))
    return graph.co_occurring(edges.unionByName(other), s.select(F.col("s_suppkey").alias("id")))


@query(
    "placed_pairs",
    """WITH p AS (SELECT l_orderkey AS pair_id, l_linenumber, l_suppkey % 5 AS genome, l_partkey % 2000 AS place, 1 - l_discount AS identity, 50 + CAST(floor(l_quantity) AS INTEGER) AS n FROM lineitem),
    m AS (SELECT a.pair_id, a.genome, abs(b.place - a.place) + greatest(a.n, b.n) AS insert, (a.identity + b.identity) / 2 AS i FROM p a JOIN p b ON a.pair_id = b.pair_id AND a.genome = b.genome AND a.l_linenumber = 1 AND b.l_linenumber = 2),
    s AS (SELECT *, insert BETWEEN 100 AND 1000 AS concordant, i * CASE WHEN insert BETWEEN 100 AND 1000 THEN 1.5 ELSE 1.0 END AS score FROM m),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, genome) AS r FROM s) WHERE r = 1)
    SELECT genome, count(*) FILTER (WHERE concordant) AS concordant, count(*) FILTER (WHERE NOT concordant) AS discordant, round(sum(score * CASE WHEN concordant THEN 1.5 ELSE 0.7 END), 6) AS score FROM o GROUP BY genome""",
)
def placed_pairs(spark, sf):
    """RM25: mates placed on one genome, concordant by their insert."""
    p = table(spark, sf, "lineitem").where("l_linenumber <= 2").select(
        F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("mate"), (F.col("l_suppkey") % 5).alias("genome"), (F.col("l_partkey") % 2000).alias("place"),
        (1 - F.col("l_discount")).alias("identity"), (F.lit(50) + F.col("l_quantity").cast("int")).alias("n"),
    )
    out = classify.placement_profile(classify.pair_placements(p))
    return out.select("genome", "concordant", "discordant", F.round("score", 6).alias("score"))


@query(
    "placed_reads",
    f"""WITH {_REF}, g AS (SELECT item_id, seq FROM ref WHERE length(seq) >= 130), r AS (SELECT item_id AS read_id, substr(seq, 31, 100) AS read FROM g),
    c AS (SELECT read_id, read, item_id AS genome, seq, unnest(range(0, length(seq) - 99)) AS place FROM r, g),
    s AS (SELECT * FROM c WHERE len(list_filter(range(0, 16), lambda i: substr(read, i * 6 + 1, 6) = substr(seq, place + i * 6 + 1, 6))) > 0),
    m AS (SELECT read_id, genome, place, len(list_filter(range(1, 101), lambda i: substr(read, i, 1) = substr(seq, place + i, 1))) / 100 AS identity FROM s)
    SELECT read_id, genome, CAST(arg_min(place, (-identity, place)) AS INTEGER) AS place, max(identity) AS identity FROM m WHERE identity >= 0.35 GROUP BY ALL""",
)
def placed_reads(spark, sf):
    """RM26: reads cut from the sequences: the best place of each in every sequence, by all its bases, from shared words of six."""
    genomes = reference(spark, sf).select(F.col("item_id").alias("genome"), "seq").where(F.length("seq") >= 130)
    r = genomes.select(F.col("genome").alias("read_id"), F.substring("seq", 31, 100).alias("seq"))
    found = classify.placements(r, genomes, 6, None, 0.35, tile=64)
    return found.select("read_id", "genome", F.col("place").cast("int").alias("place"), "identity")


@query(
    "merged_candidates",
    "WITH c AS (SELECT p_size AS kmer, p_partkey % 25 AS taxon FROM part) SELECT kmer, count(*) AS n, count(DISTINCT taxon) AS taxa FROM c GROUP BY kmer",
)
def merged_candidates(spark, sf):
    """RM14, RM21, RM23: hits as candidates, duplicates merged by minimizer."""
    c = kmers.candidates(table(spark, sf, "part").select(F.col("p_size").alias("kmer"), (F.col("p_partkey") % 25).alias("taxon")))
    return c.groupBy("kmer").agg(F.sum("n").alias("n"), F.count_distinct("taxon").alias("taxa"))


# sources, by round trips


def _put(spark: SparkSession, lines: DataFrame, name: str) -> str:
    path = shared_folder(spark, name)
    sinks.text_lines(lines, path)
    return path


def _fastq_files(records: DataFrame, name: str, most: int) -> str:
    """Records (mate, id, header, seq, plus, qual) as text files ``mate=m/part=p`` of about 500, each in order of id; a task writes about 32.

    There are at most ``most`` records; who counted them would make them twice.
    """
    spark = records.sparkSession
    path, files = shared_folder(spark, name), 2 + most // 500
    tasks = max(spark.sparkContext.defaultParallelism, files // 32)
    placed = records.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(files)))
    text = F.concat_ws("\n", "header", "seq", "plus", "qual")
    placed = placed.repartition(tasks, "mate", "part").sortWithinPartitions("mate", "part", "id").select("mate", "part", text.alias("value"))
    placed.write.partitionBy("mate", "part").text(path)
    return path


_READS = f"docs AS (SELECT doc_id, {_DNA} AS seq FROM documents)"


@query("fastq_round_trip", f"WITH {_READS} SELECT doc_id AS id, length(seq) AS n, md5(seq) AS seq, true AS same_name FROM docs WHERE length(seq) > 0")
def fastq_round_trip(spark, sf):
    """SRC01, SRC02, SRC03, SRC05: all reads as records of two mates in several files, each scanned by several tasks, joined by file and ordinal."""
    r = reads(spark, sf).where(F.length("seq") > 0)
    mates = F.explode(F.array(F.struct(F.lit(1).alias("mate"), F.col("seq")), F.struct(F.lit(2).alias("mate"), Q.reverse_complement(F.col("seq")).alias("seq")))).alias("m")
    each = r.select("doc_id", mates).select(
        "m.mate", F.col("doc_id").alias("id"), F.format_string("@%d/%d x", "doc_id", "m.mate").alias("header"), "m.seq", F.lit("+").alias("plus"),
        F.translate("m.seq", "ACGT", "@+I#").alias("qual"),
    )
    path = _fastq_files(each, "reads", 2 * table(spark, sf, "documents").count())
    one, two = (fastq.scan(spark, f"{path}/mate={m}", split=1 << 18) for m in (1, 2))
    p = fastq.pairs(one, two, F.regexp_extract("file", r"part=(\d+)", 1)).where(Q.reverse_complement(F.col("seq_2")) == F.col("seq_1"))
    return p.select(fastq.read_name(F.col("header_1")).cast("long").alias("id"), F.length("seq_1").cast("long").alias("n"), F.md5("seq_1").alias("seq"), "same_name")


@query(
    "fastq_checks",
    f"""WITH {_READS}, r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 'header' WHEN doc_id % 7 = 2 THEN 'separator' WHEN doc_id % 7 = 3 THEN 'quality length' END AS reason FROM docs)
    SELECT doc_id AS id, reason FROM r""",
)
def fastq_checks(spark, sf):
    """SRC04: all reads as records, some broken by their id: what each is refused for."""
    bad = F.col("doc_id") % 7
    each = reads(spark, sf).select(
        F.lit(1).alias("mate"), F.col("doc_id").alias("id"), F.concat(F.when(bad == 1, "r").otherwise("@"), F.col("doc_id").cast("string")).alias("header"), "seq",
        F.when(bad == 2, "-").otherwise("+").alias("plus"), F.concat(F.repeat(F.lit("@"), F.length("seq")), F.when(bad == 3, "I").otherwise("")).alias("qual"),
    )
    path = _fastq_files(each, "checks", table(spark, sf, "documents").count())
    return fastq.scan(spark, path, split=1 << 18).select(F.regexp_extract("header", r"(\d+)", 1).cast("long").alias("id"), "reason")


@query("sample_sheets", "SELECT 's' || s_suppkey AS sample_name, '/data/' || s_suppkey || '_1.fq' AS r1, CASE WHEN s_suppkey % 2 = 0 THEN '/data/' || s_suppkey || '_2.fq' END AS r2, 'w' || s_nationkey AS ward FROM supplier")
def sample_sheets(spark, sf):
    """SRC06, SRC07: a sheet with semicolons, and no error in it."""
    s = table(spark, sf, "supplier").coalesce(1)
    k = F.col("s_suppkey").cast("string")
    row = F.concat_ws(";", F.concat(F.lit("s"), k), F.lit("/data/"), F.concat(k, F.lit("_1.fq")), F.when(F.col("s_suppkey") % 2 == 0, F.concat(k, F.lit("_2.fq"))).otherwise(""), F.concat(F.lit("w"), F.col("s_nationkey").cast("string")))
    head = spark.createDataFrame([("SampleName;FilePath;R1 file;R2 file;Ward",)], "value string")
    path = _put(spark, head.unionByName(s.select(row.alias("value"))).coalesce(1), "sheet")
    sheet = tables.sheet(spark, path)
    fine = sheet.join(tables.sheet_errors(sheet), "sample_name", "left_anti")
    return fine.select("sample_name", "r1", "r2", F.col("metadata")["Ward"].alias("ward"))


@query("manifests", "SELECT 's' || s_suppkey AS sample_id, s_name || '_1' AS r1, s_name || '_2' AS r2 FROM supplier")
def manifests(spark, sf):
    """SRC08: manifests of a hundred samples each, every other one in the second layout, written and read by tasks."""
    s = table(spark, sf, "supplier").withColumn("file", F.floor(F.col("s_suppkey") / 100))
    sample = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    mate = lambda i: F.concat("s_name", F.lit(f"_{i}"))
    one = F.struct(sample.alias("sample_id"), mate(1).alias("read1"), mate(2).alias("read2"))
    two = F.struct(mate(1).alias("forward"), mate(2).alias("reverse"))
    lists = s.where("file % 2 = 0").groupBy("file").agg(F.to_json(F.struct(F.collect_list(one).alias("samples"))).alias("value"))
    maps = s.where("file % 2 = 1").groupBy("file").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(sample, two))).alias("files"))).alias("value"))
    out = None
    for name, files in (("lists", lists), ("maps", maps)):
        path = shared_folder(spark, name)
        sinks.named_files(files.select(F.concat(F.col("file").cast("string"), F.lit(".json")).alias("name"), "value"), path)
        if fastq.listed(path):
            found = tables.manifest(spark, path)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "sample_id string, r1 string, r2 string")


@query("mutation_tables", "SELECT 'S' || p_partkey AS species, 'gyrA' AS gene, p_size AS pos, chr(CAST(65 + p_partkey % 26 AS INTEGER)) AS wild, 'L' AS mutant FROM part WHERE p_partkey % 10 <> 0")
def mutation_tables(spark, sf):
    """SRC09, SRC10: a mutation table; rows without a position are left out."""
    p = table(spark, sf, "part").select(
        F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("species"), F.lit("gyrA").alias("gene"), F.when(F.col("p_partkey") % 10 == 0, "NA").otherwise(F.col("p_size").cast("string")).alias("location"),
        F.chr(F.lit(65) + F.col("p_partkey") % 26).alias("wt"), F.lit("L").alias("mut"),
    )
    path = shared_folder(spark, "mutations")
    p.write.option("header", True).csv(path)
    return tables.mutations(spark, path).drop("row")


@query(
    "protein_fasta",
    f"WITH {_REF} SELECT item_id AS gene_id, 'WP_' || item_id || '.1' AS accession, 'blaX-' || item_id AS gene_name, 'blaX' AS gene_family, 'BETA-LACTAM' AS drug_class, md5(seq) AS seq, length(seq) AS length, md5(seq) AS dna FROM ref WHERE length(seq) > 0",
)
def protein_fasta(spark, sf):
    """SRC11, SRC12, SRC13: records with bars in their headers, and the DNA of the same accession."""
    r = reference(spark, sf).where(F.length("seq") > 0)
    k = F.col("item_id").cast("string")
    text = F.concat(F.lit(">"), k, F.lit("|WP_"), k, F.lit(".1|1|1|blaX-"), k, F.lit("|blaX|hydrolase|2|CEPHALOSPORIN|BETA-LACTAM|d\n"), F.lower(F.substring("seq", 1, 40)), F.lit("\n"), F.substring(F.col("seq"), F.lit(41), F.length("seq")))
    proteins = tables.amr_proteins(tables.fasta(spark, _put(spark, r.select(text.alias("value")), "proteins")))
    dna = r.select(F.concat(F.lit("WP_"), k, F.lit(".2")).alias("accession"), "seq")
    return tables.matched(dna, proteins).select(
        F.col("gene_id").cast("long").alias("gene_id"), "accession", "gene_name", "gene_family", "drug_class", F.md5("seq").alias("seq"), F.col("length").cast("long").alias("length"), F.md5("dna").alias("dna")
    )


@query(
    "genome_fasta",
    f"WITH {_REF} SELECT item_id AS taxon, 'NC_' || item_id AS accession, 'Escherichia coli' AS species, length(seq) AS n, (SELECT count(DISTINCT item_id // 10) FROM ref WHERE length(seq) > 0) AS files FROM ref WHERE length(seq) > 0",
)
def genome_fasta(spark, sf):
    """SRC14, SRC15, SRC16: genomes with taxa in their headers, found in a folder."""
    r = reference(spark, sf).where(F.length("seq") > 0)
    k = F.col("item_id").cast("string")
    text = F.concat(F.lit(">kraken:taxid|"), k, F.lit("|NC_"), k, F.lit(" Escherichia coli K-12\n"), F.col("seq"))
    path = shared_folder(spark, "genomes")
    sinks.named_files(r.groupBy(F.concat(F.floor(F.col("item_id") / 10).cast("string"), F.lit(".fna")).alias("name")).agg(F.array_join(F.collect_list(text), "\n").alias("value")), path)
    files = tables.genome_files(spark, path)
    g = tables.genomes(tables.fasta(spark, path))
    return g.select("taxon", "accession", "species", F.length("seq").cast("long").alias("n")).crossJoin(F.broadcast(files.agg(F.count("*").alias("files"))))


@query("taxonomy_files", "SELECT CAST(n_nationkey + 10 AS BIGINT) AS id, CAST(n_regionkey + 1 AS BIGINT) AS parent, 'species' AS rank, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 1, CASE WHEN r_regionkey > 0 THEN 1 END, 'phylum', r_name FROM region")
def taxonomy_files(spark, sf):
    """SRC17: a taxonomy written as dump files and read again."""
    n = table(spark, sf, "nation").select((F.col("n_nationkey") + 10).alias("id"), (F.col("n_regionkey") + 1).alias("parent"), F.lit("species").alias("rank"), F.col("n_name").alias("name"))
    t = n.unionByName(table(spark, sf, "region").select((F.col("r_regionkey") + 1).alias("id"), F.lit(1).alias("parent"), F.lit("phylum").alias("rank"), F.col("r_name").alias("name")))
    dump = lambda *c: F.concat(F.concat_ws("\t|\t", *(F.col(x).cast("string") if isinstance(x, str) else x for x in c)), F.lit("\t|")).alias("value")
    nodes = _put(spark, t.select(dump("id", "parent", "rank")), "nodes")
    names = _put(spark, t.select(dump("id", "name", F.lit(""), F.lit("scientific name"))).unionByName(t.select(dump("id", F.lit("x"), F.lit(""), F.lit("synonym")))), "names")
    return tables.taxonomy_dump(spark, nodes, names)


@query("taxonomy_table", "SELECT CAST(n_nationkey + 10 AS BIGINT) AS id, CAST(n_regionkey + 1 AS BIGINT) AS parent, 'genus' AS rank, n_name || ' genus' AS name FROM nation")
def taxonomy_table(spark, sf):
    """SRC18: a taxonomy of three columns, ranks guessed from names."""
    n = table(spark, sf, "nation").select((F.col("n_nationkey") + 10).alias("taxon_id"), F.concat("n_name", F.lit(" genus")).alias("name"), (F.col("n_regionkey") + 1).alias("parent_id"))
    path = shared_folder(spark, "taxa")
    sinks.tsv(n, path)
    return tables.taxonomy_tsv(spark, path)


@query(
    "kraken_round_trip",
    "SELECT 'r' || o_orderkey AS read_id, o_custkey % 7 > 0 AS classified, o_custkey % 7 AS taxon, 150 + o_orderkey % 50 AS n, round((o_orderkey % 1000) / 1000.0, 3) AS confidence FROM orders",
)
def kraken_round_trip(spark, sf):
    """SRC19, SNK14: per-read results out and in, paired cells as arrays."""
    o = table(spark, sf, "orders")
    n = (F.lit(150) + F.col("o_orderkey") % 50).cast("int")
    r = o.select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("read_id"), (F.col("o_custkey") % 7).alias("taxon"), F.array(n, n).alias("length"),
        ((F.col("o_orderkey") % 1000) / 1000.0).alias("confidence"), F.array(F.lit(3), F.lit(1)).alias("votes"), F.array(F.lit(9), F.lit(8)).alias("kmers"),
    )
    back = tables.kraken_results(spark, _put(spark, sinks.kraken_lines(r), "kraken"))
    return back.select("read_id", "classified", "taxon", F.get("length", 1).cast("long").alias("n"), "confidence")


@query("index_files", "SELECT o_orderkey * 1048583 AS kmer, o_custkey AS taxon FROM orders")
def index_files(spark, sf):
    """SRC20, SRC21, SRC22, SRC23: a binary index of fixed-size records, written by tasks and read again."""
    o = table(spark, sf, "orders").select((F.col("o_orderkey") * 1048583).alias("kmer"), F.col("o_custkey").alias("taxon"), F.floor(F.col("o_orderkey") / 4096).alias("file"))
    path = shared_folder(spark, "index")
    turned = lambda c, n: F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(c), 2 * n, "0"), F.lit(".."), F.lit(0))), ""))  # noqa: E731  little-endian bytes
    record = F.concat(turned(F.col("kmer"), 8), turned(F.col("taxon"), 4))
    parts = o.groupBy(F.col("file").cast("string").alias("name")).agg(F.array_join(F.collect_list(F.hex(record)), "").alias("h"))
    sinks.named_files(parts.select("name", F.unhex("h").alias("value")), path)
    return tables.kmer_index(spark, path)


@query("word_lists", "SELECT DISTINCT p_brand AS item FROM part")
def word_lists(spark, sf):
    """SRC24: distinct entries of a list with blanks and comments."""
    p = table(spark, sf, "part").select(F.concat(F.lit("  "), F.col("p_brand"), F.lit(" ")).alias("value"))
    return tables.word_list(spark, _put(spark, p.unionByName(spark.createDataFrame([("# head",), ("",)], "value string")), "list"))


@query("species_of_taxa", "SELECT n_nationkey AS taxon, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey + 100 AS BIGINT) END AS species_taxon FROM nation")
def species_of_taxa(spark, sf):
    """RM39."""
    n = table(spark, sf, "nation")
    cell = F.concat_ws("\t", *(F.lit("x") for _ in range(5)), F.col("n_nationkey").cast("string"), (F.col("n_regionkey") + 100).cast("string"))
    path = _put(spark, n.where("n_nationkey % 2 = 0").select(cell.alias("value")).unionByName(spark.createDataFrame([("# a\tb",)], "value string")), "summary")
    return tables.species_taxa(n.select(F.col("n_nationkey").alias("taxon")), spark, path)


@query("synthetic_pairs", f"WITH {_READS} SELECT doc_id AS genome, 5::BIGINT AS n, 5::BIGINT AS placed, 5::BIGINT AS inserts FROM docs WHERE length(seq) >= 350")
def synthetic_pairs(spark, sf):
    """UX15: mates generated from every read that is long enough: how many lie where they say, at inserts of 350 to 1000."""
    genomes = reads(spark, sf).select(F.col("doc_id").alias("genome_id"), "seq")
    r = synthetic.paired_reads(genomes, 5).join(genomes.withColumnRenamed("seq", "g"), "genome_id")
    here = F.substring("g", F.col("start") + 1, F.lit(150)) == F.col("seq_1")
    there = F.substring("g", F.col("start") + F.col("insert") - 149, F.lit(150)) == Q.reverse_complement(F.col("seq_2"))
    return r.groupBy(F.col("genome_id").alias("genome")).agg(F.count("*").alias("n"), F.count_if(here & there).alias("placed"), F.count_if(F.col("insert").between(350, 1000)).alias("inserts"))


# sinks, by round trips


@query(
    "tsv_round_trip",
    f"WITH {_HITS} SELECT gene_id, count(*) AS n, round(sum(identity), 4) AS identity, string_agg(DISTINCT CAST(taxon AS VARCHAR), ';' ORDER BY CAST(taxon AS VARCHAR)) AS taxa FROM hits GROUP BY gene_id",
)
def tsv_round_trip(spark, sf):
    """SNK01, SNK02, SNK06, SNK16, SNK18, SNK23: a table with an array cell."""
    t = hits(spark, sf).groupBy("gene_id").agg(F.count("*").alias("n"), F.round(F.sum("identity"), 4).alias("identity"), F.array_sort(F.collect_set(F.col("taxon").cast("string"))).alias("taxa"))
    path = shared_folder(spark, "tsv")
    sinks.tsv(t, path)
    return spark.read.option("sep", "\t").option("header", True).schema("gene_id long, n long, identity double, taxa string").csv(path)


@query(
    "allele_cells",
    "WITH c AS (SELECT l_partkey AS gene_id, l_returnflag AS residue, count(*) AS n FROM lineitem GROUP BY ALL) SELECT gene_id, string_agg(residue || ':' || n, ';' ORDER BY residue) AS cell FROM c GROUP BY gene_id",
)
def allele_cells(spark, sf):
    """SNK08: residue counts in one cell."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("gene_id"), "l_returnflag").agg(F.count("*").cast("int").alias("n"))
    m = c.groupBy("gene_id").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("m"))
    path = shared_folder(spark, "cells")
    sinks.tsv(m.select("gene_id", sinks.counts_cell(F.col("m")).alias("cell")), path)
    return spark.read.option("sep", "\t").option("header", True).schema("gene_id long, cell string").csv(path)


@query("parquet_round_trip", f"WITH {_HITS} SELECT taxon, count(*) AS n, round(sum(score), 2) AS score FROM hits WHERE taxon < 12 GROUP BY taxon")
def parquet_round_trip(spark, sf):
    """SNK05, SNK09, SNK19, SNK20, SNK21, SNK22, SRC25: partitioned tables, of which a filter reads its partitions only."""
    path = shared_folder(spark, "alignments")
    h = hits(spark, sf).select("read_id", "gene_id", "score", F.col("taxon").cast("int").alias("taxon"))
    sinks.parquet(h.repartition("taxon"), path, "taxon")
    out = tables.alignments(spark, path).where("taxon < 12").groupBy("taxon").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("score"))
    return out.withColumn("taxon", F.col("taxon").cast("long"))


@query("json_round_trip", "SELECT o_orderkey AS id, o_orderstatus AS status, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def json_round_trip(spark, sf):
    """SNK07, SNK26, RM36: nested rows as JSON lines."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("items"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")).join(li, "id")
    path = shared_folder(spark, "json")
    sinks.json_lines(o, path)
    back = spark.read.schema("id long, status string, items array<struct<l_linenumber:int,l_quantity:double>>").json(path)
    return back.select("id", "status", F.size("items").cast("long").alias("n"), F.round(F.aggregate("items", F.lit(0.0), lambda a, x: a + x["l_quantity"]), 2).alias("quantity"))


@query(
    "sam_lines",
    f"WITH {_HITS} SELECT gene_id, read_id || chr(9) || CASE WHEN is_r2 THEN '147' ELSE '99' END || chr(9) || 'g' || gene_id || chr(9) || (ref_start + 1) || chr(9) || '255' || chr(9) || (ref_end - ref_start) || 'M' || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || chr(9) || '*' || chr(9) || '*' AS line FROM hits",
)
def sam_lines(spark, sf):
    """SNK10: alignments as lines, written and read again."""
    h = hits(spark, sf).withColumn("gene_name", F.concat(F.lit("g"), F.col("gene_id").cast("string")))
    back = spark.read.text(_put(spark, sinks.sam_lines(h), "sam"))
    return back.select(F.regexp_extract("value", r"\tg(\d+)\t", 1).cast("long").alias("gene_id"), F.col("value").alias("line"))


@query("dot_lines", """SELECT '  "r' || n_regionkey || '" -> "n' || n_nationkey || '" [label="carries", weight=' || (n_nationkey % 5) || '.0];' AS line FROM nation UNION ALL SELECT 'digraph resistance {' UNION ALL SELECT '}'""")
def dot_lines(spark, sf):
    """SNK27."""
    n = table(spark, sf, "nation")
    e = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dst"), F.lit("carries").alias("type"), (F.col("n_nationkey") % 5).cast("double").alias("weight"))
    return sinks.dot(e).select(F.col("value").alias("line"))


@query(
    "reports",
    "SELECT form, n_regionkey AS region, count(*) AS n FROM nation, (SELECT unnest(['text', 'html', 'json']) AS form) GROUP BY ALL",
)
def reports(spark, sf):
    """SNK03, SNK04, SNK11, SNK12, SNK13: the rows of a section, told from three forms of a report."""
    import re

    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n")).orderBy("region")
    found = {form: sinks.report("Report <1>", {"nations": n}, ("a note",), form) for form in ("text", "html", "json")}
    rows = [("json", r["region"], r["n"]) for r in json.loads(found["json"])["nations"]]
    rows += [("text", *line.split("\t")) for line in found["text"].splitlines() if re.fullmatch(r"\d+\t\d+", line)]
    rows += [("html", *m) for m in re.findall(r"<tr><td>(\d+)</td><td>(\d+)</td></tr>", found["html"])]
    return spark.createDataFrame([(f, int(a), int(b)) for f, a, b in rows], "form string, region int, n long")


@query("summaries", "SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY ALL")
def summaries(spark, sf):
    """SNK26, SNK17: small tables as one document."""
    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"))
    rows = json.loads(sinks.summary_json(nations=n))["nations"]
    return spark.createDataFrame([(r["region"], r["n"]) for r in rows], "region int, n long")


# runners


@query("sample_batch", "SELECT 's' || c_custkey AS sample_name, CASE WHEN c_nationkey % 7 = 3 THEN 'bad ' || c_name END AS error FROM customer")
def sample_batch(spark, sf):
    """SM09, AG46, UX12: each sample's success or failure, found by the task that holds it."""

    def work(row):
        if row["k"] % 7 == 3:
            raise ValueError("bad " + row["name"])

    c = table(spark, sf, "customer").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("sample_name"), F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"))
    return jobs.samples_apart(c, work)


@query(
    "job_loop",
    """SELECT CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 5 < 3 THEN 'retry' ELSE 'dead' END ELSE 'done' END AS place, count(*) AS n FROM events GROUP BY ALL""",
)
def job_loop(spark, sf):
    """SM02, SM07, SM10, UX10, UX11, SNK25: a stream of jobs, worked batch by batch into three folders."""
    e = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("job_id"), F.lit("s").alias("sample_id"), F.col("event_type").alias("stage"), F.lit(0.0).alias("progress"), F.lit("").alias("message"),
        F.lit(0).alias("code"), (F.col("user_id") % 5).cast("int").alias("retries"), F.col("ts").cast("timestamp").alias("ts"),
    )
    base = shared_folder(spark, "jobs")
    e.write.parquet(f"{base}/in")
    live = jobs.file_events(spark, f"{base}/in", e.schema, 2)
    failed = F.col("stage") == "error"
    work = lambda b: b.withColumn("code", F.when(failed, 7).otherwise(0)).withColumn("message", F.when(failed, "Connection refused").otherwise("ok"))
    q = jobs.run_jobs(live, work, *(jobs.to_folder(f"{base}/{k}") for k in ("done", "retry", "dead")), f"{base}/checkpoint")
    q.processAllAvailable()
    q.stop()
    rows = [spark.read.parquet(f"{base}/{k}").agg(F.count("*").alias("n")).select(F.lit(k).alias("place"), "n") for k in ("done", "retry", "dead")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# streams with state


def _finish(q, seconds: int = 600) -> None:
    if not q.awaitTermination(seconds):
        q.stop()
        raise TimeoutError("the stream has not come to its end")


@query(
    "job_lives",
    """WITH u AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_type AS stage, value AS progress, ts FROM events),
    g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY job_id ORDER BY ts, stage) > 3600000000 AS new FROM u),
    l AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, stage ROWS UNBOUNDED PRECEDING) AS life FROM g),
    a AS (SELECT job_id, life, arg_max(stage, (ts, stage)) AS stage, count(*) AS updates, max(ts) AS last FROM l GROUP BY ALL)
    SELECT job_id, stage, updates, epoch_us(last) AS last_us FROM a
    WHERE life < (SELECT max(b.life) FROM l b WHERE b.job_id = a.job_id) OR epoch_ms(last) + 3600000 <= (SELECT max(epoch_ms(ts)) FROM events)""",
)
def job_lives(spark, sf):
    """SM05: a stream of updates in four slices of time: each life of a job, forgotten after an hour without an update, with its last state."""
    u = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("stage"), F.col("value").alias("progress"), F.lit("").alias("message"), F.col("ts").cast("timestamp").alias("ts"),
    )
    first, last = u.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    base, out, width = shared_folder(spark, "lives"), [], ((last or 0) - (first or 0)) // 4 + 1
    slices = u.withColumn("_slice", F.floor((F.unix_micros("ts") - F.lit(first or 0)) / width))
    for n in range(4):
        slices.where(F.col("_slice") == n).drop("_slice").write.parquet(f"{base}/in/n={n}")
        live = state.job_lives(jobs.file_events(spark, f"{base}/in", u.schema, 1_000_000))
        with state.rocks(spark):
            sink = lambda b, i: b.write.mode("overwrite").parquet(f"{base}/out/batch={i}")
            _finish(live.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start())
    out = spark.read.parquet(f"{base}/out")
    return out.select("job_id", "stage", "updates", F.unix_micros("ts").alias("last_us"))


@query(
    "stream_coverage",
    f"""WITH {_HITS}, s AS (SELECT gene_id, pos, sum(step) AS step FROM (SELECT gene_id, ref_start AS pos, 1 AS step FROM hits UNION ALL SELECT gene_id, ref_end, -1 FROM hits) GROUP BY ALL),
    d AS (SELECT gene_id, sum(step) OVER (PARTITION BY gene_id ORDER BY pos) AS depth, lead(pos) OVER (PARTITION BY gene_id ORDER BY pos) - pos AS width FROM s),
    c AS (SELECT gene_id, CAST(coalesce(sum(width) FILTER (depth > 0), 0) AS BIGINT) AS covered, CAST(coalesce(sum(depth * width), 0) AS BIGINT) AS bases, CAST(greatest(0, max(depth)) AS BIGINT) AS max_depth FROM d GROUP BY gene_id)
    SELECT c.*, n AS hits FROM c JOIN (SELECT gene_id, count(*) AS n FROM hits GROUP BY gene_id) h ON c.gene_id = h.gene_id""",
)
def stream_coverage(spark, sf):
    """SM06: hits that come in several batches: what each gene's coverage has grown to after the last."""
    h = hits(spark, sf).select("gene_id", "ref_start", "ref_end")
    base = shared_folder(spark, "growing")
    files = spark.sparkContext.defaultParallelism  # of each of three batches
    h.repartition(3 * files).write.parquet(f"{base}/in")
    live = state.growing_coverage(jobs.file_events(spark, f"{base}/in", h.schema, files))
    with state.rocks(spark):
        q = live.writeStream.outputMode("update").foreachBatch(jobs.to_folder(f"{base}/out")).option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start()
    _finish(q)
    values = F.struct("hits", "covered", "bases", "max_depth")
    return spark.read.parquet(f"{base}/out").groupBy("gene_id").agg(F.max_by(values, "batch").alias("s")).select("gene_id", "s.*")


@query(
    "retried_jobs",
    "SELECT CAST(event_id AS VARCHAR) AS job_id, CASE WHEN user_id % 5 < 4 THEN 'done' ELSE 'dead' END AS place, CAST(least(user_id % 5, 3) AS INTEGER) AS retries FROM events",
)
def retried_jobs(spark, sf):
    """SM03, SM04: jobs that fail up to four times, given back by timers until they succeed or have no try left."""
    e = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("job_id"), F.concat("event_type", F.lit(":"), F.col("user_id") % 5).alias("sample_id"), F.lit("run").alias("stage"),
        F.lit(0.0).alias("progress"), F.lit("").alias("message"), F.lit(0).alias("code"), F.lit(0).alias("retries"), F.col("ts").cast("timestamp").alias("ts"),
    )
    base = shared_folder(spark, "retries")
    e.write.parquet(f"{base}/in/n=0")
    failed = F.col("retries") < F.substring_index("sample_id", ":", -1).cast("int")
    work = lambda b: b.withColumn("code", F.when(failed, 7).otherwise(0)).withColumn("message", F.when(failed, "Connection refused").otherwise("ok"))
    sinks_ = [jobs.to_folder(f"{base}/{k}") for k in ("done", "retry", "dead")]
    total, many = e.count(), 1_000_000
    for turn in range(1, 20):
        live = jobs.file_events(spark, f"{base}/in", e.schema, many)
        _finish(jobs.run_jobs(live, work, *sinks_, f"{base}/c1", trigger={"availableNow": True}))
        ended = [spark.read.parquet(f"{base}/{k}").select("job_id", F.lit(k).alias("place"), "retries") for k in ("done", "dead")]
        if ended[0].count() + ended[1].count() >= total:
            return ended[0].unionByName(ended[1])
        waiting = spark.read.parquet(f"{base}/retry").drop("batch").schema
        with state.rocks(spark):
            back = state.due_again(jobs.file_events(spark, f"{base}/retry", waiting, many))
            sink = lambda b, i: b.write.mode("overwrite").parquet(f"{base}/in/n={i + 1}")
            _finish(back.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/c2").trigger(once=True).start())
    raise RuntimeError("jobs are still waiting")


@query("published_events", "SELECT event_id, user_id, event_type, value FROM events")
def published_events(spark, sf):
    """SNK24, SRC26: a stream published to a topic, its last batch once more after a crash, and read back: every event once."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    base = shared_folder(spark, "topic")
    e.repartition(3).write.parquet(f"{base}/in")
    send = lambda: _finish(topics.publish(jobs.file_events(spark, f"{base}/in", e.schema, 1), f"{base}/topic", "event_id", f"{base}/c", {"availableNow": True}))
    send()
    fs, commits = file_system(spark, f"{base}/c/commits")
    last = max((f.getPath() for f in fs.listStatus(commits) if f.getPath().getName().isdigit()), key=lambda p: int(p.getName()))
    fs.delete(last, False)  # as if the driver had died before it noted the batch
    send()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema.fields)
    return topics.consume(spark, f"{base}/topic", schema).drop("batch")


@query("fanned_out", "SELECT 'clicks' AS detector, count(*) AS n FROM events WHERE event_type = 'click' UNION ALL SELECT 'all', count(*) FROM events")
def fanned_out(spark, sf):
    """SM07, UX10: two detectors over the same batches, which are read once."""
    base = shared_folder(spark, "detectors")
    table(spark, sf, "events").select("event_id", "event_type").write.parquet(f"{base}/in")
    live = jobs.file_events(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema, 2)
    found = {"clicks": lambda b: b.where("event_type = 'click'"), "all": lambda b: b}
    q = jobs.fan_out(live, found, {k: jobs.to_folder(f"{base}/{k}") for k in found}, f"{base}/checkpoint")
    q.processAllAvailable()
    q.stop()
    rows = [spark.read.parquet(f"{base}/{k}").agg(F.count("*").alias("n")).select(F.lit(k).alias("detector"), "n") for k in found]
    return rows[0].unionByName(rows[1])


@query(
    "deep_lineages",
    "WITH RECURSIVE t AS (SELECT s_suppkey AS id, s_suppkey // 2 AS parent FROM supplier), up AS (SELECT id, id AS ancestor, 0 AS steps FROM t UNION ALL SELECT up.id, t.parent, steps + 1 FROM up JOIN t ON t.id = up.ancestor WHERE t.parent > 0) SELECT id, max(steps) AS depth, min(ancestor) AS root FROM up GROUP BY id",
)
def deep_lineages(spark, sf):
    """GR01, GR02: depths in a binary tree of suppliers."""
    t = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.floor(F.col("s_suppkey") / 2).cast("long").alias("parent"))
    tree = taxonomy.closure(t)
    return tree.groupBy("id").agg(F.max("steps").alias("depth"), F.min("ancestor").alias("root"))
