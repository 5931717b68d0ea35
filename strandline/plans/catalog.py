"""Driver queries for the library's operators over stand-in tables, each with its SQL.

Stand-ins: lineitem rows are alignment hits (order = read, part = gene), parts
are genes, region > nation > supplier/customer is a taxonomy, benchmark texts
are reference sequences and documents reads (letters become bases), events are
positions on a genome per user, return flags are alleles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import genes as G
from strandline.functions import scoring as S
from strandline.functions import sequence as Q
from strandline.operators import alleles, asof, classify, coverage, em, features, graph, kmers, minimizers, taxonomy
from strandline.storage import dealt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# stand-ins, in both languages


def hits(spark: SparkSession, sf: str) -> DataFrame:
    start = (F.col("l_suppkey") % 40).cast("int")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("read_id"), F.col("l_orderkey").alias("pair_id"), F.col("l_partkey").alias("gene_id"),
        (F.col("l_linenumber") % 2 == 0).alias("is_r2"), start.alias("ref_start"), (start + F.col("l_quantity").cast("int")).alias("ref_end"),
        (1 - F.col("l_discount")).alias("identity"), F.least(F.lit(1.0), F.col("l_quantity") / 50.0).alias("coverage"),
        (F.col("l_linenumber") - 3).alias("frame"), F.col("l_quantity").alias("score"), (F.col("l_suppkey") % 25).alias("taxon"),
    )


def genes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("gene_id"), (F.col("p_size") * 4 + 60).alias("length"), F.col("p_brand").alias("family"), F.col("p_type").alias("drug_class"),
        (1 + F.col("p_size") % 3 * 0.5).alias("prior"),
    )


_HITS = """hits AS (
  SELECT l_orderkey AS read_id, l_orderkey AS pair_id, l_partkey AS gene_id, l_linenumber % 2 = 0 AS is_r2, CAST(l_suppkey % 40 AS INTEGER) AS ref_start,
         CAST(l_suppkey % 40 AS INTEGER) + CAST(floor(l_quantity) AS INTEGER) AS ref_end, 1 - l_discount AS identity, least(1.0, l_quantity / 50.0) AS coverage,
         l_linenumber - 3 AS frame, l_quantity AS score, l_suppkey % 25 AS taxon
  FROM lineitem
), genes AS (
  SELECT p_partkey AS gene_id, p_size * 4 + 60 AS length, p_brand AS family, p_type AS drug_class, 1 + p_size % 3 * 0.5 AS prior FROM part
)"""


def taxa(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    row = lambda i, p, r, n: [i.cast("long").alias("id"), p.cast("long").alias("parent"), F.lit(r).alias("rank"), n.alias("name")]
    root = spark.range(1).select(*row(F.lit(1), F.lit(None), "root", F.lit("root")))
    region = t("region").select(*row(F.col("r_regionkey") + 1000, F.lit(1), "region", F.col("r_name")))
    nation = t("nation").select(*row(F.col("n_nationkey") + 2000, F.col("n_regionkey") + 1000, "nation", F.col("n_name")))
    supplier = t("supplier").select(*row(F.col("s_suppkey") + 100000, F.col("s_nationkey") + 2000, "supplier", F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))))
    return root.unionByName(region).unionByName(nation).unionByName(supplier)


_TAXA = """taxa AS (
  SELECT 1 AS id, NULL AS parent, 'root' AS rank, 'root' AS name
  UNION ALL SELECT r_regionkey + 1000, 1, 'region', r_name FROM region
  UNION ALL SELECT n_nationkey + 2000, n_regionkey + 1000, 'nation', n_name FROM nation
  UNION ALL SELECT s_suppkey + 100000, s_nationkey + 2000, 'supplier', 's' || s_suppkey FROM supplier
), tree AS (
  SELECT id, id AS ancestor, 0 AS steps FROM taxa
  UNION ALL SELECT id, parent, 1 FROM taxa WHERE parent IS NOT NULL
  UNION ALL SELECT a.id, b.parent, 2 FROM taxa a JOIN taxa b ON a.parent = b.id WHERE b.parent IS NOT NULL
  UNION ALL SELECT a.id, c.parent, 3 FROM taxa a JOIN taxa b ON a.parent = b.id JOIN taxa c ON b.parent = c.id WHERE c.parent IS NOT NULL
)"""

_DNA = "regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', '', 'g')"


def reference(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", Q.dna_of_text(F.col("text")).alias("seq"))


def reads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", Q.dna_of_text(F.col("text")).alias("seq"))


_REF = f"ref AS (SELECT item_id, {_DNA} AS seq FROM benchmark)"


def _kmers_sql(source: str, key: str, k: int) -> str:
    return f"SELECT {key}, i - 1 AS pos, substr(seq, i, {k}) AS kmer FROM (SELECT {key}, seq, unnest(range(1, length(seq) - {k - 2})) AS i FROM {source} WHERE length(seq) >= {k})"


# screens and k-mer joins


@query(
    "screen_shared_kmers",
    f"""WITH {_REF}, docs AS (SELECT doc_id, {_DNA} AS seq FROM documents),
    a AS (SELECT DISTINCT doc_id, kmer FROM ({_kmers_sql("docs", "doc_id", 31)})), b AS (SELECT DISTINCT item_id, kmer FROM ({_kmers_sql("ref", "item_id", 31)})),
    m AS (SELECT doc_id, item_id, count(*) AS shared FROM a JOIN b USING (kmer) GROUP BY ALL HAVING count(*) >= 3)
    SELECT doc_id, item_id, shared, rank() OVER (PARTITION BY doc_id ORDER BY shared DESC)::INTEGER AS place FROM m""",
)
def screen_shared_kmers(spark, sf):
    """FLT02, JN01, WN07: which reads hold which reference sequences, by shared 31-mers; the best has place 1."""
    from pyspark.sql import Window

    found = kmers.matches(reads(spark, sf), reference(spark, sf), 31, "doc_id", "item_id", least=3)
    return found.withColumn("place", F.rank().over(Window.partitionBy("doc_id").orderBy(F.desc("shared"))))


@query(
    "screen_reads",
    f"""WITH {_REF}, docs AS (SELECT doc_id, {_DNA} AS seq FROM documents),
    a AS (SELECT DISTINCT doc_id, kmer FROM ({_kmers_sql("docs", "doc_id", 31)})), b AS (SELECT DISTINCT kmer FROM ({_kmers_sql("ref", "item_id", 31)}))
    SELECT doc_id, count(*) AS found FROM a WHERE kmer IN (SELECT kmer FROM b) GROUP BY doc_id HAVING count(*) >= 3""",
)
def screen_reads(spark, sf):
    """FLT01-FLT03: reads with three reference k-mers, by semi-join."""
    return kmers.screen(reads(spark, sf), reference(spark, sf), 31, "doc_id")


@query("kmer_counts", f"WITH {_REF} SELECT kmer, count(*) AS n FROM ({_kmers_sql('ref', 'item_id', 8)}) GROUP BY kmer")
def kmer_counts(spark, sf):
    """AG41, FN08."""
    return kmers.counts(reference(spark, sf), "seq", 8)


@query(
    "kmer_specificity",
    f"WITH {_REF} SELECT kmer, count(DISTINCT item_id) AS n_item_id, count(DISTINCT item_id % 7) AS n_grp FROM ({_kmers_sql('ref', 'item_id', 12)}) GROUP BY kmer",
)
def kmer_specificity(spark, sf):
    """RM37."""
    index = Q.kmers(reference(spark, sf), "seq", 12).withColumn("grp", F.col("item_id") % 7)
    return kmers.specificity(index, "item_id", "grp")


@query(
    "kmer_frequent_removed",
    f"""WITH {_REF}, k AS ({_kmers_sql("ref", "item_id", 4)}), n AS (SELECT kmer, count(DISTINCT item_id) AS c FROM k GROUP BY kmer)
    SELECT kmer, count(*) AS n FROM k WHERE kmer IN (SELECT kmer FROM n WHERE c <= 0.75 * (SELECT count(DISTINCT item_id) FROM k)) GROUP BY kmer""",
)
def kmer_frequent_removed(spark, sf):
    """FLT14."""
    index = Q.kmers(reference(spark, sf), "seq", 4)
    return kmers.frequent_removed(index, "item_id").groupBy("kmer").agg(F.count("*").alias("n"))


@query(
    "kmer_both_strands",
    f"""WITH {_REF}, f AS ({_kmers_sql("ref", "item_id", 15)}),
    r AS (SELECT item_id, length(seq) AS n, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM ref),
    b AS (SELECT x.item_id, r.n - x.pos - 15 AS pos, kmer FROM ({_kmers_sql("r", "item_id", 15)}) x JOIN r USING (item_id))
    SELECT item_id, '+' AS strand, count(*) AS n, sum(pos)::BIGINT AS places, min(kmer) AS least FROM f GROUP BY 1
    UNION ALL SELECT item_id, '-', count(*), sum(pos)::BIGINT, min(kmer) FROM b GROUP BY 1""",
)
def kmer_both_strands(spark, sf):
    """FN09."""
    both = Q.kmers_both_strands(reference(spark, sf), "seq", 15)
    return both.groupBy("item_id", "strand").agg(F.count("*").alias("n"), F.sum("pos").alias("places"), F.min("kmer").alias("least"))


@query(
    "kmer_packed",
    f"""WITH {_REF}, k AS ({_kmers_sql("ref", "item_id", 12)}), p AS (
      SELECT item_id, kmer, reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc,
             CAST(list_sum(list_transform(range(1, 13), lambda i: (strpos('ACGT', substr(kmer, i, 1)) - 1) * pow(4, 12 - i))) AS BIGINT) AS code FROM k)
    SELECT item_id, sum(code)::BIGINT AS codes, min(least(kmer, rc)) AS low, max(least(kmer, rc)) AS high, count(DISTINCT least(kmer, rc)) AS n FROM p GROUP BY item_id""",
)
def kmer_packed(spark, sf):
    """FN04-FN07, FN10: packed codes (through packing, unpacking and turning twice) and canonical k-mers."""
    k = Q.kmers(reference(spark, sf), "seq", 12)
    code = Q.reverse_complement_packed(Q.reverse_complement_packed(Q.pack(F.col("kmer")), 12), 12)
    c = Q.canonical(Q.unpack(Q.pack(F.col("kmer")), 12))
    return k.groupBy("item_id").agg(F.sum(code).alias("codes"), F.min(c).alias("low"), F.max(c).alias("high"), F.count_distinct(c).alias("n"))


@query(
    "kmer_lost_by_mutation",
    f"""WITH {_REF}, m AS (SELECT item_id, substr(seq, 1, 49) || translate(substr(seq, 50, 1), 'ACGT', 'CGTA') || substr(seq, 51) AS seq FROM ref),
    a AS (SELECT DISTINCT item_id, kmer FROM ({_kmers_sql("ref", "item_id", 15)})), b AS (SELECT DISTINCT item_id, kmer FROM ({_kmers_sql("m", "item_id", 15)}))
    SELECT item_id, count(*) AS lost FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY item_id""",
)
def kmer_lost_by_mutation(spark, sf):
    """RM38: one base changed."""
    before = reference(spark, sf)
    s = F.col("seq")
    changed = F.concat(F.substring(s, 1, 49), F.translate(F.substring(s, 50, 1), "ACGT", "CGTA"), F.substring(s, F.lit(51), F.length(s)))
    return kmers.lost_kmers(before, before.withColumn("seq", changed), "item_id", 15)


# sequence functions


@query(
    "sequence_functions",
    f"""WITH {_REF} SELECT item_id, length(seq) AS n, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc,
    round(100.0 * length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq), 4) AS gc, regexp_matches(text, '[^ACGTacgt]') AS ambiguous,
    length(regexp_replace(translate(upper(text), 'X*-.', 'NNNN'), '[^ACGTN]', '', 'g')) AS cleaned,
    substr(seq, 31, 60) AS slice FROM ref JOIN benchmark USING (item_id)""",
)
def sequence_functions(spark, sf):
    """FN03, FN16, FN29, FN30, FN44."""
    b = table(spark, sf, "benchmark").withColumn("seq", Q.dna_of_text(F.col("text")))
    s = F.col("seq")
    return b.select(
        "item_id", F.length(s).cast("long").alias("n"), F.md5(Q.reverse_complement(s)).alias("rc"), F.round(Q.gc_percent(s), 4).alias("gc"),
        Q.is_ambiguous(F.col("text")).alias("ambiguous"), F.length(Q.clean(F.col("text"))).cast("long").alias("cleaned"), Q.residues_to_bases(s, 11, 30).alias("slice"),
    )


_PEPTIDES = f"""WITH {_REF}, turned AS (SELECT item_id, s, CASE s WHEN 1 THEN seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) END AS q FROM ref, (SELECT unnest([1, -1]) AS s)),
    fr AS (SELECT item_id, s * (f + 1) AS frame, array_to_string(list_transform(range(0, CAST(floor((length(q) - f) / 3) AS BIGINT)), lambda i:
      substr('{Q.AMINO_ACIDS}', 1 + 16 * (strpos('TCAG', substr(q, i * 3 + 1 + f, 1)) - 1) + 4 * (strpos('TCAG', substr(q, i * 3 + 2 + f, 1)) - 1) + strpos('TCAG', substr(q, i * 3 + 3 + f, 1)) - 1, 1)), '') AS p
      FROM turned, (SELECT unnest([0, 1, 2]) AS f))"""


@query(
    "six_frame_translation",
    _PEPTIDES
    + """, parts AS (SELECT item_id, frame, string_split(p, '*') AS ps FROM fr), e AS (SELECT item_id, frame, ps, unnest(range(1, len(ps) + 1)) AS i FROM parts)
    SELECT item_id, CAST(frame AS INTEGER) AS frame, CAST(coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x) + 1)), 0) AS INTEGER) AS start, ps[i] AS peptide FROM e WHERE length(ps[i]) >= 20""",
)
def six_frame_translation(spark, sf):
    """FN17, FN18, UX14."""
    return Q.six_frames(reference(spark, sf), "seq", 20)


@query("peptide_pileup", _PEPTIDES + """, r AS (SELECT item_id % 5 AS grp, p, unnest(range(1, length(p) + 1)) AS i FROM fr WHERE frame = 1)
    SELECT grp, CAST(i AS INTEGER) AS pos, substr(p, i, 1) AS residue, count(*) AS n FROM r WHERE substr(p, i, 1) NOT IN ('X', '*') GROUP BY ALL""")  # fmt: skip
def peptide_pileup(spark, sf):
    """AG05."""
    m = reference(spark, sf).select((F.col("item_id") % 5).alias("grp"), F.lit(0).alias("ref_start"), Q.translate_frame(F.col("seq"), 0).alias("peptide"))
    return alleles.pileup(m, ["grp"])


@query(
    "read_quality",
    "SELECT item_id, round(list_avg(list_transform(range(1, length(text) + 1), lambda i: ord(substr(text, i, 1)) - 33)), 4) AS quality, length(text) >= 100 AS long_enough FROM benchmark",
)
def read_quality(spark, sf):
    """FLT16."""
    return table(spark, sf, "benchmark").select("item_id", F.round(Q.mean_quality(F.col("text")), 4).alias("quality"), (F.length("text") >= 100).alias("long_enough"))


_NAMES = {
    "CTX-M-15": ("CTX-M", "15", 3.0), "blaTEM-1": ("TEM", "1", 2.5), "SHV-12": ("SHV", "12", 1.5), "blaOXA-48": ("OXA", "48", 1.8), "KPC-3": ("KPC", "3", 1.8),
    "qnrB4": ("qnrB", "4", 1.2), "qnrS2": ("qnrS", "2", 1.0), "aac(6')-Ib-cr": ("aac6-Ib-cr", "cr", 1.5), "tet(M)": ("tet(m)", "", 1.0), "vanA": ("vanA", "", 0.5),
    "mcr-1": ("mcr", "1", 0.8), "sul2": ("sul", "2", 1.0), "ermB": ("erm", "B", 0.9), "dfrA12": ("dfra", "12", 1.0), "cat-2": ("cat", "2", 1.0), "blaNDM-5": ("NDM", "5", 1.5),
}


@query(
    "gene_names",
    "WITH n(i, name, family, variant, prior) AS (VALUES "
    + ", ".join(f"({i}, '{n.replace(chr(39), chr(39) * 2)}', '{f}', '{v}', {p})" for i, (n, (f, v, p)) in enumerate(_NAMES.items()))
    + ") SELECT p_partkey AS gene_id, name, family, variant, CAST(prior AS DOUBLE) AS prior FROM part JOIN n ON p_partkey % 16 = i",
)
def gene_names(spark, sf):
    """FN22, FN23, FN25: family, variant and prior of gene names."""
    name = F.element_at(F.array(*(F.lit(n) for n in _NAMES)), (F.col("p_partkey") % 16 + 1).cast("int"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("gene_id"), name.alias("name"))
    n = F.col("name")
    return p.select("gene_id", "name", G.gene_family(n).alias("family"), G.gene_variant(n).alias("variant"), G.prior_weight(n).alias("prior"))


@query(
    "assignment_scores",
    f"""WITH {_HITS} SELECT gene_id, round(sum(identity * coverage * least(1.0, (ref_end - ref_start) / 50.0) * CASE WHEN is_r2 THEN 1.2 ELSE 1.0 END * CASE WHEN abs(frame) <= 3 THEN 1.0 ELSE 0.9 END), 4) AS score,
    count(*) FILTER (WHERE identity * (ref_end - ref_start) >= 30 AND identity >= 0.85 AND ref_end - ref_start >= 20) AS good FROM hits GROUP BY gene_id""",
)
def assignment_scores(spark, sf):
    """FN26, FLT07."""
    h = hits(spark, sf)
    n = F.col("ref_end") - F.col("ref_start")
    s = G.assignment_score(F.col("identity"), F.col("coverage"), n, F.col("is_r2"), F.col("frame"))
    good = coverage.is_good_hit(F.col("identity"), n)
    return h.groupBy("gene_id").agg(F.round(F.sum(s), 4).alias("score"), F.sum(good.cast("long")).alias("good"))


_CUTS = lambda c, cuts: " + ".join(f"CAST({c} >= {x} AS INTEGER)" for x in cuts)


@query(
    "feature_codes",
    f"""WITH t AS (SELECT l_discount * 10 AS x, l_tax * 12 AS y, CAST(l_quantity AS INTEGER) AS q FROM lineitem)
    SELECT {_CUTS("x", S.UNIQUENESS_CUTS)} AS u, {_CUTS("y", S.COOCCURRENCE_CUTS)} AS c, CAST(floor(least(greatest(x, 0.0), 1.0) * 65535) AS INTEGER) AS w, (q >> 2) & 7 AS bits, count(*) AS n FROM t GROUP BY ALL""",
)
def feature_codes(spark, sf):
    """FN32-FN35, RM09."""
    t = table(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("x"), (F.col("l_tax") * 12).alias("y"), F.col("l_quantity").cast("int").alias("q"))
    out = t.select(
        S.category(F.col("x"), S.UNIQUENESS_CUTS).alias("u"), S.category(F.col("y"), S.COOCCURRENCE_CUTS).alias("c"), S.encode_weight(F.col("x")).alias("w"),
        S.get_bits(S.set_bits(F.lit(0), S.get_bits(F.col("q"), 2, 3), 8, 3), 8, 3).alias("bits"),
    )
    return out.groupBy("u", "c", "w", "bits").agg(F.count("*").alias("n"))


# coverage and abundance


@query(
    "gene_coverage",
    f"""WITH {_HITS}, d AS (SELECT gene_id, p, count(*) AS depth FROM (SELECT gene_id, unnest(range(ref_start, ref_end)) AS p FROM hits) GROUP BY ALL),
    s AS (SELECT gene_id, length, count(*) AS covered, sum(depth) AS bases, sum(depth * depth) AS sq FROM d JOIN genes USING (gene_id) WHERE p < length GROUP BY ALL)
    SELECT gene_id, length, covered::BIGINT AS covered, bases::BIGINT AS bases, round(100.0 * covered / length, 4) AS percent_coverage, round(bases / length, 4) AS mean_coverage, round(bases / covered, 4) AS mean_depth,
    round(1 - sqrt(greatest(0.0, sq / length - (bases / length) * (bases / length))) / (bases / length + 1e-6), 4) AS uniformity FROM s""",
)
def gene_coverage(spark, sf):
    """AG01, AG02: by a sweep, not a row per position."""
    c = coverage.coverage(hits(spark, sf), genes(spark, sf))
    r = lambda x: F.round(x, 4).alias(x)
    return c.select("gene_id", "length", "covered", "bases", r("percent_coverage"), r("mean_coverage"), r("mean_depth"), r("uniformity"))


@query(
    "gene_abundance",
    f"""WITH {_HITS}, p AS (SELECT gene_id, length, count(*) AS reads FROM hits JOIN genes USING (gene_id) GROUP BY ALL)
    SELECT gene_id, reads, round(reads * 1e6 / (length * 3 / 1000.0 * (SELECT count(*) FROM hits)), 4) AS rpkm, round(reads / (length * 3 / 1000.0) / (SELECT sum(reads / (length * 3 / 1000.0)) FROM p) * 1e6, 4) AS tpm FROM p""",
)
def gene_abundance(spark, sf):
    """AG03, WN09."""
    h = hits(spark, sf)
    out = coverage.abundance(h, genes(spark, sf), h.count())
    return out.select("gene_id", "reads", F.round("rpkm", 4).alias("rpkm"), F.round("tpm", 4).alias("tpm"))


@query(
    "drug_class_summary",
    f"""WITH {_HITS} SELECT drug_class, count(DISTINCT read_id) AS reads, count(DISTINCT gene_id) AS genes, count(*) AS hits, round(avg(identity), 4) AS mean_identity, round(stddev_samp(identity), 4) AS sd_identity, max(identity) AS best_identity
    FROM hits JOIN genes USING (gene_id) GROUP BY drug_class""",
)
def drug_class_summary(spark, sf):
    """AG18, AG42, JN21."""
    out = coverage.summary(hits(spark, sf).join(genes(spark, sf), "gene_id"), ["drug_class"])
    return out.withColumn("mean_identity", F.round("mean_identity", 4)).withColumn("sd_identity", F.round("sd_identity", 4))


@query(
    "family_grouping_sets",
    f"WITH {_HITS} SELECT family, drug_class, count(*) AS n, sum(score) AS score, grouping(family, drug_class)::BIGINT AS level FROM hits JOIN genes USING (gene_id) GROUP BY ROLLUP (family, drug_class)",
)
def family_grouping_sets(spark, sf):
    """AG48, AG31: totals at every level."""
    h = hits(spark, sf).join(genes(spark, sf), "gene_id")
    return h.rollup("family", "drug_class").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.grouping_id().cast("long").alias("level"))


# pairs and expectation-maximisation


@query(
    "pair_concordance_scores",
    f"""WITH {_HITS}, b AS (SELECT pair_id, gene_id, count(DISTINCT is_r2) = 2 AS pb, sum(score) AS score, count(*) AS n FROM hits GROUP BY ALL)
    SELECT pb AS concordant, count(*) AS groups, sum(n)::BIGINT AS hits, round(sum(score * CASE WHEN pb THEN 2.0 ELSE 0.5 END), 2) AS pair_score FROM b GROUP BY pb""",
)
def pair_concordance_scores(spark, sf):
    """JN11, JN12."""
    c = em.concordance(hits(spark, sf)).groupBy("pair_id", "gene_id", "concordant").agg(F.count("*").alias("n"), F.sum("pair_score").alias("s"))
    return c.groupBy("concordant").agg(F.count("*").alias("groups"), F.sum("n").alias("hits"), F.round(F.sum("s"), 2).alias("pair_score"))


@query(
    "pair_join",
    f"""WITH {_HITS}, b AS (SELECT pair_id, gene_id, is_r2, max(score) AS s FROM hits GROUP BY ALL)
    SELECT coalesce(a.pair_id, c.pair_id) AS pair_id, coalesce(a.gene_id, c.gene_id) AS gene_id, a.s AS s1, c.s AS s2
    FROM (SELECT * FROM b WHERE NOT is_r2) a FULL JOIN (SELECT * FROM b WHERE is_r2) c ON a.pair_id = c.pair_id AND a.gene_id = c.gene_id""",
)
def pair_join(spark, sf):
    """JN10, JN13, ST07."""
    return em.pairs(hits(spark, sf)).select("pair_id", "gene_id", F.col("h1.score").alias("s1"), F.col("h2.score").alias("s2"))


@query(
    "fragment_model",
    f"""WITH {_HITS}, f AS (SELECT (ref_end - ref_start) * 3 AS length FROM hits WHERE ref_end > ref_start), a AS (SELECT avg(length) AS m, stddev_pop(length) AS s, count(*) AS n FROM f)
    SELECT round(avg(length), 4) AS mean, round(stddev_pop(length), 4) AS sd, any_value(n) AS n, count(*) AS kept FROM f, a WHERE abs(length - m) <= 2 * s""",
)
def fragment_model(spark, sf):
    """AG17, FN36."""
    lengths = hits(spark, sf).select(S.fragment_length(F.col("ref_start"), F.col("ref_end")).alias("length"))
    return em.fragment_model(lengths).select(F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "n", "kept")


@query(
    "fragment_probability",
    f"WITH {_HITS} SELECT ref_end - ref_start AS span, round(greatest(0.01, least(1.0, exp(-pow(((ref_end - ref_start) * 3 - 75) / 30.0, 2) / 2))), 6) AS p, count(*) AS n FROM hits GROUP BY ALL",
)
def fragment_probability(spark, sf):
    """FN37."""
    n = F.col("ref_end") - F.col("ref_start")
    return hits(spark, sf).select(n.alias("span"), F.round(S.fragment_probability(n * 3, F.lit(75.0), F.lit(30.0)), 6).alias("p")).groupBy("span", "p").agg(F.count("*").alias("n"))


def _em_round(i: int) -> str:
    return f"""w{i} AS (SELECT read_id, gene_id, score * abundance / (length + 1e-10) AS w FROM cand JOIN s{i - 1} USING (gene_id)),
    p{i} AS (SELECT gene_id, sum(w / t) AS reads FROM (SELECT *, sum(w) OVER (PARTITION BY read_id) AS t FROM w{i}) GROUP BY gene_id),
    s{i} AS (SELECT s.gene_id, length, prior, family, coalesce(p{i}.reads, 0) AS reads, (coalesce(p{i}.reads, 0) + 0.1 * prior) / (length / 1000.0) AS abundance FROM s{i - 1} s LEFT JOIN p{i} ON s.gene_id = p{i}.gene_id)"""


@query(
    "em_abundance",
    f"""WITH {_HITS}, cand AS (SELECT read_id, gene_id, max(score) AS score FROM hits GROUP BY ALL),
    s0 AS (SELECT gene_id, length, prior, family, 0.0 AS reads, 0.7 * prior + 0.3 * avg(prior) OVER (PARTITION BY family) AS abundance FROM genes), {_em_round(1)}, {_em_round(2)}, {_em_round(3)}
    SELECT gene_id, round(reads, 3) AS reads, round(abundance, 2) AS abundance FROM s3""",
)
def em_abundance(spark, sf):
    """AG09-AG11, AG14, AG15: three rounds."""
    candidates = hits(spark, sf).groupBy("read_id", "gene_id").agg(F.max("score").alias("score"))
    out = em.run(candidates, genes(spark, sf), rounds=3, tolerance=0)
    return out.select("gene_id", F.round("reads", 3).alias("reads"), F.round("abundance", 2).alias("abundance"))


@query(
    "em_family_rollup",
    f"""WITH {_HITS}, cand AS (SELECT read_id, gene_id, max(score) AS score FROM hits GROUP BY ALL),
    s0 AS (SELECT gene_id, length, prior, family, 0.0 AS reads, 0.7 * prior + 0.3 * avg(prior) OVER (PARTITION BY family) AS abundance FROM genes), {_em_round(1)}, {_em_round(2)}
    SELECT family, round(sum(reads), 2) AS reads, count(*) AS genes FROM s2 WHERE reads > 0.1 GROUP BY family""",
)
def em_family_rollup(spark, sf):
    """AG16."""
    candidates = hits(spark, sf).groupBy("read_id", "gene_id").agg(F.max("score").alias("score"))
    out = em.family_rollup(em.run(candidates, genes(spark, sf), rounds=2, tolerance=0))
    return out.select("family", F.round("reads", 2).alias("reads"), "genes")


_PAIRED = _em_round(1).replace("coalesce(reads, 0)", "2 * coalesce(reads, 0)").replace("coalesce(p1.reads, 0)", "2 * coalesce(p1.reads, 0)")


@query(
    "em_paired_abundance",
    f"""WITH {_HITS}, b AS (SELECT pair_id, gene_id, is_r2, max(struct_pack(s := score, a := ref_start, e := ref_end)) AS h FROM hits GROUP BY ALL),
    j AS (SELECT coalesce(x.pair_id, y.pair_id) AS read_id, coalesce(x.gene_id, y.gene_id) AS gene_id, x.h AS h1, y.h AS h2 FROM (SELECT * FROM b WHERE NOT is_r2) x FULL JOIN (SELECT * FROM b WHERE is_r2) y ON x.pair_id = y.pair_id AND x.gene_id = y.gene_id),
    cand AS (SELECT read_id, gene_id, (coalesce(h1.s, 0) + coalesce(h2.s, 0)) * CASE WHEN h1 IS NOT NULL AND h2 IS NOT NULL THEN 2.0 * CASE WHEN h2.e > h1.a THEN greatest(0.01, least(1.0, exp(-pow(((h2.e - h1.a) * 3 - 75) / 30.0, 2) / 2))) ELSE 0.01 END ELSE 0.5 END AS score FROM j),
    s0 AS (SELECT gene_id, length, prior, family, 0.0 AS reads, 0.7 * prior + 0.3 * avg(prior) OVER (PARTITION BY family) AS abundance FROM genes), {_PAIRED}
    SELECT gene_id, round(reads, 3) AS reads, round(abundance, 2) AS abundance FROM s1""",
)
def em_paired_abundance(spark, sf):
    """AG12, AG13: one round over pairs, each counting two reads."""
    out = em.run(em.pair_candidates(hits(spark, sf), 75.0, 30.0), genes(spark, sf), rounds=1, tolerance=0, reads_each=2.0)
    return out.select("gene_id", F.round("reads", 3).alias("reads"), F.round("abundance", 2).alias("abundance"))


# alleles


def _piled(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("pos"), F.col("l_returnflag").alias("residue")).agg(F.count("*").alias("n"))


def _known(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pos"), F.lit("N").alias("wild"), F.col("s_suppkey").alias("row"))
    return s.select("*", F.explode(F.when(F.col("pos") % 3 == 0, F.array(F.lit("A"), F.lit("R"))).otherwise(F.array(F.lit("A")))).alias("mutant"))


_PILE = """piled AS (SELECT l_suppkey AS pos, l_returnflag AS residue, count(*) AS n FROM lineitem GROUP BY ALL),
  dep AS (SELECT pos, sum(n) AS depth FROM piled GROUP BY pos)"""


@query(
    "allele_frequencies",
    f"""WITH {_PILE}, r AS (SELECT pos, residue, n, depth, residue <> 'N' AS mut, (residue = 'A' OR (residue = 'R' AND pos % 3 = 0)) AS res FROM piled JOIN dep USING (pos) JOIN supplier ON pos = s_suppkey)
    SELECT pos, 'N' AS wild, any_value(depth)::BIGINT AS depth, round(coalesce(sum(n) FILTER (WHERE NOT mut), 0) / any_value(depth), 6) AS wild_share,
    coalesce(first(residue ORDER BY n DESC, residue) FILTER (WHERE mut), 'X') AS dominant, round(coalesce(max(n) FILTER (WHERE mut), 0) / any_value(depth), 6) AS dominant_share,
    round(coalesce(sum(n) FILTER (WHERE res), 0) / any_value(depth), 6) AS resistant_share,
    coalesce(string_agg('N' || pos || residue || '(' || CAST(floor(100 * n / depth) AS BIGINT) || '%)', ',' ORDER BY residue) FILTER (WHERE mut AND n / depth >= 0.05), 'None') AS summary
    FROM r GROUP BY pos HAVING any_value(depth) >= 5""",
)
def allele_frequencies(spark, sf):
    """AG06, FLT09, FLT10, ST01."""
    known = alleles.wild_types(_known(spark, sf), ["pos"])
    out = alleles.frequencies(_piled(spark, sf), known, ["pos"])
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("pos", "wild", "depth", r("wild_share"), "dominant", r("dominant_share"), r("resistant_share"), "summary")


@query(
    "variant_calls",
    f"""WITH {_PILE} SELECT pos, residue, n, depth::BIGINT AS depth, round(n / depth, 6) AS share,
    round(greatest(0.0, n / depth - 1.96 * sqrt(n / depth * (1 - n / depth) / depth)) * (1 - exp(-depth / 100.0)), 6) AS confidence
    FROM piled JOIN dep USING (pos) JOIN supplier ON pos = s_suppkey WHERE depth >= 5 AND n / depth >= 0.1 AND (residue = 'A' OR (residue = 'R' AND pos % 3 = 0))""",
)
def variant_calls(spark, sf):
    """AG07, AG08, FN38."""
    out = alleles.calls(_piled(spark, sf), ["pos"], _known(spark, sf))
    return out.select("pos", "residue", "n", "depth", F.round("share", 6).alias("share"), F.round("confidence", 6).alias("confidence"))


@query("allele_shares", f"WITH {_PILE} SELECT pos, residue, round(n / depth, 6) AS share FROM piled JOIN dep USING (pos)")
def allele_shares(spark, sf):
    """RM29."""
    return alleles.shares(_piled(spark, sf), ["pos"]).select("pos", "residue", F.round("share", 6).alias("share"))


@query(
    "interpretation_ladder",
    """WITH c AS (SELECT o_custkey AS sample, count(*) FILTER (WHERE o_orderpriority LIKE '1%' AND o_totalprice > 300000) AS sure, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS known, count(*) FILTER (WHERE o_orderpriority LIKE '2%') AS qrdr FROM orders GROUP BY 1)
    SELECT sample, CASE WHEN known > 0 AND sure >= 2 THEN 'HIGH CONFIDENCE: Fluoroquinolone resistance detected' WHEN known > 0 AND sure = 1 THEN 'MODERATE CONFIDENCE: Fluoroquinolone resistance likely'
    WHEN known > 0 THEN 'LOW CONFIDENCE: Possible fluoroquinolone resistance' WHEN qrdr > 0 THEN 'QRDR mutations detected - resistance possible but not confirmed' ELSE 'No fluoroquinolone resistance markers detected' END AS verdict FROM c""",
)
def interpretation_ladder(spark, sf):
    """AG19, FLT11."""
    first = F.col("o_orderpriority").startswith("1")
    one = lambda c: F.sum(c.cast("int"))
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("sample")).agg(
        one(first & (F.col("o_totalprice") > 300000)).alias("sure"), one(first).alias("known"), one(F.col("o_orderpriority").startswith("2")).alias("qrdr")
    )
    return c.select("sample", alleles.interpretation(F.col("sure"), F.col("known"), F.col("qrdr"))["text"].alias("verdict"))


# classification


@query(
    "vote_classification",
    f"""WITH {_HITS}, v AS (SELECT read_id, taxon, count(*) AS votes FROM hits GROUP BY ALL)
    SELECT read_id, first(taxon ORDER BY votes DESC, taxon) AS taxon, max(votes) AS votes, count(*) AS taxa, round(max(votes) / sum(votes), 6) AS confidence FROM v GROUP BY read_id""",
)
def vote_classification(spark, sf):
    """AG20, RM27, JN14."""
    return classify.by_vote(hits(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@query(
    "paired_classification",
    f"""WITH {_HITS}, v AS (SELECT pair_id, taxon, count(DISTINCT is_r2) > 1 AS pb, count(*) * CASE WHEN count(DISTINCT is_r2) > 1 THEN 2.0 ELSE 1.0 END AS s FROM hits GROUP BY ALL)
    SELECT pair_id, first(taxon ORDER BY s DESC, taxon) AS taxon, max(s) AS score, first(pb ORDER BY s DESC, taxon) AS concordant, round(max(s) / sum(s), 6) AS confidence FROM v GROUP BY pair_id""",
)
def paired_classification(spark, sf):
    """AG21."""
    return classify.by_pair(hits(spark, sf), mate="is_r2").withColumn("confidence", F.round("confidence", 6))


@query(
    "two_stage_classification",
    f"""WITH {_HITS}, v AS (SELECT read_id, taxon, count(*) AS votes, count(DISTINCT gene_id) AS m FROM hits GROUP BY ALL),
    r AS (SELECT read_id, max(votes) AS best_votes, sum(votes) AS kmers, sum(m) AS minimizers, count(*) AS taxa FROM v GROUP BY read_id),
    s AS (SELECT *, best_votes / kmers AS p, CASE WHEN minimizers >= 3 THEN 1.0 ELSE 0.5 END AS d, CASE WHEN taxa <= 2 THEN 1.0 ELSE greatest(0.3, 1 - (taxa - 2) * 0.1) END AS sp FROM r)
    SELECT read_id, round(p, 6) AS primary, round(0.5 * p + 0.3 * d + 0.2 * sp, 6) AS secondary, (p >= 0.1 AND best_votes >= 2 AND minimizers >= 3) AS passed_1,
    (p >= 0.1 AND best_votes >= 2 AND minimizers >= 3 AND 0.5 * p + 0.3 * d + 0.2 * sp >= 0.3) AS passed_2 FROM s""",
)
def two_stage_classification(spark, sf):
    """AG22, AG23."""
    v = dealt(hits(spark, sf), "read_id").groupBy("read_id", "taxon").agg(F.count("*").alias("votes"), F.count_distinct("gene_id").alias("m"))
    r = v.groupBy("read_id").agg(F.max("votes").alias("best_votes"), F.sum("votes").alias("kmers"), F.sum("m").alias("minimizers"), F.count("*").alias("taxa"))
    out = classify.two_stage(r.withColumn("phylo_score", F.lit(1.0)), phylo=False, min_kmers=2)
    return out.select("read_id", F.round("primary", 6).alias("primary"), F.round("secondary", 6).alias("secondary"), "passed_1", "passed_2")


@query(
    "multi_map_genomes",
    f"""WITH {_HITS}, v AS (SELECT read_id, taxon, count(*) AS votes FROM hits GROUP BY ALL) SELECT read_id, taxon, votes FROM (SELECT *, max(votes) OVER (PARTITION BY read_id) AS b FROM v) WHERE votes >= 0.8 * b""",
)
def multi_map_genomes(spark, sf):
    """RM17, WN07."""
    return classify.within_best(hits(spark, sf))


@query(
    "pair_concordance_by_taxon",
    f"""WITH {_HITS}, b AS (SELECT DISTINCT pair_id, is_r2 AS mate, min(taxon) AS taxon FROM hits GROUP BY pair_id, is_r2), p AS (SELECT pair_id, count(DISTINCT taxon) AS t, count(DISTINCT mate) AS m, min(taxon) AS taxon FROM b GROUP BY pair_id)
    SELECT taxon, count(DISTINCT pair_id) AS pairs, coalesce(any_value(c), 0) AS concordant, round(coalesce(any_value(c), 0) / count(DISTINCT pair_id), 6) AS share FROM b LEFT JOIN (SELECT taxon, count(*) AS c FROM p WHERE m = 2 AND t = 1 GROUP BY taxon) USING (taxon) GROUP BY taxon""",
)
def pair_concordance_by_taxon(spark, sf):
    """AG30, RM24."""
    best = dealt(hits(spark, sf), "pair_id").groupBy("pair_id", F.col("is_r2").alias("mate")).agg(F.min("taxon").alias("taxon"))
    return classify.pair_concordance(best).withColumn("share", F.round("share", 6))


# taxonomy


@query("taxon_depths", f"WITH {_TAXA} SELECT id, max(steps) AS depth FROM tree GROUP BY id")
def taxon_depths(spark, sf):
    """GR01."""
    return taxonomy.depths(taxonomy.closure(taxa(spark, sf), 2))


@query(
    "taxon_lineages",
    f"WITH {_TAXA} SELECT tree.id, string_agg(name, '|' ORDER BY steps DESC) AS lineage FROM tree JOIN taxa ON taxa.id = ancestor GROUP BY tree.id",
)
def taxon_lineages(spark, sf):
    """GR08."""
    t = taxa(spark, sf)
    return taxonomy.lineages(t, taxonomy.closure(t, 2))


_LCA = f"""WITH {_TAXA}, pairs AS (SELECT DISTINCT a.s_suppkey + 100000 AS a, b.s_suppkey + 100000 AS b FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey * 7 % (SELECT count(*) FROM supplier) + 1),
    m AS (SELECT a, b, x.ancestor, x.steps AS sa, y.steps AS sb FROM pairs JOIN tree x ON x.id = a JOIN tree y ON y.id = b AND y.ancestor = x.ancestor)"""


def _supplier_pairs(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey")
    n = s.count()
    a = s.select(F.col("s_suppkey").alias("x"), (F.col("s_suppkey") * 7 % n + 1).alias("y"))
    b = s.select(F.col("s_suppkey").alias("y"))
    return a.join(b, "y").select((F.col("x") + 100000).alias("a"), (F.col("y") + 100000).alias("b")).distinct()


@query(
    "taxon_lca_pairs",
    _LCA + " SELECT a, b, first(ancestor ORDER BY sa) AS lca, round(least(1.0, (min(sa) + first(sb ORDER BY sa)) / 20.0), 4) AS distance FROM m GROUP BY a, b",
)
def taxon_lca_pairs(spark, sf):
    """GR02, GR04, GR06, GR07."""
    out = taxonomy.lca_pairs(_supplier_pairs(spark, sf), taxonomy.closure(taxa(spark, sf), 2))
    return out.select("a", "b", "lca", F.round(taxonomy.distance(F.col("up_a"), F.col("up_b")), 4).alias("distance"))


@query(
    "taxon_lca_groups",
    f"""WITH {_TAXA}, e AS (SELECT DISTINCT l_orderkey AS read_id, l_suppkey + 100000 AS taxon FROM lineitem), n AS (SELECT read_id, count(*) AS n_taxa FROM e GROUP BY 1),
    c AS (SELECT read_id, ancestor, count(*) AS k, min(steps) AS lo, max(steps) AS hi FROM e JOIN tree ON tree.id = taxon GROUP BY ALL)
    SELECT read_id, first(ancestor ORDER BY lo) AS lca, any_value(n_taxa) AS n_taxa, first(hi - lo ORDER BY lo) AS spread FROM c JOIN n USING (read_id) WHERE k = n_taxa GROUP BY read_id""",
)
def taxon_lca_groups(spark, sf):
    """AG32, AG40, RM04."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("read_id"), (F.col("l_suppkey") + 100000).alias("taxon"))
    return taxonomy.lca_groups(rows, taxonomy.closure(taxa(spark, sf), 2), "read_id", "taxon")


def _taxon_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") + 100000).alias("id")).agg(F.count("*").alias("n"))


_COUNTS = "counts AS (SELECT l_suppkey + 100000 AS id, count(*) AS n FROM lineitem GROUP BY 1)"


@query("nation_rollup", f"WITH {_TAXA}, {_COUNTS} SELECT ancestor AS id, name, sum(n)::BIGINT AS n FROM counts JOIN tree USING (id) JOIN taxa ON taxa.id = ancestor WHERE rank = 'nation' GROUP BY ALL")
def nation_rollup(spark, sf):
    """GR09, SNK16, AG27."""
    t = taxa(spark, sf)
    return taxonomy.rollup(_taxon_counts(spark, sf), t, taxonomy.closure(t, 2), "nation")


@query(
    "lineage_abundance",
    f"""WITH {_TAXA}, {_COUNTS}, l AS (SELECT tree.id, string_agg(name, '|' ORDER BY steps DESC) AS lineage FROM tree JOIN taxa ON taxa.id = ancestor GROUP BY tree.id)
    SELECT ancestor AS id, any_value(lineage) AS lineage, sum(n)::BIGINT AS n, round(100.0 * sum(n) / (SELECT sum(n) FROM counts), 6) AS percent FROM counts JOIN tree USING (id) JOIN l ON l.id = ancestor GROUP BY ancestor""",
)
def lineage_abundance(spark, sf):
    """SNK15."""
    t = taxa(spark, sf)
    return taxonomy.lineage_abundance(_taxon_counts(spark, sf), t, taxonomy.closure(t, 2)).withColumn("percent", F.round("percent", 6))


@query(
    "diversity",
    f"""WITH {_COUNTS}, t AS (SELECT sum(n) AS t FROM counts) SELECT count(*) AS richness, round(-sum(n / t * log2(n / t)), 6) AS shannon, round(1 - sum(n / t * (n / t)), 6) AS simpson,
    round(-sum(n / t * ln(n / t)) / ln(count(*)), 6) AS pielou, round(max(n / t), 6) AS berger_parker FROM counts, t""",
)
def diversity(spark, sf):
    """AG28, RM34, SNK17."""
    d = taxonomy.diversity(_taxon_counts(spark, sf))
    return d.select("richness", *(F.round(c, 6).alias(c) for c in ("shannon", "simpson", "pielou", "berger_parker")))


@query(
    "cumulative_abundance",
    f"WITH {_TAXA}, {_COUNTS}, r AS (SELECT ancestor AS id, sum(n) AS n FROM counts JOIN tree USING (id) JOIN taxa ON taxa.id = ancestor WHERE rank = 'nation' GROUP BY 1) SELECT id, n::BIGINT AS n, round(sum(n) OVER (ORDER BY n DESC, id ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS share FROM r",
)
def cumulative_abundance(spark, sf):
    """RM35, ST03."""
    t = taxa(spark, sf)
    r = taxonomy.rollup(_taxon_counts(spark, sf), t, taxonomy.closure(t, 2), "nation").select("id", "n")
    return taxonomy.cumulative(r, "id").withColumn("share", F.round("share", 6))


@query(
    "phylogenetic_consistency",
    f"""WITH {_TAXA}, v AS (SELECT l_orderkey AS read_id, l_suppkey + 100000 AS taxon, count(*) AS votes FROM lineitem GROUP BY ALL), b AS (SELECT read_id, first(taxon ORDER BY votes DESC, taxon) AS best FROM v GROUP BY read_id),
    m AS (SELECT read_id, best, taxon, votes, min(x.steps) AS sa, first(y.steps ORDER BY x.steps) AS sb FROM v JOIN b USING (read_id) JOIN tree x ON x.id = best JOIN tree y ON y.id = taxon AND y.ancestor = x.ancestor GROUP BY ALL)
    SELECT read_id, best, round(sum(exp(-2.0 * least(1.0, (sa + sb) / 20.0)) * votes) / sum(votes), 6) AS exponential, round(sum((1 - least(1.0, (sa + sb) / 20.0)) * votes) / sum(votes), 6) AS linear FROM m GROUP BY ALL""",
)
def phylogenetic_consistency(spark, sf):
    """AG25, AG26."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("read_id"), (F.col("l_suppkey") + 100000).alias("taxon"))
    v = dealt(rows, "read_id").groupBy("read_id", "taxon").agg(F.count("*").alias("votes"))
    out = taxonomy.consistency(v, taxonomy.closure(taxa(spark, sf), 2))
    return out.select("read_id", "best", F.round("exponential", 6).alias("exponential"), F.round("linear", 6).alias("linear"))


# minimizers


def _canonical(spark, sf):
    k = Q.kmers(reference(spark, sf), "seq", 15)
    return k.withColumn("h", Q.canonical(F.col("kmer")))


_CK = f"{_REF}, k AS (SELECT item_id, pos, kmer, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS h FROM ({_kmers_sql('ref', 'item_id', 15)}))"


@query(
    "minimizer_changes",
    f"""WITH {_CK}, w AS (SELECT item_id, pos, min(struct_pack(h := h, p := pos, q := kmer)) OVER win AS m, row_number() OVER o AS i, lead(pos) OVER o IS NULL AS fin FROM k
      WINDOW win AS (PARTITION BY item_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), o AS (PARTITION BY item_id ORDER BY pos)),
    f AS (SELECT item_id, pos, m, lag(m.p) OVER (PARTITION BY item_id ORDER BY pos) AS was FROM w WHERE i >= 10 OR fin) SELECT item_id, m.p AS pos, m.q AS kmer FROM f WHERE was IS NULL OR was <> m.p""",
)
def minimizer_changes(spark, sf):
    """WN01, WN03, WN06, RM15."""
    return minimizers.changes(_canonical(spark, sf), "item_id", 10).select("item_id", F.col("pos").cast("long").alias("pos"), "kmer")


@query(
    "minimizer_per_window",
    f"""WITH {_CK}, w AS (SELECT item_id, pos AS win, min(struct_pack(h := h, p := pos, q := kmer)) OVER x AS m, count(*) OVER x AS n FROM k WINDOW x AS (PARTITION BY item_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
    SELECT item_id, win AS "window", m.p AS pos, m.q AS kmer FROM w WHERE n = 10""",
)
def minimizer_per_window(spark, sf):
    """WN02."""
    out = minimizers.per_window(_canonical(spark, sf), "item_id", 10)
    return out.select("item_id", F.col("window").cast("long").alias("window"), F.col("pos").cast("long").alias("pos"), "kmer")


@query(
    "minimizer_local_minima",
    f"""WITH {_CK} SELECT item_id, pos, kmer FROM (SELECT *, min(h) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m FROM k) WHERE h = m""",
)
def minimizer_local_minima(spark, sf):
    """WN05."""
    return minimizers.local_minima(_canonical(spark, sf), "item_id").select("item_id", F.col("pos").cast("long").alias("pos"), "kmer")


@query(
    "minimizer_of_kmer",
    f"""WITH {_CK} SELECT m, count(*) AS n FROM (SELECT list_min(list_transform(range(1, 9), lambda i: substr(kmer, i, 8))) AS m FROM k) GROUP BY m""",
)
def minimizer_of_kmer(spark, sf):
    """WN04, RM16, RM22."""
    return _canonical(spark, sf).select(minimizers.of_kmer(F.col("kmer"), 8, 15).alias("m")).groupBy("m").agg(F.count("*").alias("n"))


# features


@query(
    "minimizer_uniqueness",
    f"""WITH {_REF}, k AS ({_kmers_sql("ref", "item_id", 6)}), u AS (SELECT kmer, count(*) AS n, count(DISTINCT item_id) AS owners, count(DISTINCT item_id) / (SELECT count(DISTINCT item_id) FROM k) AS f FROM k GROUP BY kmer)
    SELECT kmer, n, owners, round(CASE WHEN f > 0.5 THEN (1 - f) * (1 - f) ELSE 1 - f END, 6) AS uniqueness, n <= 3 AS rare, f > 0.5 AS common, f > 0.8 AS universal FROM u""",
)
def minimizer_uniqueness(spark, sf):
    """AG33, RM18, RM20, FLT12."""
    u = features.uniqueness(Q.kmers(reference(spark, sf), "seq", 6), owner="item_id")
    return u.select("kmer", "n", "owners", F.round("uniqueness", 6).alias("uniqueness"), "rare", "common", "universal")


@query(
    "minimizer_features",
    f"""WITH {_REF}, k AS (SELECT *, item_id % 9 AS taxon FROM ({_kmers_sql("ref", "item_id", 5)})), a AS (SELECT kmer, count(*) AS n, count(DISTINCT item_id) AS owners, count(DISTINCT taxon) AS taxa, avg(pos) AS mean_pos, stddev_samp(pos) AS sd_pos FROM k GROUP BY kmer),
    e AS (SELECT kmer, taxon, count(*) AS c FROM k GROUP BY ALL)
    SELECT a.kmer, any_value(n) AS n, any_value(owners) AS owners, any_value(taxa) AS taxa, round(any_value(mean_pos), 4) AS mean_pos, round(any_value(sd_pos), 4) AS sd_pos, round(abs(sum(c / n * log2(c / n))), 6) AS entropy FROM a JOIN e ON a.kmer = e.kmer GROUP BY a.kmer""",
)
def minimizer_features(spark, sf):
    """AG36, AG38, RM06."""
    t = features.feature_table(Q.kmers(reference(spark, sf), "seq", 5).withColumn("taxon", F.col("item_id") % 9), owner="item_id")
    return t.select("kmer", "n", "owners", "taxa", F.round("mean_pos", 4).alias("mean_pos"), F.round("sd_pos", 4).alias("sd_pos"), F.round(F.abs("entropy"), 6).alias("entropy"))


def _positions(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("genome_id"), F.unix_timestamp("ts").alias("pos"), F.col("event_type").alias("kmer"))


_POS = "ev AS (SELECT user_id AS genome_id, CAST(floor(epoch(ts)) AS BIGINT) AS pos, event_type AS kmer FROM events)"


@query(
    "cooccurrence",
    f"""WITH {_POS} SELECT x.kmer AS a, y.kmer AS b, count(*) AS n, round(sum(exp(-2.0 * (y.pos - x.pos) / 3600)), 4) AS weight FROM ev x JOIN ev y ON x.genome_id = y.genome_id AND y.pos > x.pos AND y.pos - x.pos <= 3600 AND x.kmer <> y.kmer GROUP BY ALL""",
)
def cooccurrence(spark, sf):
    """JN18, AG35, RM05."""
    return features.cooccurrence(_positions(spark, sf), "genome_id", 3600).withColumn("weight", F.round("weight", 4))


@query(
    "look_ahead_neighbours",
    f"""WITH {_POS}, s AS (SELECT x.kmer AS a, y.kmer AS b, sum(1.0 / (1 + y.pos - x.pos)) AS weight FROM ev x JOIN ev y ON x.genome_id = y.genome_id AND y.pos > x.pos AND y.pos - x.pos <= 3600 GROUP BY ALL)
    SELECT a, b, round(weight, 4) AS weight, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(weight, 9) DESC, b) AS rank FROM s) WHERE rank <= 3""",
)
def look_ahead_neighbours(spark, sf):
    """JN19, ST05, RM07."""
    return features.look_ahead(_positions(spark, sf), "genome_id", 3600, 3).withColumn("weight", F.round("weight", 4))


@query(
    "clustered_positions",
    f"WITH {_POS}, c AS (SELECT *, count(*) OVER (PARTITION BY genome_id ORDER BY pos RANGE BETWEEN 3600 PRECEDING AND 3600 FOLLOWING) - 1 AS near FROM ev) SELECT genome_id, sum(near)::BIGINT AS near, count(*) FILTER (WHERE near > 3) AS clustered FROM c GROUP BY genome_id",
)
def clustered_positions(spark, sf):
    """AG39, AG37, WN10."""
    c = features.clustered(_positions(spark, sf), window=3600)
    return c.groupBy("genome_id").agg(F.sum("near").alias("near"), F.sum(F.col("clustered").cast("long")).alias("clustered"))


@query(
    "merged_counts",
    "SELECT kmer, count(*) AS n FROM (SELECT event_type AS kmer FROM events WHERE user_id % 2 = 0 UNION ALL SELECT event_type FROM events WHERE user_id % 2 <> 0) GROUP BY kmer",
)
def merged_counts(spark, sf):
    """ST08: counts of two halves as one table."""
    e = table(spark, sf, "events").withColumnRenamed("event_type", "kmer")
    part = lambda c: e.where(c).groupBy("kmer").agg(F.count("*").alias("n"))
    return features.merged(part("user_id % 2 = 0"), part("user_id % 2 <> 0"))


@query(
    "contamination_marks",
    "SELECT l_orderkey AS read_id, least(7, CASE WHEN l_returnflag = 'R' THEN 4 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 3 ELSE 0 END + CASE WHEN l_tax < 0.02 THEN 2 ELSE 0 END + CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) AS score, count(*) AS n FROM lineitem GROUP BY ALL",
)
def contamination_marks(spark, sf):
    """FLT15, FLT13, RM08."""
    c = S.contamination(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_tax") < 0.02, F.col("l_discount") > 0.08)
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("read_id"), c.alias("score")).groupBy("read_id", "score").agg(F.count("*").alias("n"))


# graph


def _edges(spark, sf):
    t = lambda n: table(spark, sf, n)
    a = t("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.lit("carries").alias("type"), (F.col("n_nationkey") % 5 + 1.0).alias("weight"))
    b = t("supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"), F.lit("contains").alias("type"), (F.col("s_suppkey") % 4 + 1.0).alias("weight"))
    c = t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("d"), F.col("s_suppkey") % 6).alias("dst"), F.lit("confers").alias("type"), F.lit(2.0).alias("weight"))
    return a.unionByName(b).unionByName(c)


_EDGES = """a AS (SELECT n_regionkey AS r, n_nationkey AS n, n_nationkey % 5 + 1.0 AS w1 FROM nation), b AS (SELECT s_nationkey AS n, s_suppkey AS s, s_suppkey % 4 + 1.0 AS w2, s_suppkey % 6 AS d FROM supplier)"""


@query("resistance_score", f"WITH {_EDGES} SELECT 'r' || r AS organism, 'd' || d AS drug, CAST(sum(w1 + w2 + 2.0) AS DOUBLE) AS score FROM a JOIN b USING (n) GROUP BY ALL")
def resistance_score(spark, sf):
    """AG44, GR11."""
    return graph.score(_edges(spark, sf))


@query(
    "resistance_risk",
    f"WITH {_EDGES}, m AS (SELECT 'r' || r AS organism, 'd' || d AS drug, max(w1 + w2) AS level FROM a JOIN b USING (n) GROUP BY ALL) SELECT organism, drug, CAST(level AS DOUBLE) AS level, CASE WHEN level >= 8 THEN 'high' WHEN level >= 4 THEN 'moderate' ELSE 'low' END AS risk FROM m",
)
def resistance_risk(spark, sf):
    """AG45."""
    e = _edges(spark, sf)
    of = lambda t, x, y, w: e.where(F.col("type") == t).select(F.col("src").alias(x), F.col("dst").alias(y), F.col("weight").alias(w))
    chain = of("carries", "organism", "g", "w1").join(of("contains", "g", "m", "w2"), "g").join(of("confers", "m", "drug", "w3"), "m")
    out = chain.groupBy("organism", "drug").agg(F.max(F.col("w1") + F.col("w2")).alias("level"))
    return out.withColumn("risk", graph.risk(F.col("level")))


@query(
    "resistance_paths",
    f"""WITH {_EDGES}, p AS (SELECT 'r' || r AS start, 'd' || d AS node, min('r' || r || '>n' || n || '>s' || s || '>d' || d) AS path FROM a JOIN b USING (n) GROUP BY ALL) SELECT start, node, 3 AS steps FROM p""",
)
def resistance_paths(spark, sf):
    """GR12: shortest paths from regions to drugs."""
    e = _edges(spark, sf)
    sources = e.where("type = 'carries'").select(F.col("src").alias("id")).distinct()
    found = graph.shortest(e, sources)
    return found.where(F.col("node").startswith("d")).select("start", "node", "steps")


@query(
    "attributed_genes",
    f"""WITH {_HITS}, s AS (SELECT gene_id AS gene, taxon AS organism, max(coverage * identity * 0.95 * 0.9) AS score FROM hits GROUP BY ALL) SELECT gene, organism, round(score, 6) AS score FROM s WHERE score > 0.5""",
)
def attributed_genes(spark, sf):
    """GR15, GR16."""
    ev = hits(spark, sf).select(F.col("gene_id").alias("gene"), F.col("taxon").alias("organism"), "coverage", "identity", F.lit(0.95).alias("kmer_weight"))
    return graph.attribution(ev).withColumn("score", F.round("score", 6))


@query(
    "graph_components",
    "SELECT 'n' || n_nationkey AS id, 'n' || min(n_nationkey) OVER (PARTITION BY n_regionkey) AS component FROM nation UNION ALL SELECT 'r' || n_regionkey, 'n' || min(n_nationkey) FROM nation GROUP BY n_regionkey",
)
def graph_components(spark, sf):
    """GR14: nations and regions; the least label is compared as a number first."""
    n = table(spark, sf, "nation")
    got = graph.labels(n.select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 1000).cast("long").alias("dst")))
    name = lambda c: F.when(c >= 1000, F.concat(F.lit("r"), (c - 1000).cast("string"))).otherwise(F.concat(F.lit("n"), c.cast("string")))
    return got.select(name(F.col("id")).alias("id"), name(F.col("component")).alias("component"))


@query(
    "pssm_information",
    f"""WITH {_REF}, w AS ({_kmers_sql("ref", "item_id", 21)}), e AS (SELECT i - 1 AS pos, substr(kmer, i, 1) AS base FROM (SELECT kmer, unnest(range(1, 22)) AS i FROM w)),
    g AS (SELECT pos, b AS base, count(base) FILTER (WHERE base = b) + 1.0 AS n FROM e, (SELECT unnest(['A', 'C', 'G', 'T']) AS b) GROUP BY ALL), f AS (SELECT pos, n / sum(n) OVER (PARTITION BY pos) AS f FROM g)
    SELECT CAST(pos AS INTEGER) AS pos, round(2 + sum(f * log2(f)), 6) AS bits FROM f GROUP BY pos""",
)
def pssm_information(spark, sf):
    """FN40, FN41 over every 21-base window of the whole sequences."""
    w = Q.kmers(reference(spark, sf), "seq", 21).select(F.col("kmer").alias("seq"))
    return graph.information(graph.pssm(w)).select("pos", F.round("bits", 6).alias("bits"))


# jobs, sets and joins


@query(
    "error_classes",
    """WITH e AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'Connection refused by peer' WHEN 'click' THEN 'Corrupted file: timeout' WHEN 'view' THEN 'odd' ELSE 'nothing' END AS msg, CAST(event_id % 4 AS INTEGER) AS code FROM events)
    SELECT event_id, CASE WHEN lower(msg) LIKE '%corrupted file%' THEN 'permanent' WHEN lower(msg) LIKE '%connection refused%' OR lower(msg) LIKE '%timeout%' THEN 'transient' WHEN code IN (1, 2) THEN 'permanent' ELSE 'unknown' END AS kind FROM e""",
)
def error_classes(spark, sf):
    """FLT19."""
    t = F.col("event_type")
    msg = F.when(t == "error", "Connection refused by peer").when(t == "click", "Corrupted file: timeout").when(t == "view", "odd").otherwise("nothing")
    return table(spark, sf, "events").select("event_id", S.error_class(msg, (F.col("event_id") % 4).cast("int")).alias("kind"))


@query("retry_delays", "SELECT event_id, 60 * pow(2, event_id % 4) * (1.1 + 0.2 * ((event_id % 10) / 10.0)) AS delay FROM events")
def retry_delays(spark, sf):
    """SM03."""
    return table(spark, sf, "events").select("event_id", S.retry_delay(F.col("event_id") % 4, (F.col("event_id") % 10) / 10.0).alias("delay"))


@query(
    "latest_status",
    "SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS ts, count(*) AS updates FROM events GROUP BY user_id",
)
def latest_status(spark, sf):
    """SM05: the latest update of each job."""
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"), F.count("*").alias("updates"))


@query(
    "set_operations",
    "SELECT 'both' AS kind, count(*) AS n FROM (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_tax > 0.07) UNION ALL SELECT 'first', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')",
)
def set_operations(spark, sf):
    """ST07, ST09, ST12."""
    t = table(spark, sf, "lineitem")
    both = t.where("l_returnflag = 'R'").select("l_suppkey").intersect(t.where("l_tax > 0.07").select("l_suppkey"))
    first = t.where("l_returnflag = 'R'").select("l_partkey").subtract(t.where("l_returnflag = 'A'").select("l_partkey"))
    n = lambda d, k: d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return n(both, "both").unionByName(n(first, "first"))


@query(
    "position_containment",
    f"WITH {_HITS} SELECT gene_id, count(*) AS inside FROM hits JOIN genes USING (gene_id) WHERE ref_start >= length / 10 AND ref_end <= length / 2 GROUP BY gene_id",
)
def position_containment(spark, sf):
    """JN20, JN09."""
    regions = genes(spark, sf).select("gene_id", (F.col("length") / 10).alias("lo"), (F.col("length") / 2).alias("hi"))
    h = hits(spark, sf).select("gene_id", F.col("ref_start").alias("start"), F.col("ref_end").alias("end"))
    return classify.contained(h, regions, "gene_id").groupBy("gene_id").agg(F.count("*").alias("inside"))


@query(
    "as_of_join",
    """SELECT o.o_orderkey AS order_id, (SELECT max(ts) FROM events e WHERE e.user_id = o.o_custkey % 50 AND e.ts <= TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (o.o_orderkey % 20000)) AS seen FROM orders o""",
)
def as_of_join(spark, sf):
    """JN24: the last event of a user before each order's moment."""
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + (F.col("o_orderkey") % 20000) * 60)
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("user_id"), at.alias("at"), F.col("o_orderkey").alias("order_id"))
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), F.col("ts").cast("timestamp").alias("seen"))
    return asof.last_before(o, e, "user_id", "at", "seen").select("order_id", "seen")


@query("cascade_screen", """SELECT o_custkey AS id, round(least(1.0, 0.1 + CASE WHEN max(CAST(c_custkey IS NOT NULL AS INTEGER)) = 1 THEN 0.2 ELSE 0 END + CASE WHEN o_custkey IN (SELECT s_suppkey FROM supplier) THEN 0.3 ELSE 0 END), 4) AS confidence
    FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) ON o_custkey = c_custkey GROUP BY o_custkey""")  # fmt: skip
def cascade_screen(spark, sf):
    """FLT05."""
    keys = table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct()
    one = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    two = table(spark, sf, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("id"))
    three = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return classify.cascade(keys, (one, "id", 0.1), (two, "id", 0.2), (three, "id", 0.3)).withColumn("confidence", F.round("confidence", 4))


# statistics, top-k, streams and programs


@query(
    "index_quality",
    f"WITH {_REF}, k AS ({_kmers_sql('ref', 'item_id', 15)}), c AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer) SELECT sum(n)::BIGINT AS entries, count(*) AS distinct_kmers, max(n) AS most, count(*) FILTER (WHERE n = 1) AS single, count(*) FILTER (WHERE regexp_matches(kmer, '[^ACGT]')) AS invalid FROM c",
)
def index_quality(spark, sf):
    """RM40: distribution and integrity of a k-mer index."""
    c = kmers.counts(reference(spark, sf), "seq", 15)
    one = lambda x: F.sum(x.cast("long"))
    return c.agg(
        F.sum("n").alias("entries"), F.count("*").alias("distinct_kmers"), F.max("n").alias("most"), one(F.col("n") == 1).alias("single"), one(~Q.is_dna(F.col("kmer"))).alias("invalid")
    )


@query(
    "minimizer_stats",
    f"WITH {_CK}, m AS (SELECT * FROM (SELECT *, min(h) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS x FROM k) WHERE h = x) SELECT count(*) AS total, count(DISTINCT kmer) AS distinct_minimizers, round(count(*) / count(DISTINCT item_id), 4) AS per_read FROM m",
)
def minimizer_stats(spark, sf):
    """AG43."""
    m = minimizers.local_minima(_canonical(spark, sf), "item_id")
    return m.agg(F.count("*").alias("total"), F.count_distinct("kmer").alias("distinct_minimizers"), F.round(F.count("*") / F.count_distinct("item_id"), 4).alias("per_read"))


@query("top_kmers", f"WITH {_REF} SELECT kmer, count(*) AS n FROM ({_kmers_sql('ref', 'item_id', 6)}) GROUP BY kmer ORDER BY n DESC, kmer LIMIT 20")
def top_kmers(spark, sf):
    """ST03, ST04: a top-k report."""
    return kmers.counts(reference(spark, sf), "seq", 6).orderBy(F.desc("n"), "kmer").limit(20)


@query(
    "uniqueness_buckets",
    f"WITH {_REF}, k AS ({_kmers_sql('ref', 'item_id', 6)}), u AS (SELECT kmer, count(DISTINCT item_id) / (SELECT count(DISTINCT item_id) FROM k) AS f FROM k GROUP BY kmer) SELECT CASE WHEN f <= 0.01 THEN 255 WHEN f <= 0.05 THEN 200 WHEN f <= 0.2 THEN 150 WHEN f <= 0.5 THEN 100 ELSE 50 END AS score, count(*) AS n FROM u GROUP BY 1",
)
def uniqueness_buckets(spark, sf):
    """AG34."""
    k = Q.kmers(reference(spark, sf), "seq", 6)
    total = k.select("item_id").distinct().count()
    u = k.groupBy("kmer").agg((F.count_distinct("item_id") / total).alias("f"))
    return u.groupBy(features.bucket_score(F.col("f")).alias("score")).agg(F.count("*").alias("n"))


@query(
    "kmer_complexity",
    f"WITH {_REF}, k AS ({_kmers_sql('ref', 'item_id', 15)}) SELECT item_id, sum(list_sum(list_transform(range(1, 15), lambda i: CASE WHEN substr(kmer, i, 1) <> substr(kmer, i + 1, 1) THEN 1 ELSE 0 END)))::BIGINT AS transitions, count(*) FILTER (WHERE regexp_matches(kmer, 'A{{5}}|C{{5}}|G{{5}}|T{{5}}')) AS runs FROM k GROUP BY item_id",
)
def kmer_complexity(spark, sf):
    """FN31: places where neighbours differ, and runs of a third of the k-mer."""
    k = Q.kmers(reference(spark, sf), "seq", 15)
    run = Q.is_homopolymer(F.col("kmer"), 15, 0.3).cast("long")
    return k.groupBy("item_id").agg(F.sum(Q.transitions(F.col("kmer"))).alias("transitions"), F.sum(run).alias("runs"))


@query("combined_ids", "SELECT r_name AS species, n_name AS gene, CAST(row_number() OVER (ORDER BY r_name, n_name) - 1 AS INTEGER) AS id FROM region, nation")
def combined_ids(spark, sf):
    """JN22: every pair of two small dimensions with a dense id."""
    from pyspark.sql import Window

    numbered = lambda name, column, alias: table(spark, sf, name).select(F.col(column).alias(alias), (F.row_number().over(Window.orderBy(column)) - 1).alias(f"_{alias}"))
    species, gene = numbered("region", "r_name", "species"), numbered("nation", "n_name", "gene")
    size = gene.agg(F.count("*").cast("int").alias("_n"))
    both = species.crossJoin(F.broadcast(gene)).crossJoin(F.broadcast(size))
    return both.select("species", "gene", (F.col("_species") * F.col("_n") + F.col("_gene")).alias("id"))


@query(
    "best_sequences",
    """WITH s AS (SELECT item_id % 7 AS grp, item_id, CASE WHEN length(text) BETWEEN 50 AND 1000 THEN 10.0 WHEN length(text) BETWEEN 20 AND 50 OR length(text) BETWEEN 1001 AND 2000 THEN 5.0 ELSE 0.0 END
      + CASE WHEN length(regexp_replace(text, '[^WCM]', '', 'g')) / length(text) < 0.1 THEN 5.0 ELSE 0.0 END + CASE WHEN item_id % 3 = 0 THEN 20.0 ELSE 0.0 END AS quality FROM benchmark)
    SELECT grp, item_id, CAST(quality AS DOUBLE) AS quality FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY quality DESC, item_id) AS r FROM s) WHERE r = 1""",
)
def best_sequences(spark, sf):
    """ST10, FN43: the best wild-type candidate of each group."""
    s = table(spark, sf, "benchmark").select((F.col("item_id") % 7).alias("grp"), "item_id", G.sequence_quality(F.col("text"), F.col("item_id") % 3 == 0).alias("quality"))
    return kmers.first_n(s, ["grp"], [F.desc("quality"), F.col("item_id")], 1)


@query("best_row_per_gene", "SELECT l_partkey AS gene_id, l_orderkey AS read_id, l_quantity AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def best_row_per_gene(spark, sf):
    """ST11, WN08."""
    t = table(spark, sf, "lineitem")
    return kmers.first_n(t, ["l_partkey"], [F.desc("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")], 1).select(
        F.col("l_partkey").alias("gene_id"), F.col("l_orderkey").alias("read_id"), F.col("l_quantity").alias("score")
    )


@query(
    "mutation_codes",
    "SELECT p_partkey AS id, chr(CAST(65 + p_partkey % 26 AS INTEGER)) || p_size || chr(CAST(65 + p_partkey * 7 % 26 AS INTEGER)) AS code, chr(CAST(65 + p_partkey % 26 AS INTEGER)) AS wild, p_size AS pos, chr(CAST(65 + p_partkey * 7 % 26 AS INTEGER)) AS mutant FROM part",
)
def mutation_codes(spark, sf):
    """FN28, FN45: codes made and taken apart again."""
    letter = lambda c: F.chr(F.lit(65) + c % 26)
    p = F.col("p_partkey")
    t = table(spark, sf, "part").select(p.alias("id"), G.mutation_code(letter(p), F.col("p_size"), letter(p * 7)).alias("code"))
    return t.withColumn("m", G.parse_mutation(F.col("code"))).select("id", "code", "m.wild", "m.pos", "m.mutant")


@query(
    "region_membership",
    "SELECT g AS gene, count(*) FILTER (WHERE (g = 'gyrA' AND pos BETWEEN 67 AND 106) OR (g = 'gyrB' AND pos BETWEEN 426 AND 464) OR (g = 'parC' AND pos BETWEEN 64 AND 102) OR (g = 'parE' AND pos BETWEEN 410 AND 450)) AS inside, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'gyrA' WHEN 1 THEN 'gyrB' WHEN 2 THEN 'parC' ELSE 'parE' END AS g, p_size * 9 + 50 AS pos FROM part) GROUP BY g",
)
def region_membership(spark, sf):
    """FLT11, RM02."""
    gene = F.element_at(F.array(*(F.lit(g) for g in ("gyrA", "gyrB", "parC", "parE"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    t = table(spark, sf, "part").select(gene.alias("gene"), (F.col("p_size") * 9 + 50).alias("pos"))
    return t.groupBy("gene").agg(F.sum(G.in_qrdr(F.col("gene"), F.col("pos")).cast("long")).alias("inside"), F.count("*").alias("n"))


@query("taxon_related", _LCA + ", l AS (SELECT a, b, min(sa) AS ua, first(sb ORDER BY sa) AS ub FROM m GROUP BY a, b) SELECT a, b, ua <= 1 AND ub <= 1 AS related FROM l")
def taxon_related(spark, sf):
    """GR10."""
    out = taxonomy.lca_pairs(_supplier_pairs(spark, sf), taxonomy.closure(taxa(spark, sf), 2))
    return out.select("a", "b", taxonomy.related(F.col("up_a"), F.col("up_b"), 1).alias("related"))


_HOURLY = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"


@query("windowed_events", _HOURLY)
def windowed_events(spark, sf):
    """SM06 over a table."""
    from strandline.streaming import jobs

    out = jobs.windowed(table(spark, sf, "events"), "ts", ["event_type"])
    return out.withColumn("total", F.round("total", 2)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("streamed_events", _HOURLY)
def streamed_events(spark, sf):
    """SM01, SM06: the same aggregate as a file stream, run until all files are read."""
    import uuid

    from strandline.streaming import jobs

    schema = table(spark, sf, "events").schema
    live = jobs.windowed(jobs.file_events(spark, sf, schema, glob="events.parquet"), "ts", ["event_type"], late="400 days")
    name = "events_" + uuid.uuid4().hex
    q = live.writeStream.outputMode("complete").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).withColumn("total", F.round("total", 2)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "job_routing",
    """WITH e AS (SELECT event_id AS job_id, CASE event_type WHEN 'error' THEN 'Connection refused' WHEN 'click' THEN 'Corrupted file' ELSE 'odd' END AS msg, CAST(event_id % 3 AS INTEGER) AS code, CAST(user_id % 5 AS INTEGER) AS retries FROM events),
    k AS (SELECT *, CASE WHEN msg = 'Corrupted file' THEN 'permanent' WHEN msg = 'Connection refused' THEN 'transient' WHEN code IN (1, 2) THEN 'permanent' ELSE 'unknown' END AS kind FROM e)
    SELECT kind, CASE WHEN kind <> 'permanent' AND retries < 3 THEN 'retry' ELSE 'dead' END AS verdict, count(*) AS n FROM k GROUP BY ALL""",
)
def job_routing(spark, sf):
    """SM03, SM04, SNK25."""
    from strandline.streaming import jobs

    t = F.col("event_type")
    e = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("job_id"), F.when(t == "error", "Connection refused").when(t == "click", "Corrupted file").otherwise("odd").alias("message"),
        (F.col("event_id") % 3).cast("int").alias("code"), (F.col("user_id") % 5).cast("int").alias("retries"), F.col("ts").cast("timestamp").alias("ts"),
    )
    return jobs.routed(e).groupBy("kind", "verdict").agg(F.count("*").alias("n"))


@query("program_abundance", f"WITH {_HITS} SELECT gene_id, count(*) AS reads, round(count(*) / (SELECT count(*) FROM hits WHERE score >= 10), 8) AS share FROM hits WHERE score >= 10 GROUP BY gene_id")
def program_abundance(spark, sf):
    """UX01-UX07: a program of the pipeline language."""
    from strandline.plans import dsl

    text = """
    pipeline Abundance {
        input: { hits: csv_file }
        stage count { kept = good(hits) { least: 10 } shares = calculate_abundance(kept) emit: shares }
    }"""
    out = dsl.run(text, {"hits": hits(spark, sf)}, functions={"good": lambda d, least: d.where(F.col("score") >= least)})
    return out.emitted["shares"].withColumn("share", F.round("share", 8))


@query(
    "quality_filtered_hits",
    f"WITH {_HITS} SELECT count(*) AS n, count(*) FILTER (WHERE score >= 30 AND identity >= 0.95) AS passed FROM hits",
)
def quality_filtered_hits(spark, sf):
    """FLT06, FLT08, FLT13: thresholds on matches."""
    h = hits(spark, sf).withColumn("fine", (F.col("score") >= 30) & (F.col("identity") >= 0.95))
    return h.agg(F.count("*").alias("n"), F.sum(F.col("fine").cast("long")).alias("passed"))


@query(
    "organism_profiles",
    f"""WITH {_HITS}, p AS (SELECT taxon, count(*) AS hits, sum(identity) AS w, count(DISTINCT gene_id) AS k, count(DISTINCT read_id) AS reads FROM hits GROUP BY taxon)
    SELECT taxon AS organism, hits, k AS kmers, reads, round(w / sum(w) OVER (), 6) AS abundance, round(k / 5000.0, 6) AS breadth,
    round(least(1.0, log10(hits + 1) / 3.0) * least(1.0, 10 * k / 5000.0), 6) AS confidence FROM p""",
)
def organism_profiles(spark, sf):
    """AG29, AG47, FLT17."""
    m = hits(spark, sf).select(F.col("taxon").alias("organism"), F.col("identity").alias("weight"), F.col("gene_id").alias("kmer"), "read_id")
    sizes = m.select("organism").distinct().withColumn("size", F.lit(5000.0))
    r = lambda c: F.round(c, 6).alias(c)
    return classify.profiles(m, sizes).select("organism", "hits", "kmers", "reads", r("abundance"), r("breadth"), r("confidence"))
