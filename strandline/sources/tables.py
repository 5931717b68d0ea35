"""Reference tables and sheets (SRC06-SRC25, SRC28, RM39)."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted column names of a sample sheet, compared in lower case without blanks, dashes and underscores.
SHEET_COLUMNS = {
    "sample_name": ("samplename", "sampleid", "sample", "name", "id"),
    "file_path": ("filepath", "path", "directory", "dir", "folder"),
    "r1": ("r1file", "r1", "read1", "forward", "fastq1"),
    "r2": ("r2file", "r2", "read2", "reverse", "fastq2"),
}


def packed_records(spark: SparkSession, path: str, fields: list[tuple[str, str]], skip: int = 0, per_row: int = 65_536) -> DataFrame:
    """SRC20-SRC23: rows of a binary index file of fixed-size records after ``skip`` bytes.

    ``fields`` are (name, NumPy type) in file order, such as ("kmer", "<u8").
    Spark splits nothing inside a binary file, so a file is one task's, read as
    blocks of ``per_row`` records; a large index is best kept in many files or,
    once read, as a Parquet table.
    """
    kind = np.dtype(fields)
    names = {"u8": "long", "i8": "long", "u4": "long", "i4": "int", "u2": "int", "i2": "int", "u1": "int", "i1": "int", "f8": "double", "f4": "float"}
    out = {n: names[t.lstrip("<>=|")] for n, t in fields}
    arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = memoryview(content.as_buffer())[skip:]
                if len(raw) % kind.itemsize:
                    raise ValueError(f"{path}: {len(raw)} bytes are no whole number of records of {kind.itemsize}")
                rows = np.frombuffer(raw, kind)
                for s in range(0, len(rows), per_row):
                    part = rows[s : s + per_row]
                    cols = [pa.array(part[n].astype({"long": np.int64, "int": np.int32, "double": np.float64, "float": np.float32}[k]), arrow[k]) for n, k in out.items()]
                    yield pa.RecordBatch.from_arrays(cols, list(out))

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in out.items()))


def kmer_index(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """SRC21, SRC23: (kmer, taxon) from records of a packed k-mer and a 32-bit taxon."""
    return packed_records(spark, path, [("kmer", "<u8"), ("taxon", "<u4")], skip)


def protein_index(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """SRC20: (hash, protein_id, pos) from records of a word's hash, a protein and a place."""
    return packed_records(spark, path, [("hash", "<u8"), ("protein_id", "<u4"), ("pos", "<u4")], skip)


def hash_cells(spark: SparkSession, path: str, value_bits: int = 16, skip: int = 32) -> DataFrame:
    """SRC22: (cell, prefix, value) of the filled cells of a compact hash table: 32-bit cells of a key's prefix and a value."""
    rows = packed_records(spark, path, [("cell", "<u4")], skip).where("cell <> 0")
    return rows.select("cell", F.shiftright("cell", value_bits).alias("prefix"), F.col("cell").bitwiseAND(F.lit((1 << value_bits) - 1)).alias("value"))


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """SRC25: alignment tables; in place of HDF5, which no Spark source reads, the Parquet tables that ``sinks.parquet`` writes."""
    return spark.read.parquet(path)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: (header, seq), upper case without white space; split at lines that start a record."""
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    value = F.regexp_replace("value", "^>", "")
    head = F.regexp_replace(F.substring_index(value, "\n", 1), "\r$", "")
    seq = F.upper(F.regexp_replace(F.when(value.contains("\n"), F.regexp_replace(value, r"^[^\n]*\n", "")).otherwise(""), r"\s+", ""))
    return raw.select(head.alias("header"), seq.alias("seq"))


def amr_proteins(records: DataFrame) -> DataFrame:
    """SRC11: id, accession, name, family and class from headers with bars, with fallbacks for short ones."""
    parts = F.split("header", r"\|")
    at = lambda i: F.nullif(F.get(parts, i), F.lit(""))
    return records.select(
        F.coalesce(F.expr("try_cast(split(header, '\\\\|')[0] as int)"), F.lit(None)).alias("gene_id"),
        F.coalesce(at(1), F.substring_index("header", " ", 1)).alias("accession"),
        F.coalesce(at(4), at(1), F.substring_index("header", " ", 1)).alias("gene_name"),
        F.coalesce(at(5), F.substring_index(at(4), "-", 1)).alias("gene_family"),
        F.coalesce(at(9), at(8), F.lit("UNKNOWN")).alias("drug_class"),
        "seq",
        F.length("seq").alias("length"),
    )


def matched(dna: DataFrame, protein: DataFrame) -> DataFrame:
    """SRC13: protein records with the DNA of the same accession, versions aside."""
    key = lambda: F.regexp_replace("accession", r"\.\d+$", "")
    d = dna.select(key().alias("_k"), F.col("seq").alias("dna"))
    return protein.withColumn("_k", key()).join(d, "_k", "left").drop("_k")


def genomes(records: DataFrame) -> DataFrame:
    """SRC14, SRC15: taxon, accession and species from three header styles."""
    h = F.col("header")
    taxon = F.coalesce(*(F.nullif(F.regexp_extract(h, p, 1), F.lit("")) for p in (r"kraken:taxid\|(\d+)", r"taxid[=:|](\d+)", r"^(\d+)\s")))
    accession = F.coalesce(F.nullif(F.regexp_extract(h, r"kraken:taxid\|\d+\|(\S+)", 1), F.lit("")), F.regexp_extract(h, r"^(\S+)", 1))
    words = F.regexp_extract(h, r"^\S+\s+([A-Z]\S*\s+[a-z]\S*)", 1)
    return records.select(taxon.cast("long").alias("taxon"), accession.alias("accession"), F.nullif(words, F.lit("")).alias("species"), "seq")


def genome_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC16: (path, bytes, taxon from the name) of sequence files under a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{fna,fa,fasta,fna.gz,fa.gz,fasta.gz}").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    taxon = F.nullif(F.regexp_extract(name, r"(?:taxid_|^)(\d+)", 1), F.lit("")).cast("long")
    return raw.select("path", F.col("length").alias("bytes"), taxon.alias("taxon"))


def taxonomy_dump(spark: SparkSession, nodes: str, names: str) -> DataFrame:
    """SRC17: (id, parent, rank, name) from the two dump files, scientific names only; a root has no parent."""
    part = lambda i: F.trim(F.regexp_replace(F.get(F.split("value", r"\|"), i), "\t", ""))
    n = spark.read.text(nodes).select(part(0).cast("long").alias("id"), part(1).cast("long").alias("parent"), part(2).alias("rank"))
    s = spark.read.text(names).where(part(3) == "scientific name").select(part(0).cast("long").alias("id"), part(1).alias("name"))
    return n.join(s, "id", "left").withColumn("parent", F.when(F.col("parent") != F.col("id"), F.col("parent")))


def taxonomy_tsv(spark: SparkSession, path: str) -> DataFrame:
    """SRC18: (id, parent, rank, name); the rank is guessed from the name, as the file has none."""
    t = spark.read.option("sep", "\t").option("header", True).csv(path).toDF("id", "name", "parent")
    low = F.lower("name")
    rank = F.when(F.col("id") == "1", "root").when(low.contains("phylum"), "phylum").when(low.contains("genus"), "genus").when(low.rlike(r"^\S+ \S+"), "species").otherwise("no rank")
    return t.select(F.col("id").cast("long").alias("id"), F.col("parent").cast("long").alias("parent"), rank.alias("rank"), "name")


def kraken_results(spark: SparkSession, path: str) -> DataFrame:
    """SRC19: results with paired cells ``a|b`` as arrays."""
    t = spark.read.option("sep", "\t").csv(path).toDF("status", "read_id", "taxon", "length", "confidence", "votes", "kmers")
    cell = lambda c: F.transform(F.split(c, r"\|"), lambda x: x.cast("int")).alias(c)
    return t.select((F.col("status") == "C").alias("classified"), "read_id", F.col("taxon").cast("long").alias("taxon"), cell("length"), F.col("confidence").cast("double").alias("confidence"), cell("votes"), cell("kmers"))


def mutations(spark: SparkSession, path: str) -> DataFrame:
    """SRC09, SRC10: (species, gene, pos, wild, mutant, row); rows with NA are left out.

    Column names may be those of either published layout.
    """
    t = spark.read.option("header", True).option("nullValue", "NA").csv(path)
    names = {re.sub(r"[^a-z]", "", c.lower()): c for c in t.columns}
    pick = lambda *options: F.col("`" + next(names[o] for o in options if o in names) + "`")
    out = t.select(
        pick("species").alias("species"), pick("gene").alias("gene"), pick("location", "mutationposition", "position").cast("int").alias("pos"),
        F.substring(pick("wt", "wildtypeaminoacid"), 1, 1).alias("wild"), F.substring(pick("mut", "mutantaminoacid"), 1, 1).alias("mutant"),
    )
    return out.dropna().withColumn("row", F.xxhash64(*out.columns))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC24: distinct lines of a list, without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("item")).where((F.col("item") != "") & ~F.col("item").startswith("#")).distinct()


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """SRC06: a sample sheet with commas, tabs or semicolons; unknown columns become a metadata map."""
    first = spark.read.text(path).head()
    line = first[0] if first else ""
    sep = max((",", "\t", ";"), key=line.count)
    t = spark.read.option("header", True).option("sep", sep).csv(path)
    plain = {c: re.sub(r"[\s_-]", "", c.lower()) for c in t.columns}
    found = {k: next((c for c, p in plain.items() if p in v), None) for k, v in SHEET_COLUMNS.items()}
    if missing := [k for k in ("sample_name", "file_path", "r1") if not found[k]]:
        raise ValueError(f"the sample sheet has no column for {', '.join(missing)}")
    rest = [c for c in t.columns if c not in found.values()]
    q = lambda c: F.trim(F.col(f"`{c}`"))
    folder = F.regexp_replace(F.regexp_replace(q(found["file_path"]), "^~", os.path.expanduser("~")), "/+$", "")
    file = lambda c: F.concat_ws("/", folder, q(c)) if c else F.lit(None).cast("string")
    meta = F.map_from_arrays(F.array(*(F.lit(c) for c in rest)), F.array(*(q(c) for c in rest))) if rest else F.create_map().cast("map<string,string>")
    r2 = F.when(F.coalesce(q(found["r2"]), F.lit("")) != "", file(found["r2"])) if found["r2"] else file(None)
    return t.select(q(found["sample_name"]).alias("sample_name"), folder.alias("file_path"), file(found["r1"]).alias("r1"), r2.alias("r2"), meta.alias("metadata"))


def sheet_errors(samples: DataFrame) -> DataFrame:
    """SRC07: (sample_name, error) for what is missing or repeated."""
    twice = samples.groupBy("sample_name").agg(F.count("*").alias("n")).where("n > 1").select("sample_name", F.lit("name is repeated").alias("error"))
    empty = samples.where(F.coalesce("sample_name", F.lit("")) == "").select("sample_name", F.lit("name is missing").alias("error"))
    no_r1 = samples.where(F.coalesce("r1", F.lit("")) == "").select("sample_name", F.lit("R1 is missing").alias("error"))
    return twice.unionByName(empty).unionByName(no_r1)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC08: (sample_id, r1, r2) from either layout of a manifest."""
    t = spark.read.option("multiLine", True).json(path)
    if "samples" in t.columns:
        rows = t.select(F.explode("samples").alias("s"))
        fields = rows.schema["s"].dataType.names
        pick = lambda *names: F.coalesce(*(F.col(f"s.{n}") for n in names if n in fields), F.lit(None).cast("string"))
        return rows.select(pick("sample_id", "id", "name").alias("sample_id"), pick("read1", "r1", "forward").alias("r1"), pick("read2", "r2", "reverse").alias("r2"))
    text = t.select(F.explode(F.from_json(F.to_json("files"), "map<string,map<string,string>>")).alias("sample_id", "f"))
    any_of = lambda *names: F.coalesce(*(F.try_element_at("f", F.lit(n)) for n in names))
    return text.select("sample_id", any_of("read1", "r1", "forward").alias("r1"), any_of("read2", "r2", "reverse").alias("r2"))


def species_taxa(hits: DataFrame, spark: SparkSession, summary: str) -> DataFrame:
    """RM39: ``hits`` (taxon) with the species taxon from an assembly summary."""
    t = spark.read.text(summary).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p"))
    pairs = t.select(F.get("p", 5).cast("long").alias("taxon"), F.get("p", 6).cast("long").alias("species_taxon")).distinct()
    return hits.join(pairs, "taxon", "left")


@dataclass(frozen=True)
class Config:
    """SRC28, FLT18: settings with checks; files and the environment override the defaults."""

    kmer: int = 31
    window: int = 15
    protein_kmer: int = 8
    min_identity: float = 0.85
    min_length: int = 20
    min_depth: int = 5
    em_rounds: int = 100
    em_tolerance: float = 1e-3
    fragment_mean: float = 500.0
    fragment_sd: float = 100.0
    extra: dict = field(default_factory=dict)

    def checked(self) -> Config:
        bad = []
        if not 1 <= self.kmer <= 31:
            bad.append("kmer must be 1 to 31")
        if not 0 <= self.min_identity <= 1:
            bad.append("min_identity must be 0 to 1")
        if self.em_rounds < 1 or self.min_depth < 1 or self.window < 1:
            bad.append("em_rounds, min_depth and window must be positive")
        if bad:
            raise ValueError("; ".join(bad))
        return self

    def overridden(self, values: dict) -> Config:
        known = {k: v for k, v in values.items() if k in self.__dataclass_fields__ and k != "extra"}
        rest = {k: v for k, v in values.items() if k not in known}
        return replace(self, **known, extra={**self.extra, **rest}).checked()

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return cls().overridden(json.loads(os.path.expandvars(f.read())))

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)
