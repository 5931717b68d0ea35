"""Result writers and report texts (SNK01-SNK27).

Tables are written by Spark, in as many files as they have partitions; reports
are small aggregates put into a text on the driver.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.sources.fastq import filesystem
from strandline.storage import file_system


def tsv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK01, SNK02, SNK06, SNK08, SNK14, SNK16, SNK18, SNK23: a table with tabs and a header; arrays and maps become cells."""
    flat = rows.select(*(_cell(rows, c).alias(c) for c in rows.columns))
    flat.write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def parquet(rows: DataFrame, path: str, *by: str, mode: str = "errorifexists") -> None:
    """SNK05, SNK09, SNK19-SNK22: the engine's own format in place of binary and HDF5 files."""
    writer = rows.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def json_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK07, SNK26, RM36."""
    rows.write.mode(mode).json(path)


def _cell(rows: DataFrame, c: str) -> Column:
    kind = rows.schema[c].dataType.simpleString()
    if kind == "array<string>":
        return F.array_join(c, ";")
    if kind.startswith(("array", "map", "struct")):
        return F.to_json(c)
    return F.col(c)


def counts_cell(counts: Column) -> Column:
    """SNK08: a map of residue counts as ``A:3;C:1``."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ";")


def kraken_lines(results: DataFrame) -> DataFrame:
    """SNK14: status, read, taxon, length, confidence, votes, k-mers, by tab; null taxon is 0 and unclassified."""
    taxon = F.coalesce("taxon", F.lit(0))
    pair = lambda c: F.array_join(F.col(c).cast("array<string>"), "|")
    status = F.when(taxon > 0, "C").otherwise("U")
    return results.select(F.concat_ws("\t", status, "read_id", taxon.cast("string"), pair("length"), F.format_string("%.3f", "confidence"), pair("votes"), pair("kmers")).alias("value"))


def sam_lines(hits: DataFrame) -> DataFrame:
    """SNK10: one alignment per line, without a sequence dictionary."""
    flag = F.when(F.col("is_r2"), "147").otherwise("99")
    return hits.select(F.concat_ws("\t", F.col("read_id").cast("string"), flag, F.col("gene_name"), (F.col("ref_start") + 1).cast("string"), F.lit("255"), F.concat((F.col("ref_end") - F.col("ref_start")).cast("string"), F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*")).alias("value"))


def dot(edges: DataFrame) -> DataFrame:
    """SNK27: the graph as DOT lines, edges in order."""
    line = F.format_string('  "%s" -> "%s" [label="%s", weight=%.1f];', "src", "dst", "type", F.col("weight").cast("double"))
    ends = edges.sparkSession.createDataFrame([(0, "digraph resistance {"), (2, "}")], "o int, value string")
    return ends.unionByName(edges.select(F.lit(1).alias("o"), line.alias("value"))).orderBy("o", "value").select("value")


def text_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines.write.mode(mode).text(path)


def summary_json(**summaries: DataFrame) -> str:
    """SNK26, SNK17: small tables as one JSON document."""
    return json.dumps({k: [r.asDict(True) for r in d.collect()] for k, d in summaries.items()}, default=str, sort_keys=True)


def report(title: str, sections: dict[str, DataFrame], notes: tuple[str, ...] = (), form: str = "text", top: int = 100) -> str:
    """SNK03, SNK04, SNK11-SNK13: a report of (small, sorted) sections: all rows as JSON, else the first ``top`` of each and how many more there are."""
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    cells = lambda d: [[cell(v) for v in r] for r in d.collect()]
    if form == "json":
        rows = {k: [dict(zip(d.columns, r, strict=True)) for r in cells(d)] for k, d in sections.items()}
        return json.dumps({"title": title, "notes": list(notes)} | rows, sort_keys=True)
    parts = {}
    for k, d in sections.items():
        rows = cells(d.limit(top + 1))
        left = d.count() - top if len(rows) > top else 0
        parts[k] = d.columns, rows[:top], f"{left} more rows are left out" if left else ""
    if form == "html":
        table = lambda c, rows, more: "<table><tr>" + "".join(f"<th>{html.escape(x)}</th>" for x in c) + "</tr>" + "".join("<tr>" + "".join(f"<td>{html.escape(x)}</td>" for x in r) + "</tr>" for r in rows) + "</table>" + (f"<p>{more}</p>" if more else "")
        body = "".join(f"<p>{html.escape(n)}</p>" for n in notes) + "".join(f"<h2>{html.escape(k)}</h2>{table(*p)}" for k, p in parts.items())
        return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{body}</body></html>'
    out = [title, "=" * len(title), *notes]
    for k, (c, rows, more) in parts.items():
        out += ["", k, "-" * len(k), "\t".join(c), *("\t".join(r) for r in rows), *([more] if more else [])]
    return "\n".join(out) + "\n"


def named_files(rows: DataFrame, path: str) -> None:
    """One file per row (name, value) in a folder, written by the tasks that hold the rows; a repeated task writes the same file again."""
    spark = rows.sparkSession
    fs, hadoop = file_system(spark, path)
    fs.mkdirs(hadoop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, at = filesystem(path)
            for name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with where.open_output_stream(f"{at}/{name}", compression=None) as out:
                    out.write(value if isinstance(value, bytes) else value.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

    rows.select("name", "value").mapInArrow(run, "name string").agg(F.count("*")).collect()
