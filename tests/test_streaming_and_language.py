import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandline.plans import dsl
from strandline.streaming import jobs

PROGRAM = '''
# a comment
import core.io as io;
pipeline Test {
    input: { reads: fastq_file, patient_id: string, note: string optional }
    output: { report: json }
    references: { known: mutation_database("fq") }
    @gpu_kernel(size: 4)
    stage quality { filtered = filter_reads(reads) { min_quality: 20, min_length: 4 } emit: filtered }
    stage detect { found = scan_mutations(seen, known) { genes: ["gyrA"] } emit: found }
    stage tell {
        report {
            if found.any() { alert: "resistance" } else { print "none" }
            print "patient {patient_id}: {found.count} of {seen.count}"
            if filtered.count > 1 and not found.count == 0 { recommendation: "look" }
        }
        foreach g in ["a", "b"] { report { print "g {g}" } }
    }
}
'''


def test_program(spark):
    reads = spark.createDataFrame([("ACGTA", "IIIII"), ("ACGTT", "IIIII"), ("ACGTA", "!!!!!"), ("AC", "II")], "seq string, qual string")
    seen = spark.createDataFrame([("e", "gyrA", 83, "L"), ("e", "parC", 80, "I")], "species string, gene string, pos int, residue string")
    known = spark.createDataFrame([("e", "gyrA", 83, "S", "L"), ("e", "parC", 80, "S", "I")], "species string, gene string, pos int, wild string, mutant string")
    r = dsl.run(PROGRAM, {"reads": reads, "patient_id": "p1", "seen": seen}, {"known": known})
    assert r.emitted["filtered"].count() == 2
    assert r.messages == [("alert", "resistance"), ("print", "patient p1: 1 of 2"), ("recommendation", "look"), ("print", "g a"), ("print", "g b")]
    tree = dsl.parse(PROGRAM)
    assert tree.imports == (("core.io", "io"),) and tree.pipelines[0].inputs["note"] == ("string", True)
    assert tree.pipelines[0].stages[0].decorators[0][0] == "gpu_kernel"


@pytest.mark.parametrize("text", ["pipeline X { }", "pipeline X { stage s { a = } }", "stage x {}", "pipeline X { stage s { ! } }"])
def test_bad_programs(text):
    with pytest.raises(dsl.ParseError):
        dsl.parse(text)


def test_missing_inputs(spark):
    with pytest.raises(ValueError):
        dsl.run(PROGRAM, {})
    with pytest.raises(NameError):
        dsl.run("pipeline X { stage s { a = nothing(1) } }", {})


def job(i, message, code, retries):
    return (f"j{i}", f"s{i}", "run", 0.5, message, code, retries, dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc))


def test_job_routing(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [job(1, "", 0, 0), job(2, "network down", 1, 0), job(3, "file not found", 1, 0), job(4, "timeout", 1, 3)]
    spark.createDataFrame(rows, jobs.JOB).coalesce(1).write.parquet(src)
    events = jobs.file_events(spark, src, spark.read.parquet(src).schema)
    sink = {k: str(tmp_path / k) for k in ("done", "retry", "dead")}
    for _ in range(2):  # the same batch twice leaves one copy
        q = jobs.run_jobs(events, lambda d: d, *(jobs.to_folder(sink[k]) for k in ("done", "retry", "dead")), str(tmp_path / "c"))
        q.processAllAvailable()
        q.stop()
    got = {k: sorted(r.job_id for r in spark.read.parquet(p).collect()) for k, p in sink.items()}
    assert got == {"done": ["j1"], "retry": ["j2"], "dead": ["j3", "j4"]}
    r = spark.read.parquet(sink["retry"]).withColumn("wait", F.unix_timestamp("next_try") - F.unix_timestamp("ts")).head()
    assert 66 <= r.wait <= 78


def test_windowed_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "ev"))
    live = jobs.file_events(spark, str(tmp_path / "ev"), e.schema)
    q = jobs.windowed(live, "ts", ["event_type"], late="400 days").writeStream.outputMode("complete").format("memory").queryName("win").start()
    q.processAllAvailable()
    q.stop()
    want = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    assert spark.table("win").agg(F.sum("n"), F.count("*")).head() == want.agg(F.sum("n"), F.count("*")).head()


def test_fan_out_and_samples(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(10).write.parquet(src)
    live = jobs.file_events(spark, src, "id long", 100)
    sinks = {k: jobs.to_folder(str(tmp_path / k)) for k in ("even", "all")}
    q = jobs.fan_out(live, {"even": lambda d: d.where("id % 2 = 0"), "all": lambda d: d}, sinks, str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "even")).count() == 5 and spark.read.parquet(str(tmp_path / "all")).count() == 10

    def process(row):
        if row["sample_name"] == "b":
            raise ValueError("bad")

    sheet = spark.createDataFrame([("a",), ("b",), ("c",)], "sample_name string").coalesce(1)
    assert jobs.each_sample(sheet, process) == [("a", None), ("b", "bad"), ("c", None)]
    assert len(jobs.each_sample(sheet, process, True)) == 2


def test_latest(spark):
    rows = [("j", "a", 0.1, "x", dt.datetime(2024, 1, 1)), ("j", "b", 0.2, "y", dt.datetime(2024, 1, 2))]
    r = jobs.latest(spark.createDataFrame(rows, "job_id string, stage string, progress double, message string, ts timestamp")).head()
    assert (r.stage, r.progress) == ("b", 0.2)


def test_progress(spark):
    r = jobs.progress(spark.createDataFrame([job(1, "half", 0, 0)], jobs.JOB)).head()
    assert '"stage":"run"' in r.record and '"timestamp":"2024-01-01 00:00:00"' in r.record
