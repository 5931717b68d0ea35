"""Streaming runners: aggregates, job routing, retries and fan-out (SRC26, SNK24-SNK25, SM01-SM07, SM09, SM10).

Batches may be repeated after a failure, so everything a batch writes is keyed
by its id and overwrites what an earlier attempt left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.functions.scoring import error_class, retry_delay

JOB = "job_id string, sample_id string, stage string, progress double, message string, code int, retries int, ts timestamp"


def kafka_jobs(spark: SparkSession, servers: str, topic: str = "new_jobs", group: str = "workers") -> DataFrame:
    """SRC26: job requests from a topic, from its start."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    raw = raw.option("startingOffsets", "earliest").option("groupIdPrefix", group).load()
    return raw.select(F.from_json(F.col("value").cast("string"), JOB).alias("j")).select("j.*")


def file_events(spark: SparkSession, path: str, schema, per_batch: int = 1, glob: str | None = None) -> DataFrame:
    """SM01, SM10: new Parquet files of a folder, a bounded number at a time."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def windowed(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes", value: str = "value") -> DataFrame:
    """SM06: counts and sums per key and window; rows later than ``late`` are left out once their window has closed."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    out = timed.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def routed(jobs: DataFrame, max_retries: int = 3, base: int = 60) -> DataFrame:
    """SM03, SM04: failed jobs with a verdict (retry or dead) and the time of the next try, after ``base`` seconds the first time.

    Jitter comes from the job's id, so a repeated batch makes the same times.
    """
    kind = error_class(F.col("message"), F.col("code"))
    again = (kind != "permanent") & (F.col("retries") < max_retries)
    jitter = F.pmod(F.xxhash64("job_id", "retries"), F.lit(1000)) / 1000.0
    delay = retry_delay(F.col("retries"), jitter, base)
    at = F.timestamp_micros(F.unix_micros("ts") + (delay * 1_000_000).cast("long"))
    return jobs.withColumn("kind", kind).withColumn("verdict", F.when(again, "retry").otherwise("dead")).withColumn("next_try", F.when(again, at))


def latest(updates: DataFrame) -> DataFrame:
    """SM05: the last update of each job."""
    return updates.groupBy("job_id").agg(F.max_by(F.struct("stage", "progress", "message"), "ts").alias("s"), F.max("ts").alias("ts")).select("job_id", "s.*", "ts")


Sink = Callable[[DataFrame, int], None]


def to_folder(path: str) -> Sink:
    """A sink that keeps each batch in a folder of its own; a repeated batch replaces it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def to_kafka(servers: str, topic: str, key: str = "job_id") -> Sink:
    """SNK24: a sink that publishes each row as JSON under its key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
        rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()

    return write


def progress(updates: DataFrame) -> DataFrame:
    """FN42, FN46: updates as JSON records with a formatted time."""
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return updates.select("job_id", F.to_json(F.struct("stage", "progress", "message", at.alias("timestamp"))).alias("record"))


def run_jobs(
    jobs: DataFrame, work: Callable[[DataFrame], DataFrame], done: Sink, retry: Sink, dead: Sink, checkpoint: str,
    max_retries: int = 3, base: int = 60, trigger: dict | None = None,
) -> StreamingQuery:
    """SM02, SM04, SNK25: ``work`` adds message and code to each job (code 0: success); failures go to retry or dead.

    ``state.due_again`` over what went to retry gives the jobs back when they are due.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        result = work(batch).persist()
        done(result.where("code = 0"), batch_id)
        failed = routed(result.where("code <> 0"), max_retries, base)
        retry(failed.where("verdict = 'retry'"), batch_id)
        dead(failed.where("verdict = 'dead'"), batch_id)
        result.unpersist()

    writer = jobs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


Detector = Callable[[DataFrame], DataFrame]


def fan_out(source: DataFrame, detectors: dict[str, Detector], sinks: dict[str, Sink], checkpoint: str) -> StreamingQuery:
    """SM07, UX10, UX11: every detector over the same batch, which is read once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        for name, detect in detectors.items():
            sinks[name](detect(batch), batch_id)
        batch.unpersist()

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def each_sample(samples: DataFrame, process: Callable[[dict], None], stop_on_error: bool = False) -> list[tuple[str, str | None]]:
    """SM09, AG46, UX12: ``process`` once per row of a (small) sample sheet: (sample, error or null)."""
    out: list[tuple[str, str | None]] = []
    for row in samples.toLocalIterator():
        try:
            process(row.asDict())
            out.append((row["sample_name"], None))
        except Exception as e:  # noqa: BLE001  a sample's failure is its result
            out.append((row["sample_name"], str(e)))
            if stop_on_error:
                break
    return out


def samples_apart(samples: DataFrame, process: Callable[[dict], None], name: str = "sample_name") -> DataFrame:
    """SM09, AG46, UX12 without stopping: ``process`` once per row, in the task that holds it: (name, error or null).

    ``process`` runs on executors; it has no session and may run again if a task does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors: list[str | None] = []
            for row in batch.to_pylist():
                try:
                    process(row)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a sample's failure is its result
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(name)), pa.array(errors, pa.string())], [name, "error"])

    return samples.mapInArrow(run, f"{name} {samples.schema[name].dataType.simpleString()}, error string")
