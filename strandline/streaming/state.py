"""Stateful streams: job states that are forgotten, growing coverage, delayed retries (SM03, SM05, SM06).

Each is a processor for ``transformWithState``: state lives in RocksDB under the
query's checkpoint and survives lost executors.  Last states are keyed by job.
Lives, coverage and retries are keyed by buckets of jobs or genes: a bucket's whole
state is one value of Arrow bytes, read and written once a batch, and its keys are
worked on together, so a batch costs its rows and its buckets, not a call for each key.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Buckets of keys that share a state; a checkpoint keeps the number it was begun with.
BUCKETS = 1024

#: Milliseconds after which a job's last state is forgotten.
JOB_TTL_MS = 3_600_000


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, as these processors need it; the session's setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _latest(rows: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """All rows in order of time, then of their other values."""
    out = [tuple(r) for part in rows for r in part[columns].itertuples(index=False)]
    return sorted(out, key=lambda r: (r[-1], *map(str, r[:-1])))


_UPDATE = ["stage", "progress", "message", "ts"]


class _LastState(StatefulProcessor):
    """SM05: the latest update of each job, forgotten ``ttl_ms`` after it was last stored."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "stage string, progress double, message string, ts timestamp", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = _latest(rows, _UPDATE)[-1]
        if self.state.exists():
            held = tuple(self.state.get())
            if pd.Timestamp(held[-1]) > pd.Timestamp(best[-1]):
                best = held
        self.state.update((*best[:3], pd.Timestamp(best[3]).to_pydatetime()))
        yield pd.DataFrame([(*key, *best)], columns=["job_id", *_UPDATE])

    def close(self) -> None:
        pass


def job_states(updates: DataFrame, ttl_ms: int = JOB_TTL_MS) -> DataFrame:
    """SM05: the latest update of every job that a batch has updates of; update mode.

    An update older than the state is no news, unless the state has been forgotten,
    which happens ``ttl_ms`` of processing time after the job's last update.
    """
    schema = "job_id string, stage string, progress double, message string, ts timestamp"
    keyed = updates.select("job_id", *_UPDATE).groupBy("job_id")
    return keyed.transformWithStateInPandas(_LastState(ttl_ms), schema, "Update", "ProcessingTime")


class _Bucket(StatefulProcessor):
    """The rows that a bucket of keys holds, as one value of Arrow bytes, and the one timer that is set for them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "rows binary, timer bigint")

    def held(self) -> tuple[list[pd.DataFrame], int | None]:
        if not self.state.exists():
            return [], None
        rows, timer = self.state.get()
        return [pa.ipc.open_stream(bytes(rows)).read_pandas()], timer

    def hold(self, rows: pd.DataFrame, before: int | None = None, timer: int | None = None) -> None:
        if before is not None and before != timer:
            self.handle.deleteTimer(before)
        if timer is not None and before != timer:
            self.handle.registerTimer(timer)
        if not len(rows):
            self.state.clear()
            return
        table, out = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_table(table)
        self.state.update((out.getvalue().to_pybytes(), timer))

    def close(self) -> None:
        pass


def _in_buckets(rows: DataFrame, key: str, buckets: int) -> GroupedData:
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).groupBy("_bucket")


def _named(rows: Iterator[pd.DataFrame], names: list[str]) -> list[pd.DataFrame]:
    """The first columns of the rows under these names: computed columns may come under others."""
    return [part.iloc[:, : len(names)].set_axis(names, axis=1) for part in rows]


class _Lives(_Bucket):
    """SM05 in event time: a life of a job ends when it is silent for ``ttl_ms``; then its last state comes out."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    columns = ["job_id", "stage", "progress", "message", "us", "updates"]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, before = self.held()
        new = pd.concat(_named(rows, self.columns[:-1]))
        all_ = pd.concat([*held, new.assign(updates=1, first=new["us"])])
        all_ = all_.sort_values(["job_id", "first", "us", "stage", "progress", "message"], na_position="first", ignore_index=True)
        job = all_["job_id"].fillna("").ne(all_["job_id"].fillna("").shift()) | all_["job_id"].isna().ne(all_["job_id"].isna().shift())
        until = all_["us"].groupby(job.cumsum()).cummax()
        life = (job | (all_["first"] - until.shift(fill_value=0) > self.ttl_ms * 1000)).cumsum()
        all_ = all_.assign(_life=life, _job=job.cumsum())
        sums = all_.groupby("_life").agg(updates=("updates", "sum"), first=("first", "min"), _job=("_job", "first"))
        last = all_.sort_values(["_life", "us", "stage", "progress", "message"], na_position="first").drop_duplicates("_life", keep="last")
        lives = last.drop(columns=["updates", "first", "_job"]).join(sums, "_life")
        going = ~lives.duplicated("_job", keep="last")
        kept = lives[going][[*self.columns, "first"]]
        self.hold(kept, before, int(self._ends(kept).min()))
        if not going.all():
            yield lives[~going][self.columns]

    def _ends(self, lives: pd.DataFrame) -> pd.Series:
        return lives["us"] // 1000 + self.ttl_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _ = self.held()
        for lives in held:
            ended = self._ends(lives) <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
            left = lives[~ended]
            self.hold(left, None, int(self._ends(left).min()) if len(left) else None)
            if ended.any():
                yield lives[ended][self.columns]


def job_lives(updates: DataFrame, ttl_ms: int = JOB_TTL_MS, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """SM05 in event time, so that a replay gives the same: (job, last update, updates) of every life that has ended; append mode.

    A life ends ``ttl_ms`` after its last update, once the watermark has passed that
    or a later update of the job is there.
    """
    timed = updates.select("job_id", "stage", "progress", "message", F.unix_micros("ts").alias("us"), "ts").withWatermark("ts", late)
    schema = "job_id string, stage string, progress double, message string, us long, updates long"
    ended = _in_buckets(timed, "job_id", buckets).transformWithStateInPandas(_Lives(ttl_ms), schema, "Append", "EventTime")
    return ended.select("job_id", "stage", "progress", "message", F.timestamp_micros("us").alias("ts"), "updates")


# growing coverage


def depth_steps(hits: DataFrame, key: str, start: str = "ref_start", end: str = "ref_end") -> DataFrame:
    """(key, pos, step, hits): where depth rises and falls, summed up in the task that reads the hits.

    So a gene with a third of all hits costs a row per place and Arrow batch.
    """
    kind = hits.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch]).to_pandas()
            up = pd.DataFrame({key: t[key], "pos": t[start], "step": 1, "hits": 1})
            down = pd.DataFrame({key: t[key], "pos": t[end], "step": -1, "hits": 0})
            out = pd.concat([up, down]).groupby([key, "pos"], as_index=False, dropna=False).sum()
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    cast = hits.select(key, F.col(start).cast("long").alias(start), F.col(end).cast("long").alias(end))
    return cast.mapInArrow(run, f"{key} {kind}, pos long, step long, hits long")


class _Coverage(_Bucket):
    """SM06: the steps of the genes' depths so far; a gene's hits are at its first step."""

    def __init__(self, key: str):
        self.key = key

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, _ = self.held()
        new = pd.concat(_named(rows, [self.key, "pos", "step", "hits"]))
        all_ = pd.concat([*(h.assign(_new=False) for h in held), new.assign(_new=True)])
        steps = all_.groupby([self.key, "pos"], dropna=False, as_index=False).agg(step=("step", "sum"), hits=("hits", "sum"), _new=("_new", "max"))
        gene = steps.groupby(self.key, dropna=False).ngroup().to_numpy()
        pos, step = steps["pos"].to_numpy(np.int64), steps["step"].to_numpy(np.int64)
        first = np.flatnonzero(np.diff(gene, prepend=-1))
        total = np.cumsum(step)
        depth = total - np.repeat((total - step)[first], np.diff(first, append=len(gene)))
        width = np.diff(pos, append=0)
        width[np.append(first[1:], len(gene)) - 1] = 0
        hits, hit = np.add.reduceat(steps["hits"].to_numpy(np.int64), first), np.logical_or.reduceat(steps["_new"].to_numpy(bool), first)
        at_first = np.zeros(len(gene), np.int64)
        at_first[first] = hits
        self.hold(steps.assign(hits=at_first)[(step != 0) | (at_first != 0)][[self.key, "pos", "step", "hits"]])
        sums = {"hits": hits, "covered": np.add.reduceat(width * (depth > 0), first), "bases": np.add.reduceat(depth * width, first), "max_depth": np.maximum(0, np.maximum.reduceat(depth, first))}
        yield pd.DataFrame({self.key: steps[self.key].iloc[first].reset_index(drop=True), **sums})[hit]


def growing_coverage(hits: DataFrame, key: str = "gene_id", start: str = "ref_start", end: str = "ref_end", buckets: int = BUCKETS) -> DataFrame:
    """SM06: (gene, hits, covered, bases, max_depth) over all batches so far, of each gene that a batch hits; update mode.

    There is no watermark and no row is late: any split of the hits into batches ends
    with the same rows as one batch of all.  A gene's state is two numbers for each
    place where its depth changes.
    """
    kind = hits.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, hits long, covered long, bases long, max_depth long"
    return _in_buckets(depth_steps(hits, key, start, end), key, buckets).transformWithStateInPandas(_Coverage(key), schema, "Update", "None")


# delayed retries


class _Waiting(_Bucket):
    """SM03: failed jobs until their next try; a timer at the earliest such time gives back all that are due."""

    def __init__(self, names: list[str]):
        self.names = names

    def _parted(self, jobs: pd.DataFrame, before: int | None, now: int) -> Iterator[pd.DataFrame]:
        due = jobs["_at"] <= now
        left = jobs[~due]
        self.hold(left, before, int(left["_at"].min()) if len(left) else None)
        if due.any():
            yield jobs[due].drop(columns="_at").assign(retries=lambda d: d["retries"] + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, before = self.held()
        jobs = pd.concat([*held, *_named(rows, self.names)]).drop_duplicates(["job_id", "_at"], keep="last")
        yield from self._parted(jobs, before, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs())
        for jobs in self.held()[0]:
            yield from self._parted(jobs, None, now)


def due_again(failed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """SM03: the jobs of ``jobs.routed`` with verdict retry, each once, when its next try is due, with one retry more; append mode.

    The wait is a timer in the state store, so it outlives the query that set it.
    """
    fields = [f for f in failed.schema.fields if f.name in ("sample_id", "stage", "progress", "message", "code", "retries", "ts")]
    names = [f.name for f in fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    waiting = failed.where("verdict = 'retry'").select("job_id", F.unix_millis("next_try").alias("_at"), *names)
    return _in_buckets(waiting, "job_id", buckets).transformWithStateInPandas(_Waiting(waiting.columns), f"job_id string, {schema}", "Append", "ProcessingTime")
