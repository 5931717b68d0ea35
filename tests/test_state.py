"""Stateful streams: what is kept, what is forgotten, what comes back, whatever the batches."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from strandline.streaming import jobs, state

AT = dt.datetime(2024, 1, 1)
UPDATE = "job_id string, stage string, progress double, message string, ts timestamp"


def put(spark, folder, n, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/n={n}")


def run(spark, df, sink, checkpoint, mode="append", **trigger):
    """All that is there; a query with timers or a TTL in processing time never ends by itself, so it takes ``once``."""
    with state.rocks(spark):
        q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    assert q.awaitTermination(120)


def test_a_job_is_forgotten_after_its_ttl(spark, tmp_path):
    src, seen = f"{tmp_path}/in", []
    minute = lambda m: AT + dt.timedelta(minutes=m)

    def send(n, *rows):
        put(spark, src, n, rows, UPDATE)
        stream = jobs.file_events(spark, src, UPDATE, 100)
        run(spark, state.job_states(stream, ttl_ms=4000), lambda b, i: seen.append({r.job_id: r.stage for r in b.collect()}), f"{tmp_path}/c", "update", once=True)
        return seen[-1]

    assert send(1, ("a", "submitted", 0.0, "", minute(1)), ("a", "running", 0.5, "", minute(9)), ("b", "submitted", 0.0, "", minute(1))) == {"a": "running", "b": "submitted"}
    time.sleep(5)
    assert send(2, ("a", "old news", 0.1, "", minute(2)), ("c", "new", 0.0, "", minute(3))) == {"a": "old news", "c": "new"}  # forgotten by now
    # at once: still known
    assert send(3, ("c", "older", 0.0, "", minute(1))) in ({"c": "new"}, {"c": "older"})
    long = []
    for n in (1, 2):
        put(spark, f"{tmp_path}/in2", n, [("a", f"s{n}", 0.0, None, minute(10 - n))], UPDATE)
        run(spark, state.job_states(jobs.file_events(spark, f"{tmp_path}/in2", UPDATE)), lambda b, i: long.extend(r.stage for r in b.collect()), f"{tmp_path}/c2", "update", once=True)
    assert long == ["s1", "s1"]  # an hour has not passed


def lives(rows, ttl, end):
    out = []
    for job in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == job), key=lambda r: (r[4], *map(str, r[1:4])))
        life = []
        for r in [*mine, None]:
            if life and (r is None or r[4] - life[-1][4] > ttl):
                if r is not None or life[-1][4] + ttl <= end:
                    out.append((*life[-1], len(life)))
                life = []
            life += [r] if r else []
    return sorted(out)


def test_lives_in_event_time_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted(((f"j{rng.randrange(6)}", f"s{i}", i / 100, "m", AT + dt.timedelta(minutes=rng.randrange(3000))) for i in range(120)), key=lambda r: r[4])
    ttl = dt.timedelta(hours=1)
    for batches in (1, 4):
        src, got = f"{tmp_path}/in{batches}", []
        for n in range(batches):
            put(spark, src, n, rows[n * 120 // batches : (n + 1) * 120 // batches], UPDATE)
            stream = state.job_lives(jobs.file_events(spark, src, UPDATE, 100))
            run(spark, stream, lambda b, i: got.extend(tuple(r) for r in b.collect()), f"{tmp_path}/c{batches}")
        assert sorted(got) == lives(rows, ttl, rows[-1][4])


@pytest.mark.parametrize("batches", [1, 3])
def test_coverage_grows_to_that_of_one_batch(spark, tmp_path, batches):
    rng = random.Random(5)
    rows = [(rng.choice(["g1", "g1", "g2", "g3", None]), a := rng.randrange(50), a + rng.randrange(20)) for _ in range(300)]
    want = {}
    for g in {r[0] for r in rows}:
        depth = [sum(a <= p < b for k, a, b in rows if k == g) for p in range(80)]
        want[g] = (sum(r[0] == g for r in rows), sum(d > 0 for d in depth), sum(depth), max(depth))
    got = {}
    schema = "gene_id string, ref_start int, ref_end int"
    for n in range(batches):
        put(spark, f"{tmp_path}/in", n, rows[n::batches], schema)
        stream = state.growing_coverage(jobs.file_events(spark, f"{tmp_path}/in", schema, 100))
        run(spark, stream, lambda b, i: got.update({r.gene_id: tuple(r)[1:] for r in b.collect()}), f"{tmp_path}/c", "update")
    assert got == want


def test_a_job_that_fails_twice_comes_back_twice(spark, tmp_path):
    """Fails, waits, fails, waits, succeeds; the wait is real and no try is lost or doubled."""
    folder = lambda x: f"{tmp_path}/{x}"
    now = dt.datetime.now()
    put(spark, folder("in"), 0, [("j1", "s", "run", 0.0, "", 0, 0, now), ("j2", "s", "run", 0.0, "", 0, 0, now), ("j3", "s", "run", 0.0, "", 0, 0, now)], jobs.JOB)
    schema = spark.read.parquet(folder("in")).drop("n").schema
    fails = F.when(F.col("job_id") == "j1", 2).when(F.col("job_id") == "j3", 9).otherwise(0)
    bad = F.col("retries") < fails
    work = lambda b: b.withColumn("code", F.when(bad, 7).otherwise(0)).withColumn("message", F.when(bad, "Connection refused").otherwise("ok")).withColumn("ts", F.current_timestamp())
    sinks = [jobs.to_folder(folder(k)) for k in ("done", "retry", "dead")]

    def tries():
        q = jobs.run_jobs(jobs.file_events(spark, folder("in"), schema, 100), work, *sinks, folder("c1"), max_retries=2, base=1, trigger={"availableNow": True})
        assert q.awaitTermination(120)

    tries()
    wanted = spark.read.parquet(folder("retry")).drop("batch").schema
    again = state.due_again(jobs.file_events(spark, folder("retry"), wanted, 100))
    with state.rocks(spark):
        q = again.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{folder('in')}/n={100 + i}")).option("checkpointLocation", folder("c2")).trigger(processingTime="1 second").start()
    until = time.time() + 90
    while time.time() < until and len(spark.read.parquet(folder("done")).where("job_id = 'j1'").take(1)) == 0 or not (tmp_path / "dead").exists() or not spark.read.parquet(folder("dead")).take(1):
        assert time.time() < until and q.isActive, q.exception()
        tries()
    q.stop()
    done = {r.job_id: r.retries for r in spark.read.parquet(folder("done")).collect()}
    assert done == {"j1": 2, "j2": 0} and spark.read.parquet(folder("done")).count() == 2
    assert [(r.job_id, r.retries) for r in spark.read.parquet(folder("dead")).collect()] == [("j3", 2)]
    waits = spark.read.parquet(folder("retry")).select("job_id", "retries").collect()
    assert sorted(map(tuple, waits)) == [("j1", 0), ("j1", 1), ("j3", 0), ("j3", 1)]


@pytest.mark.parametrize("buckets", [1, 3])
def test_keys_share_the_state_of_a_bucket(spark, tmp_path, buckets):
    """Lives, coverage and retries of many keys in few states, over two batches each."""
    rng = random.Random(buckets)
    rows = sorted(((f"j{rng.randrange(40)}", f"s{i}", i / 100, None, AT + dt.timedelta(minutes=rng.randrange(3000))) for i in range(300)), key=lambda r: r[4])
    hits = [(rng.randrange(50), a := rng.randrange(50), a + rng.randrange(1, 20)) for _ in range(300)]
    failed = [(f"j{i}", "s", 7, i % 3, "retry", AT if i % 2 else dt.datetime(2999, 1, 1)) for i in range(60)]
    ended, covered, due = [], {}, []
    schemas = {"u": UPDATE, "h": "gene_id long, ref_start int, ref_end int", "f": "job_id string, sample_id string, code int, retries int, verdict string, next_try timestamp"}
    live = lambda x: jobs.file_events(spark, f"{tmp_path}/{x}", schemas[x], 100)
    for n in range(2):
        for x, all_ in (("u", rows), ("h", hits), ("f", failed)):
            put(spark, f"{tmp_path}/{x}", n, all_[n * len(all_) // 2 : (n + 1) * len(all_) // 2], schemas[x])
        run(spark, state.job_lives(live("u"), buckets=buckets), lambda b, i: ended.extend(tuple(r) for r in b.collect()), f"{tmp_path}/cu")
        run(spark, state.growing_coverage(live("h"), buckets=buckets), lambda b, i: covered.update({r.gene_id: tuple(r)[1:] for r in b.collect()}), f"{tmp_path}/ch", "update")
        run(spark, state.due_again(live("f"), buckets=buckets), lambda b, i: due.extend((r.job_id, r.retries) for r in b.collect()), f"{tmp_path}/cf", once=True)
    assert sorted(ended, key=str) == sorted(lives(rows, dt.timedelta(hours=1), rows[-1][4]), key=str)
    for g in {r[0] for r in hits}:
        depth = [sum(a <= p < b for k, a, b in hits if k == g) for p in range(80)]
        assert covered[g] == (sum(r[0] == g for r in hits), sum(d > 0 for d in depth), sum(depth), max(depth))
    assert sorted(due) == sorted((j, r + 1) for j, _, _, r, _, at in failed if at == AT)
