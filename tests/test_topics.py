"""The topic sink and source: whole batches, in order, each published once."""

import os

import pytest

from strandline.sources import topics
from strandline.streaming import jobs

SCHEMA = "id long, name string"


def publish(spark, base):
    q = topics.publish(jobs.file_events(spark, f"{base}/in", SCHEMA, 1), f"{base}/topic", "id", f"{base}/c", {"availableNow": True})
    assert q.awaitTermination(120)
    return q


def got(spark, base):
    return sorted((r.id, r.name) for r in topics.consume(spark, f"{base}/topic", SCHEMA).collect())


@pytest.mark.parametrize("lost", [1, 2])
def test_a_repeated_batch_is_published_once(spark, tmp_path, lost):
    """The query dies after it has published, before it has noted that: its last batches run again."""
    rows = [(i, f"n{i}" if i % 3 else None) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).repartition(3, "id").write.parquet(f"{tmp_path}/in")
    publish(spark, tmp_path)
    assert got(spark, tmp_path) == rows and len(topics._log(str(tmp_path / "topic"))) == 3
    for n in sorted((int(x) for x in os.listdir(tmp_path / "c" / "commits") if x.isdigit()), reverse=True)[:lost]:
        os.remove(tmp_path / "c" / "commits" / str(n))
        (tmp_path / "c" / "commits" / f".{n}.crc").unlink(missing_ok=True)
    before = {x: (tmp_path / "topic" / "log" / x).read_text() for x in os.listdir(tmp_path / "topic" / "log")}
    publish(spark, tmp_path)
    assert got(spark, tmp_path) == rows
    assert {x: (tmp_path / "topic" / "log" / x).read_text() for x in os.listdir(tmp_path / "topic" / "log")} == before
    named = sum(len(topics._files(str(tmp_path / "topic"), [n])) for n in topics._log(str(tmp_path / "topic")))
    assert len(os.listdir(tmp_path / "topic" / "data")) == named  # what the repeated batch wrote is gone


def test_files_of_an_unfinished_batch_are_not_read(spark, tmp_path):
    spark.createDataFrame([(1, "a")], SCHEMA).write.parquet(f"{tmp_path}/in")
    publish(spark, tmp_path)
    writer = topics._Writer({"path": str(tmp_path / "topic")})
    raw = spark.createDataFrame([("9", '{"id": 9}')], "key string, value string").toArrow().to_batches()
    message = writer.write(iter(raw))
    assert got(spark, tmp_path) == [(1, "a")]
    writer.abort([message, None], 7)
    assert not (tmp_path / "topic" / message.file).exists()
    writer.commit([writer.write(iter(raw)), writer.write(iter([]))], 7)
    assert got(spark, tmp_path) == [(1, "a"), (9, None)]


def test_a_stream_of_a_topic_follows_it(spark, tmp_path):
    def follow():
        q = topics.consume(spark, f"{tmp_path}/topic", SCHEMA, stream=True).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert q.awaitTermination(120)
        return sorted((r.batch, r.id) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    publish(spark, tmp_path)
    assert follow() == [(0, 1), (0, 2)] == follow()
    spark.createDataFrame([(3, "c")], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    publish(spark, tmp_path)
    assert follow() == [(0, 1), (0, 2), (1, 3)]


def test_an_empty_topic(spark, tmp_path):
    assert topics.consume(spark, f"{tmp_path}/nothing", SCHEMA).count() == 0
