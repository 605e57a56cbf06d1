import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronolith.streaming import ingest

SCHEMA = "id long, user string, ts timestamp, value double"


def _write(spark, path, rows):
    spark.createDataFrame([(i, u, dt.datetime(2024, 1, 1, 0, m), v) for i, u, m, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _run(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_windows_and_late_rows(spark, tmp_path):
    path = str(tmp_path / "in")
    _write(spark, path, [(1, "a", 1, 1.0), (2, "a", 4, 2.0), (3, "b", 7, 4.0)])
    stream = ingest.event_time(spark.readStream.schema(SCHEMA).parquet(path), delay="5 minutes")
    _run(ingest.tumbling(stream, ["user"], "5 minutes"), "w", "complete")
    assert {(r.user, r.n, r.total) for r in spark.table("w").collect()} == {("a", 2, 3.0), ("b", 1, 4.0)}


def test_sessions(spark, tmp_path):
    path = str(tmp_path / "in")
    _write(spark, path, [(1, "a", 1, 1.0), (2, "a", 3, 1.0), (3, "a", 30, 1.0), (4, "a", 59, 1.0)])
    stream = ingest.event_time(spark.readStream.schema(SCHEMA).parquet(path), delay="1 minutes")
    _run(ingest.sessions(stream, ["user"], "10 minutes"), "s", "append")
    assert set(r.n for r in spark.table("s").collect()) <= {1, 2}  # sessions behind the watermark have been flushed
    batch = ingest.sessions(spark.read.parquet(path), ["user"], "10 minutes")
    assert sorted(r.n for r in batch.collect()) == [1, 1, 2]


def test_ingest_is_idempotent(spark, tmp_path):
    path, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for rows in ([(1, "a", 1, 1.0), (1, "a", 1, 1.0), (2, "a", 2, 1.0)], [(3, "b", 3, 1.0)]):
        _write(spark, path, rows)
        q = ingest.ingest_batches(spark.readStream.schema(SCHEMA).parquet(path), out, check, "id").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    store = spark.createDataFrame([(1, "x")], "id long, payload string")
    batch = spark.createDataFrame([(1, "y"), (2, "z")], "id long, payload string")
    assert [r.id for r in ingest.conflicts(batch, store, "id", "payload").collect()] == [1]


def test_keys_of_earlier_batches(spark, tmp_path):
    """A key that comes again in a later batch adds nothing, and one with another payload stops the stream."""
    path, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def run(rows):
        _write(spark, path, rows)
        q = ingest.ingest_batches(spark.readStream.schema(SCHEMA).parquet(path), out, check, "id", "user").trigger(availableNow=True).start()
        q.awaitTermination(120)

    run([(1, "a", 1, 1.0), (2, "a", 2, 1.0)])
    run([(1, "a", 9, 1.0), (3, "b", 3, 1.0)])
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="other payloads under id"):
        run([(2, "other", 2, 1.0), (4, "c", 4, 1.0)])
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_reinforcement(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(7, dt.date(2024, 1, 1)), (7, dt.date(2024, 1, 3)), (8, dt.date(2024, 1, 2))], "memory_id long, recalled date").write.parquet(path)
    stream = spark.readStream.schema("memory_id long, recalled date").parquet(path)
    _run(ingest.reinforced(stream), "r", "update")
    assert {(r.memory_id, r.strength, str(r.last_recall)) for r in spark.table("r").collect()} == {(7, 3, "2024-01-03"), (8, 2, "2024-01-02")}
    assert spark.table("r").where(F.col("strength") < 2).count() == 0
