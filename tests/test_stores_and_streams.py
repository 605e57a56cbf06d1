"""Bucketed merges, the log source, daily sessions with state, SQL functions and resumed runs."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from chronolith.functions import registered
from chronolith.operators import questions
from chronolith.sources import buckets, record_log
from chronolith.streaming import daily, ingest


def test_merge_leaves_other_buckets_alone(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long, v string, at int"
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    rows = lambda: sorted(tuple(r) for r in buckets.read_buckets(spark, path, schema).collect())
    buckets.merge(spark.createDataFrame([(i, "a", 0) for i in range(200)], schema), path, ["id"], newest="at", buckets=16)
    want = {i: (i, "a", 0) for i in range(200)}
    for number in (1, 2, 3):
        before = files()
        some = buckets.merge(spark.createDataFrame([(7 * number, "old", 1), (7 * number, "new", 2), (1000 + number, "x", 0)], schema), path, ["id"], newest="at", buckets=16)
        want |= {7 * number: (7 * number, "new", 2), 1000 + number: (1000 + number, "x", 0)}
        assert rows() == sorted(want.values()) and len(some) <= 2
        after = files()
        kept = {f: m for f, m in before.items() if int(f.split("bucket=")[1].split("/")[0]) not in some}
        assert kept and all(after.get(f) == m for f, m in kept.items())
    buckets.merge(spark.createDataFrame([(7, "gone", 9)], schema), path, ["id"], newest="at", delete="v = 'gone'", buckets=16)
    assert rows() == sorted(v for k, v in want.items() if k != 7)
    assert buckets.merge(spark.createDataFrame([], schema), path, ["id"], buckets=16) == []


def test_repeated_key_three_batches_later(spark, tmp_path):
    path, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    names = []
    for batch in ([(1, "a"), (2, "b")], [(3, "c")], [(4, "d")], [(1, "a"), (5, "e")]):
        spark.createDataFrame(batch, "id long, user string").write.mode("append").parquet(path)
        stream = spark.readStream.schema("id long, user string").parquet(path)
        ingest.ingest_batches(stream, out, check, "id", "user").trigger(availableNow=True).start().awaitTermination(60)
        now = set(glob.glob(f"{out}/bucket=*/batch=*/*.parquet"))
        assert set(names) <= now
        names = now
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5]


def test_log_source(spark, tmp_path):
    record_log.register(spark)
    path, schema = str(tmp_path / "log"), "id string, v long, tags array<string>"
    read = lambda: sorted((r.id, r.v) for r in spark.read.format("record_log").schema(schema).load(path).collect())
    first = spark.createDataFrame([("a", 1, ["x"]), ("b", None, None)], schema)
    first.write.format("record_log").mode("append").save(path)
    spark.createDataFrame([("c", 3, [])], schema).write.format("record_log").mode("append").save(path)
    assert read() == [("a", 1), ("b", None), ("c", 3)]
    names = sorted(os.listdir(path))
    fails = F.when(F.col("id") == "z", F.raise_error(F.lit("stopped"))).otherwise(F.col("v")).cast("long")
    odd = spark.createDataFrame([("y", 1, None), ("z", 2, None)], schema).repartition(2).withColumn("v", fails)
    with pytest.raises(Exception, match="stopped"):
        odd.write.format("record_log").mode("append").save(path)
    assert read() == [("a", 1), ("b", None), ("c", 3)] and sorted(os.listdir(path)) == names
    with open(f"{path}/torn.jsonl", "w") as f:
        f.write('{"id": "d", "v": 4}\n{"id": "e", "v"')
    assert read() == [("a", 1), ("b", None), ("c", 3), ("d", 4)]
    for text, why in (('{"id": "f"}\n{"id": "f"}\n', "comes twice"), ('{"id": "f"}\n{"id":\n{"id": "g"}\n', "malformed")):
        with open(f"{path}/torn.jsonl", "w") as f:
            f.write(text)
        with pytest.raises(Exception, match=why):
            read()
    spark.createDataFrame([("only", 1, None)], schema).write.format("record_log").mode("overwrite").save(path)
    assert read() == [("only", 1)]


def test_daily_sessions_over_restarts(spark, tmp_path):
    path, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    at = lambda d, h: dt.datetime(2024, 1, d, h)

    def run(rows):
        spark.createDataFrame(rows, "user string, ts timestamp, text string").write.mode("append").parquet(path)
        stream = spark.readStream.schema("user string, ts timestamp, text string").parquet(path)
        q = daily.daily_sessions(stream, "20 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(90)
        assert q.exception() is None
        return sorted((r.user, str(r.day), r.kind, r.turns, r.text) for r in spark.read.schema(daily.OUT).parquet(out).collect())

    first = [("a", "2024-01-01", "session", 2, "w\nx")]
    assert run([("a", at(1, 9), "x"), ("a", at(1, 8), "w"), ("a", at(2, 9), "y"), ("b", at(1, 3), "z")]) == first
    late = ("a", "2024-01-01", "late", 1, "late")
    second = sorted([*first, late, ("a", "2024-01-02", "session", 2, "y\nmore")])
    assert run([("a", at(2, 11), "more"), ("a", at(1, 10), "late"), ("a", at(9, 1), None)]) == second
    # The watermark passes the ends of days that nothing followed: their timers close them.
    got = run([("c", dt.datetime(2024, 2, 20), "far")])
    assert got == sorted([*second, ("a", "2024-01-09", "session", 1, ""), ("b", "2024-01-01", "session", 1, "z")])
    assert {(r.week, r.month) for r in spark.read.schema(daily.OUT).parquet(out).where("kind = 'late'").collect()} == {("2024-W01", "2024-01")}


def test_functions_in_sql(spark):
    registered.register(spark)
    row = spark.sql("SELECT iso_week(DATE'2026-12-28') a, iso_week(DATE'2027-01-03') b, week_start(DATE'2026-12-31') c, retention(5, 1) d, pair_key('y', 'x') e, guarded_ratio(1, 0) f").first()
    assert (row.a, row.b, str(row.c), row.e, row.f) == ("2026-W53", "2026-W53", "2026-12-28", "x|y", 0.0) and abs(row.d - 0.36787944) < 1e-8
    texts = spark.createDataFrame([(1, "One two. Three four! Five six seven eight nine."), (2, None), (3, ""), (4, "x" * 50), (5, "   ")], "id int, t string")
    got = spark.sql("SELECT x.id, w.* FROM {x} x, LATERAL sentence_windows(x.t, 20, 5) w", x=texts).collect()
    by = {i: [r.piece for r in sorted(got, key=lambda r: r.position) if r.id == i] for i in range(1, 6)}
    assert by[1] == ["One two. Three four!", "four! Five six seven", "seven eight nine."] and by[4] == ["x" * 20] * 3 and not by[2] and not by[3] and not by[5]


def test_runs_are_resumed_where_they_stopped(spark):
    months = spark.createDataFrame([(u, m) for u in "abcdef" for m in ("2024-01", "2024-02")], "user string, month string")
    log = [("a", "2024-01", "build_started", 1), ("b", "2024-01", "build_started", 1), ("b", "2024-01", "build_ended", 2), ("c", "2024-01", "evaluated", 3), ("d", "2024-01", "evaluated", 3), ("d", "2024-02", "evaluated", 4), ("e", "2024-02", "build_started", 1)]
    plan = questions.resume_plan(months, spark.createDataFrame(log, "user string, month string, event string, at int"))
    assert {r.user: (r.month, r.action) for r in plan.collect()} == {"a": ("2024-01", "restore"), "b": ("2024-01", "evaluate"), "c": ("2024-02", "build"), "d": ("2024-02", "done"), "e": ("2024-01", "mismatch"), "f": ("2024-01", "build")}
    rows = spark.createDataFrame([("a", "2024-01", 1), ("b", "2024-01", 2)], "user string, month string, v int")
    assert [r.v for r in questions.rolled_back(rows, plan).collect()] == [2]
