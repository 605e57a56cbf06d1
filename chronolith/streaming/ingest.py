"""Streaming forms: idempotent ingest, sessions, windows with late data, recall reinforcement."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import buckets


def event_time(stream: DataFrame, column: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The stream with a watermark; times without zone are taken as the session's."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def tumbling(stream: DataFrame, keys: list[str], width: str, slide: str | None = None, column: str = "ts") -> DataFrame:
    """Counts and sums for each window (sliding with ``slide``); late rows beyond the watermark are left out."""
    window = F.window(column, width, slide) if slide else F.window(column, width)
    return stream.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(stream: DataFrame, keys: list[str], gap: str, column: str = "ts") -> DataFrame:
    """Buffered turns flushed as one session after ``gap`` without any."""
    return stream.groupBy(F.session_window(column, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def distinct_sessions(stream: DataFrame, key: str) -> DataFrame:
    """The first row of each key within the watermark: adding the same session again does nothing."""
    return stream.dropDuplicatesWithinWatermark([key])


def conflicts(batch: DataFrame, store: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys that the store holds with another payload."""
    held = store.select(F.col(key).alias("_k"), F.sha2(F.col(payload), 256).alias("_h")).distinct()
    return batch.join(held, F.col(key) == F.col("_k")).where(F.sha2(F.col(payload), 256) != F.col("_h")).select(key).distinct()


class ConflictError(ValueError):
    """A key came again with another payload."""


def ingest_batches(stream: DataFrame, path: str, checkpoint: str, key: str, payload: str | None = None):
    """Appends each micro-batch's new keys to a parquet folder, once.

    Keys of earlier batches are left out, and with ``payload`` a key that comes with another one stops the
    stream (``ConflictError``).  A batch that runs again doesn't see its own rows, and replaces them.  The folder is laid out by buckets of
    keys, of which a batch reads those of its own keys alone; no file of an earlier batch is written again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if payload and (odd := batch.groupBy(key).agg(F.min(payload).alias("a"), F.max(payload).alias("z")).where("a <> z").limit(3).collect()):
            raise ConflictError(f"several payloads under {key} {[r[0] for r in odd]}")
        if buckets.exists(spark, path):
            schema = T.StructType([*batch.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])
            some = buckets.touched(batch, [key])
            earlier = spark.read.schema(schema).parquet(path).where(F.col("bucket").isin(some) & (F.col("batch") < number))
            if payload and (odd := conflicts(batch, earlier, key, payload).limit(3).collect()):
                raise ConflictError(f"other payloads under {key} {[r[0] for r in odd]}")
            batch = batch.join(earlier.select(key), key, "left_anti").select(*batch.columns)
        rows = batch.dropDuplicates([key]).withColumns({"bucket": buckets.bucket([key]), "batch": F.lit(number)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


RECALL_OUT = "memory_id long, strength long, last_recall date"


def reinforced(stream: DataFrame) -> DataFrame:
    """Each recall (memory_id, recalled) adds one to its memory's strength and moves its last recall; a row for each change."""

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        strength, last = state.get if state.exists else (1, None)
        for r in rows:
            strength += len(r)
            newest = max(r["recalled"])
            last = newest if last is None or newest > last else last
        state.update((strength, last))
        yield pd.DataFrame({"memory_id": [key[0]], "strength": [strength], "last_recall": [last]})

    return stream.groupBy("memory_id").applyInPandasWithState(update, RECALL_OUT, "strength long, last_recall date", "update", GroupStateTimeout.NoTimeout)
