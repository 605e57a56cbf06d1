"""A keyed table of parquet files in buckets of its keys, of which a merge reads and replaces those that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import settled

BUCKETS = 64


def bucket(keys: list[str], buckets: int = BUCKETS) -> Column:
    """The bucket of a key, from its hash."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def touched(batch: DataFrame, keys: list[str], buckets: int = BUCKETS) -> list[int]:
    """The buckets of a batch's keys, no more than there are."""
    return sorted(r[0] for r in batch.select(bucket(keys, buckets)).distinct().collect())


def exists(spark: SparkSession, path: str) -> bool:
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    return files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)


def read_buckets(spark: SparkSession, path: str, schema: str, some: list[int] | None = None) -> DataFrame:
    """The table's rows (``schema``), or those of some buckets, whose folders alone are listed and read."""
    rows = spark.read.schema(f"{schema}, bucket int").parquet(path)
    return (rows.where(F.col("bucket").isin(some)) if some is not None else rows).drop("bucket")


def merge(batch: DataFrame, path: str, keys: list[str], *, newest: str | None = None, delete: str | None = None, buckets: int = BUCKETS) -> list[int]:
    """Inserts or replaces the rows of ``batch`` by their keys, and gives the buckets that were written anew.

    Of rows that repeat a key in the batch that of the greatest ``newest`` counts (without it, any one); rows for which the condition ``delete`` holds
    remove their key.  The merged rows are settled in the shared folder before their buckets are replaced, so that a task
    that runs again doesn't read what it has written; files of other buckets stay as they are.
    """
    spark, columns = batch.sparkSession, batch.columns
    latest = batch.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(newest) if newest else F.lit(0)).alias("_r")).select("_r.*")
    some = touched(latest, keys, buckets)
    if not some:
        return some
    rows = latest.where(~F.coalesce(F.expr(delete), F.lit(False))) if delete else latest
    if exists(spark, path):
        same = None
        held = latest.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        for i, k in enumerate(keys):
            one = F.col(k).eqNullSafe(F.col(f"_k{i}"))
            same = one if same is None else same & one
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
        rows = rows.unionByName(read_buckets(spark, path, schema, some).join(held, same, "left_anti"))
    merged = settled(rows.withColumn("bucket", bucket(keys, buckets)).repartition(len(some), "bucket"))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    gone = sorted(set(some) - {r[0] for r in merged.select("bucket").distinct().collect()})
    for b in gone:  # a bucket of which every row was removed
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return some
