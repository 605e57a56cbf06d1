"""Fit a model in one executor task on a bounded sample of rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit(sample: DataFrame, train: Callable, **parameters):
    """``train(list of texts as Arrow arrays, list of label arrays, **parameters)`` on all rows of ``sample``.

    The sample (columns text, label) must be bounded by its caller; it goes to one task,
    in the order of ``ord``, and only the fitted model comes back to the driver.
    """

    def run(batches):
        texts, labels = [], []
        for b in batches:
            texts.append(b.column(0))
            labels.append(b.column(1))
        model = train(texts, labels, **parameters)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    rows = sample.select("text", "label", "ord").repartition(1).sortWithinPartitions("ord")
    found = rows.mapInArrow(run, "model binary").collect()
    if not found:  # no partition at all: the sample's source is empty
        return train([], [], **parameters)
    return pickle.loads(bytes(found[0][0]))


#: Bytes of texts that a fit may take; a text of more than a sixteenth of it isn't learned from.
MAX_BYTES = 256 << 20


def rows_to_learn(documents: DataFrame) -> DataFrame:
    """(id, label, ord, mark, size) from (id, label, text): a row's place by its id's hash, and what tells its text from others."""
    return documents.select("id", "label", F.xxhash64("id").alias("ord"), F.xxhash64("text").alias("mark"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))


def with_texts(chosen: DataFrame, documents: DataFrame, order: list[str], max_bytes: int) -> DataFrame:
    """(text, label, ord) of the ``chosen`` rows (columns of ``rows_to_learn``, bounded by the caller), in ``order`` as far as their texts' bytes add up to ``max_bytes``.

    Only the chosen rows' figures are put in order in one task; they are broadcast to ``documents`` (id, label, text).
    """
    upto = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    taken = chosen.where(F.col("size") <= max_bytes // 16).withColumn("upto", upto).where(F.col("upto") <= max_bytes).select(F.col("id").alias("_id"), F.col("label").alias("_label"), "ord", F.col("mark").alias("_mark"))
    same = (F.col("id") == F.col("_id")) & F.col("label").eqNullSafe(F.col("_label")) & (F.xxhash64("text") == F.col("_mark"))
    found = documents.join(F.broadcast(taken), same)
    return found.groupBy("id", "label", "ord").agg(F.min("text").alias("text")).select("text", "label", "ord")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, most: int, train_rows, id_col: str, text_col: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(text, label, ord) of at most ``most`` labelled ids, those with the least hash, one row of each.

    ``train_rows`` is a condition on the text form of the id.  Rows without id or label are left
    out; an id labelled more than once takes the largest label, and of rows that repeat an id that with the
    least text hash is learned.  The ids are bounded by ``most``, so that they can be broadcast to the documents, and
    the rows by the ids; their texts are taken in order as long as they add up to ``max_bytes`` at most.
    """
    key = F.col(id_col).cast("string")
    ids = (
        labels.select(F.col(id_col).alias("_id"), key.alias("_key"), F.col(label).cast("int").alias("label"))
        .where(F.col("_id").isNotNull() & F.col("label").isNotNull())
        .where(train_rows(F.col("_key")))
        .groupBy("_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(most)
    )
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), F.col("id") == F.col("_id")).select("id", "label", "text")
    one = rows_to_learn(docs).groupBy("id", "label", "ord").agg(F.min(F.struct("mark", "size")).alias("m")).select("id", "label", "ord", "m.mark", "m.size")
    return with_texts(one, docs, ["ord", "id"], max_bytes)
