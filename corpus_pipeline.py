"""A corpus through its stages; each stage's rows are written and read again as the next one's documents.

Every stage takes (spark, docs, sf_dir), with docs in the columns of ``documents``, and works on all that
its predecessor kept.  The stages learn and search on their own input alone, beside the tables
``labels`` and ``benchmark`` of ``sf_dir``.

Defined results: a null text is scored as an empty one; of rows that repeat an id, or have none, each is decided
by itself, and one row of a group of near copies stays, that of the least id (none: the last); cutting
repeats makes a null text empty; a text without words isn't contaminated and has one segmentation, the empty
one; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import decontaminate, sentencepiece_sampling, simhash, suffix_dedup, toxicity
from chronolith.llm.components import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels of ``docs``."""
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the least id; also of rows that repeat an id or have none."""
    return simhash.deduplicate(docs, one_row=True)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that lie in 100-byte strings which start earlier."""
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in windows of the benchmark."""
    return decontaminate.remove_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each text."""
    return sentencepiece_sampling.sample_segmentations(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("sentencepiece", encode),
]

#: A learned stage decides the rows, so that no SQL gives them.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's rows written to the shared folder and read again.

    A stage's rows are deleted when the next one's are written, and all of them if a stage fails; those that the last stage
    reads stay, as its rows aren't computed before they are asked for.
    """
    docs = _table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for i, (name, stage) in enumerate(STAGES):
            out = stage(spark, docs, sf_dir)
            if i + 1 == len(STAGES):
                return out
            out.write.parquet(f"{folder}/{i}_{name}")
            docs = spark.read.parquet(f"{folder}/{i}_{name}")
            if i:
                _delete(spark, f"{folder}/{i - 1}_{STAGES[i - 1][0]}")
    except BaseException:
        _delete(spark, folder)
        raise
