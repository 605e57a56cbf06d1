"""Queries opN_<name> that apply each operator to its whole table, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, licenses, line_dedup, neighbours, quality, sentencepiece_sampling, simhash, substring_dedup, suffix_dedup, token_alignment, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _fold(n: int, r: int):
    """(whether an id's text form is in the fold held out, whether it may be learned)."""
    held = lambda key: F.coalesce(toxicity.bucket(key, n) == r, F.lit(False))
    return held, lambda key: ~held(key)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every text; ``exact`` tells that the ids decode to the text."""
    return sentencepiece_sampling.sample_segmentations(table(spark, sf_dir, "documents"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each text outside of 100-byte strings that start earlier; a null text is empty."""
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"))


def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each text outside of 50-word windows that start in an earlier document; a null text has none."""
    return substring_dedup.repeated_words(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest others of each vector whose id divides by 50; unusable vectors take no part."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each text, learned from two thirds of the ids; ``und`` without any letter."""
    held, learn = _fold(3, 1)
    docs = table(spark, sf_dir, "documents")
    out = language.identify_language(docs, language.fit_language(docs, train_rows=learn))
    return out.select("doc_id", held(F.col("doc_id").cast("string")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of each text, learned from four fifths of the labelled ids; empty texts are scored, too."""
    held, learn = _fold(5, 0)
    docs = table(spark, sf_dir, "documents")
    out = quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels"), train_rows=learn))
    return out.select("doc_id", held(F.col("doc_id").cast("string")).alias("held_out"), "score", "predicted", "top_passage")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document in windows of the benchmark, and whether they are a twentieth or more; null has none."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of each document; texts without words have fingerprint zero and are one group."""
    groups = simhash.fingerprint_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of each text, learned from three quarters of the labelled ids; empty texts are scored, too."""
    held, learn = _fold(4, 2)
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), train_rows=learn))
    return out.select("doc_id", held(F.col("doc_id").cast("string")).alias("held_out"), "score", "predicted")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each licence that a document holds, with its share and place; texts without words hold none."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each usable vector on the 16 leading components of the distinct vectors' covariance, scaled to variance one."""
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each text, and what stays without those that five or more documents share; a null text is one empty line."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers' tokens of each text overlap; texts that either doesn't give back whole have no tokens."""
    return token_alignment.alignment_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_suffix_array": op2_suffix_array,
        "op3_recompression": op3_recompression,
        "op4_neighbours": op4_neighbours,
        "op5_language_id": op5_language_id,
        "op6_quality": op6_quality,
        "op7_decontamination": op7_decontamination,
        "op8_simhash": op8_simhash,
        "op9_toxicity": op9_toxicity,
        "op10_licenses": op10_licenses,
        "op11_whitening": op11_whitening,
        "op12_line_dedup": op12_line_dedup,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_array": suffix_dedup.ORACLE_SQL,
        "op3_recompression": substring_dedup.ORACLE_SQL,
        "op7_decontamination": decontaminate.ORACLE_SQL,
        "op12_line_dedup": line_dedup.ORACLE_SQL,
    }
