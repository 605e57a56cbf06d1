"""Rows that repeat an id or have none."""

import pytest

import corpus_pipeline
from chronolith.llm import decontaminate, simhash

from .helpers import documents

FIRST = "the quick brown fox jumps over the lazy dog by the river bank"
SECOND = "seventeen ponies were counted near an old mill before the storm came"


def kept(docs):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in docs.collect())


def test_simhash_decides_by_row(spark):
    """Id 5 repeats a text of id 3 and leads a group with id 9."""
    docs = documents(spark, [FIRST, FIRST, SECOND, SECOND], [3, 5, 5, 9])
    assert kept(simhash.deduplicate(docs)) == [(False, 3, FIRST), (False, 5, SECOND)]
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept(out) == [(False, 3, FIRST), (False, 5, SECOND)] and out.columns == docs.columns


def test_pipeline_keeps_one_row_of_each_group(spark):
    docs = documents(spark, [FIRST, FIRST, FIRST, SECOND, SECOND, None, ""], [None, 4, 4, None, None, None, 8])
    assert kept(corpus_pipeline.drop_near_duplicates(spark, docs, "")) == [(False, 4, FIRST), (False, 8, ""), (True, 0, SECOND)]


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_contamination_of_and_by_rows_without_an_id(spark, limit):
    items = spark.createDataFrame([(None, FIRST), (7, SECOND)], "item_id long, text string")
    docs = documents(spark, [FIRST, SECOND, "clean words", f"{FIRST} {SECOND}"], [1, None, None, None])
    got = decontaminate.contamination(docs, items, broadcast_bytes=limit).collect()
    assert sorted((r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got) == [(2, 0, 0, False), (12, 12, 1, True), (13, 13, 1, True), (25, 25, 2, True)]
    assert [r.text for r in decontaminate.remove_contaminated(docs, items, broadcast_bytes=limit).collect()] == ["clean words"]
    assert sorted(r.text for r in decontaminate.remove_spans(docs, items, broadcast_bytes=limit).collect()) == ["", "", "", "clean words"]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null and empty texts, null and repeated ids, and no rows at all go through every stage."""
    long = " ".join(f"word{i}" for i in range(60))
    odd = documents(spark, [None, "", FIRST, FIRST, SECOND, long, long + " more", None], [1, 2, 3, 3, None, 5, 6, None]).select("doc_id", "text", "lang", "source", "n_chars")
    for folder, docs in (("odd", odd), ("none", odd.limit(0))):
        d = f"{tmp_path}/{folder}"
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(3, 0, 0), (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, SECOND), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = corpus_pipeline.run(spark, d).collect()
        assert all(r.exact for r in got)
        assert len({r.doc_id for r in got}) <= 5 and (folder == "odd") == bool(got)
        assert all(r.doc_id is not None for r in got) and {r.doc_id for r in got if r.doc_id == 6} <= {6}
