import os

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from chronolith.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(queries.oracle_sql()[name]).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.queries()[name](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)[list(want.columns)]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_pipeline_keeps_what_its_stages_keep(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
            assert out.select("doc_id").subtract(kept.select("doc_id")).count() == 0
            assert out.count() <= kept.count()
            kept = out
    want = sorted((r.doc_id, r.sample, r.ids) for r in out.collect())
    assert sorted((r.doc_id, r.sample, r.ids) for r in corpus_pipeline.run(spark, SF).collect()) == want
    assert {d for d, _, _ in want} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_pipeline_removes_its_rows_when_a_stage_fails(spark, tmp_path, monkeypatch):
    from chronolith.llm.components import shared_folder

    def fails(spark, docs, sf_dir):
        assert docs.count()
        raise RuntimeError("stopped")

    before = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", lambda s, docs, d: docs), ("b", lambda s, docs, d: docs), ("c", fails)])
    with pytest.raises(RuntimeError, match="stopped"):
        corpus_pipeline.run(spark, SF)
    assert not {x for x in set(os.listdir(shared_folder(spark).removeprefix("file:"))) - before if x.startswith("pipeline-")}


def test_folders_must_be_shared_on_a_cluster():
    from types import SimpleNamespace

    from chronolith.llm.components import shared_folder

    unset = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getConf=lambda: unset, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context, conf=unset))
