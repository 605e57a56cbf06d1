"""Every query with SQL gives what DuckDB gives on the same tables; the others run."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from chronolith.plans import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    def plain(v):
        if v is None or v is pd.NaT or isinstance(v, float) and np.isnan(v):
            return "null"
        if isinstance(v, (float, np.floating)):
            return repr(round(float(v), 6))
        return str(v)[:10] if hasattr(v, "isoformat") else str(v)

    df = df[sorted(df.columns)]
    kinds = [c for c in df.columns if str(df[c].dtype) in ("float64", "Int64", "Float64")]
    df = df.assign(**{c: df[c].astype("float64") for c in kinds}).astype(object)
    return sorted(tuple(map(plain, r)) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    q = QUERIES[name]
    got = q.run(spark, SF).toPandas()
    if q.sql:
        want = duck.sql(q.sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        kinds = [c for c in want.columns if str(got[c].dtype) in ("float64", "Int64") or str(want[c].dtype) in ("float64", "Int64")]
        assert rows(got.assign(**{c: got[c].astype("float64") for c in kinds})) == rows(want.assign(**{c: want[c].astype("float64") for c in kinds}))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
