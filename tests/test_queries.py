"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import os

import pandas as pd
import pytest

from tidewater.plans.catalogue import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(df):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        v = v.item() if hasattr(v, "item") else v
        return v + 0.0 if isinstance(v, float) else v

    rows = [tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and abs(p - q) <= 2e-4 * max(1, abs(p))) for p, q in zip(x, y)), (x, y)
