"""Every registered query of the engine against its SQL on DuckDB, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from fieldspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x) or str(x) == "<NA>":
            return None
        return round(float(x), 4) if hasattr(x, "dtype") or isinstance(x, (int, float)) else x

    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(x) for x in r) for r in df[cols].values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    cols, a = rows(got)
    want_cols, b = rows(con.execute(sql).df())
    assert cols == want_cols
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or p is not None and q is not None and p == pytest.approx(q, rel=1e-6, abs=1e-3)


def test_entry(spark):
    assert entry.entry(spark).count() == 162
