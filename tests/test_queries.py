"""Registered queries against their SQL on the smallest tables."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

from codequarry.plans import catalogue

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{TINY}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(d):
    def f(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        return repr(round(float(v), 6)) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    out = pd.DataFrame({c: [f(v) for v in d[c]] for c in sorted(d.columns)})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, con, name):
    a = norm(catalogue.QUERIES[name](spark, TINY).toPandas())
    b = norm(con.execute(catalogue.SQL[name]).df())
    assert list(a.columns) == list(b.columns)
    assert a.equals(b), pd.concat([a.assign(w="spark"), b.assign(w="sql")]).drop_duplicates(list(a.columns), keep=False).head(6).to_string()
