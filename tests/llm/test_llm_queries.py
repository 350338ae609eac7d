"""The pN_ queries on the smallest tables; those with SQL against it."""

import glob
import os

import duckdb
import pytest

from codequarry.llm import queries

TINY = "/root/testdata/sf0.001"
FOUND = {
    "p1_found": ["repo", "path_a", "path_b"], "p3_found": ["chunk_id"], "p4_found": ["chunk_id_a", "chunk_id_b"], "p5_found": ["identity_id_a", "identity_id_b"],
    "p6_found": ["file_id"], "p7_found": ["file_id"], "p10_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, TINY)
    got = [tuple(r) for r in df.collect()]
    if name in FOUND:
        assert df.columns == FOUND[name] and len(set(got)) == len(got)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{TINY}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.QUERIES[name](spark, TINY)
    want = con.execute(f"select {', '.join(df.columns)} from ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
