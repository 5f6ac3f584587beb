"""Queries of the training-data operators against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from lexloom.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    if not os.path.isdir(DIR):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = con.execute(queries.SQL[name])
    names = [c[0] for c in got.description]
    want = sorted(repr(sorted(zip(names, r))) for r in got.fetchall())
    assert sorted(repr(sorted(r.asDict().items())) for r in queries.QUERIES[name](spark, DIR).collect()) == want
