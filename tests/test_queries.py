"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lexloom import lexicon_queries, queries  # noqa: F401 (registers its queries)

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DIR):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    rows = [r.asDict() for r in queries.QUERIES[name](spark, DIR).collect()]
    if name not in queries.SQL:
        assert rows
        return
    got = db.execute(queries.SQL[name])
    names = [c[0] for c in got.description]
    want = [dict(zip(names, r)) for r in got.fetchall()]
    line = lambda r: repr(sorted(r.items()))
    assert sorted(map(line, rows)) == sorted(map(line, want))


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["key", "df", "idf4"]


def test_near_relation_takes_every_supplier(spark, tmp_path):
    spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    home = {s: s % 2 for s in range(95, 111)}
    spark.createDataFrame(list(home.items()), "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r.src, r.dst): r.label for r in queries.near_relation(spark, str(tmp_path)).collect()}
    want = {(f"S{a}", f"S{b}"): "similar" for a in home for b in home if a != b and home[a] == home[b]}
    want |= {pair: "similar" for s, n in home.items() for pair in ((f"S{s}", f"N{n}"), (f"N{n}", f"S{s}"))}
    want |= {("N0", "R0"): "hypernym", ("N1", "R0"): "hypernym", ("N2", "R1"): "hypernym", ("R0", "N0"): "hyponym", ("R0", "N1"): "hyponym", ("R1", "N2"): "hyponym", ("N0", "N1"): "sibling", ("N1", "N0"): "sibling"}
    assert got == want
