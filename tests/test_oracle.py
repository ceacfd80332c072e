"""Every registered query with SQL gives what DuckDB gives, over the smallest tables."""

import math

import duckdb
import pytest

import tesela.queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_same_rows(spark, duck, name):
    df = own.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [[cell(r[c]) for c in columns] for r in df.collect()]
    sql = own.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    out = duck.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = [[cell(r[names.index(c)]) for c in columns] for r in out.fetchall()]
    assert sorted(got) == sorted(want)
