"""Every registered query with SQL gives DuckDB's rows; the others give some."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def tidy(row):
    return repr(tuple(round(x, 6) if isinstance(x, float) else x for x in row))


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0
        return
    want = duck.sql(sql)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(tidy(r) for r in got.select(*columns).collect()) == sorted(tidy(r) for r in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
