"""Each query that has a SQL twin gives what DuckDB gives."""

import duckdb
import pytest

from tarn import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n in SQL])
def test_as_sql(spark, sf, oracle, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = oracle.sql(SQL[name])
    assert columns == sorted(want.columns)
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in SQL])
def test_runs(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name,want", [("q4", "LeftSemi"), ("q16", "LeftAnti"), ("q3", "TakeOrderedAndProject"), ("q6", "PushedFilters: [IsNotNull"), ("q5", "BroadcastHashJoin")])
def test_plans(spark, sf, name, want):
    assert want in catalog.queries()[name](spark, sf)._jdf.queryExecution().toString()


def test_scan_reads_only_what_it_needs(spark, sf):
    plan = catalog.queries()["q6"](spark, sf)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in plan
