"""Every registered query with a SQL twin must agree with DuckDB (rows, column
names, order-insensitive rounded values) on the smallest table set."""

import duckdb
import pytest

import __spark_entry__ as E
from check_oracle import TABLES, digest

SLOW = {"tournament_classification_doc_quality", "tournament_regression_doc_quality"}
SQL = E.oracle_sql()
NAMES = sorted(n for n in E.queries() if n in SQL)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, sf, con, name):
    df = E.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(SQL[name])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(orows)
    assert digest(rows, df.columns)[0] == digest(orows, rel.columns)[0]


@pytest.mark.parametrize("name", sorted(n for n in E.queries() if n not in SQL and n not in SLOW))
def test_rows_only_queries_run(spark, sf, name):
    assert E.queries()[name](spark, sf).count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 2
    assert set(df.columns) >= {"column", "mean", "median", "std"}
