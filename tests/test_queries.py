"""Every registered query with SQL gives the rows DuckDB gives."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from tools.check_queries import TABLES, rows_of

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    return c


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, sf_small, name):
    df = entry.queries()[name](spark, sf_small)
    cur = con.execute(entry.oracle_sql()[name])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert rows_of(df.columns, df.collect()) == want


def test_fuzzy_counts(spark, sf_small):
    """Kept rows as a sequential pass over the same tables gives them."""
    assert entry.queries()["d_fuzzy"](spark, sf_small).count() == 27
