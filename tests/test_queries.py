"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from lintlake import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, sf, name):
    frame = queries.queries()[name](spark, sf)
    columns = sorted(frame.columns)
    mine = sorted(repr(tuple(r)) for r in frame.select(*columns).collect())
    other = sorted(map(repr, duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()))
    assert mine == other


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.oracle_sql()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
