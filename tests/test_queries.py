"""Every reference query on the smallest tables, against its oracle where it has one."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, rows_of
from stratalith.plans import catalog


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(df.columns) == len(set(df.columns))
    if name in catalog.ORACLE_SQL:
        rel = duck.sql(catalog.ORACLE_SQL[name])
        assert got == rows_of(rel.columns, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
