"""Every registered query runs, and agrees with its SQL where it has one."""

import datetime as dt
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tablelens.plans import core_queries, reference_queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = core_queries.QUERIES | reference_queries.QUERIES
SQL = core_queries.SQL | reference_queries.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, dict):
        return sorted((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in SQL:
        assert rows or name == "validate_metadata"
        return
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert rows == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())


def test_empty_tables(spark, tmp_path):
    """Every query runs over empty tables, and only counts of checks have rows."""
    for p in Path(DATA).glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).coalesce(1).write.parquet(str(tmp_path / p.name))
    found = {name: query(spark, str(tmp_path)).count() for name, query in QUERIES.items()}
    assert {name for name, n in found.items() if n} == {"required_nulls", "required_nested"}


def test_contract(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
