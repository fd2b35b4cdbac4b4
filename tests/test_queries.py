"""Every registered query of the core against its SQL, over the smallest tables."""

from __future__ import annotations

import math
from datetime import datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from colloquy.plans import all_plans

SF = Path("/root/testdata/sf0.001")
PLANS = all_plans()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return round(x, 5) + 0.0
    if isinstance(x, list):
        return tuple(map(plain, x))
    if isinstance(x, datetime):
        return x.replace(tzinfo=None)
    return x if isinstance(x, (str, int, bool, tuple)) else str(x)


@pytest.fixture(scope="module")
def tables():
    if not SF.exists():
        pytest.skip("no test tables here")
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for p in SF.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return connection


@pytest.mark.parametrize("name", sorted(PLANS.queries))
def test_query(spark, tables, name):
    df = PLANS.queries[name](spark, str(SF))
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in PLANS.sql:
        found = tables.sql(PLANS.sql[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    if SF.exists():
        assert contract.entry(spark).count() > 0
