"""Every ledger query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from coffer import registry

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    return round(value, 5) + 0.0 if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", [n for n in registry.ORACLE_SQL if n.split("_")[0] in ("prd", "scr", "cls", "jn", "occ", "sch", "qry", "rec", "rul", "src", "snk", "inf")])
def test_query_agrees_with_sql(spark, db, name):
    frame = registry.QUERIES[name](spark, str(TABLES))
    columns = sorted(frame.columns)
    relation = db.sql(registry.ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert got == sorted((tuple(_plain(r[i]) for i in places) for r in relation.fetchall()), key=repr)
