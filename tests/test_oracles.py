"""Every query with SQL gives the same rows as DuckDB."""

import decimal

import duckdb
import pytest

from inkglass.plans import property_files, relations
from inkglass.plans import queries as core

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = core.QUERIES | property_files.QUERIES | relations.QUERIES, core.ORACLES | property_files.ORACLES | relations.ORACLES


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, (float, decimal.Decimal)) and x == int(x):
        return int(x)
    return x.item() if hasattr(x, "item") else x


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "conversations", "events", "orders", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, db, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expect = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert sorted(str([plain(r[c]) for c in columns]) for r in found.collect()) == expect and expect
