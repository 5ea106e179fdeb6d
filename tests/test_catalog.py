"""Every query of the engine against its SQL in DuckDB."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from tabloom import catalog
from tabloom.registry import CHECKS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (float, Decimal)) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str) and got


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_helpers_that_read_no_table(spark, sf_dir, name):
    expected, find = CHECKS[name]
    assert {k: str(v) for k, v in find(spark, sf_dir).items()} == expected and name not in catalog.QUERIES


def test_entry_module(spark):
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).count() > 0
