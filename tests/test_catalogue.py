"""Every registered query of the package itself against its SQL, value by value; entry() has rows."""

import datetime
import decimal
from collections import Counter

import pytest

import __spark_entry__
from corpuscle.plans import registry

SF = "/root/testdata/sf0.001"


def plain(x):
    """A value as both engines have it: decimals and long fractions as rounded numbers, rows and lists as tuples."""
    if isinstance(x, float | decimal.Decimal):
        return None if x != x else round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_is_the_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = Counter(repr([plain(r[c]) for c in names]) for r in df.collect())
    assert rows
    if name in registry.ORACLES:
        found = con.execute(registry.ORACLES[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == names
        expected = Counter(repr([plain(dict(zip(columns, r, strict=True))[c]) for c in names]) for r in found.fetchall())
        assert rows == expected


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_queries_and_sql_agree_on_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
