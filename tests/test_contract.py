"""The registered queries against their SQL on the smallest tables, where those are at hand."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from panelwright.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def test_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["industry", "fiscal_year", "term", "estimate", "n"] and got.count() >= 20


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == cols
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    at = [want.columns.index(c) for c in cols]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)
    assert a == b
