"""Every query with SQL against DuckDB on the small tables; the others for schema and rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from netscale.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got, names = df.collect(), sorted(df.columns)
    if name not in catalogue.SQL:
        # no SQL: rows, none of their columns all null, no NaN
        assert got and all(any(row[n] is not None for row in got) for n in names)
        assert not any(isinstance(v, float) and v != v for row in got for v in row)
        return
    want = duck.sql(catalogue.SQL[name])
    assert sorted(want.columns) == names
    place = [want.columns.index(n) for n in names]
    assert sorted([plain(r[n]) for n in names] for r in got) == sorted([plain(r[i]) for i in place] for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["src", "dst", "weight"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
