"""Every registered query with SQL, side by side on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from genolake.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalogue.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return f"{float(x):.6g}" if x else "0"
    return str(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    rows = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    other = con.sql(sql)
    assert sorted(df.columns) == sorted(other.columns)
    columns = sorted(df.columns)
    theirs = [[cell(v) for v in r] for r in other.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()]
    ours = [[cell(r[c]) for c in columns] for r in rows]
    assert sorted(ours) == sorted(theirs)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["gene", "sample", "rpkm"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
