"""Registered queries against their SQL on the smallest test tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from lakeglean import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    want = duck.sql(plans.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    rows = [[norm(r[c]) for c in cols] for r in df.collect()]
    at = [want.columns.index(c) for c in cols]
    assert sorted(rows, key=str) == sorted([[norm(r[i]) for i in at] for r in want.fetchall()], key=str)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
