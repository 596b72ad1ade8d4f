"""Every core query with SQL against DuckDB on the smallest tables, where these are present."""

import glob
import math
import os

import pytest

from sievework.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    files = glob.glob(f"{DATA}/*.parquet")
    if not files:
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for f in files:
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(catalog.SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert len(rel.columns) == len(cols)
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want
