"""Every core query with SQL agrees with DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from coursefold.plans import queries as core
from coursefold.plans import stream_queries  # noqa: F401  it registers its own

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_agrees(spark, con, name):
    rows = core.QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=str)
    if name not in core.ORACLE_SQL:
        assert got
        return
    found = con.execute(core.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert got == want
