"""Every query of the engine that has SQL gives the SQL's rows on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from loomspan.plans import registry

DATA = "/root/testdata/sf0.001"


def cell(v):
    if hasattr(v, "tolist") and not isinstance(v, (str, int, float)):
        v = v.tolist()
    if v is None or v is pd.NA or v != v:
        return ""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{round(float(v), 5) + 0.0:.5f}"
    return str(v)


def rows(frame):
    return sorted(tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.SQL:
        want = con.execute(registry.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
