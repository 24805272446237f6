"""Every query that has SQL gives the SQL's rows, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from twinlens.plans import catalog

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(d: pd.DataFrame) -> list:
    norm = lambda v: "null" if pd.isna(v) else f"{float(v):.7g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(norm(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, con, name):
    assert rows(catalog.QUERIES[name](spark, D).toPandas()) == rows(con.sql(catalog.SQL[name]).df())
