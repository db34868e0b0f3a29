"""All queries of the core against their SQL, on the smallest tables."""

import glob
import math
import os
import datetime

import duckdb
import pytest

from recordloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    rows, columns = df.collect(), sorted(df.columns)
    sql = registry.oracles().get(name)
    if sql is None:
        return
    told = duck.execute(sql)
    names = [x[0] for x in told.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in told.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str) == want
