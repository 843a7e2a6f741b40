"""Every query with SQL against DuckDB on the smallest tables; every other one must run."""

import glob
import math
import os

import pytest

from voxtile.plans import catalogue, problems

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
QUERIES, ORACLES = {**problems.QUERIES, **catalogue.QUERIES}, {**problems.ORACLES, **catalogue.ORACLES}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(DATA + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in ORACLES:
        return
    r = duck.execute(ORACLES[name])
    have = [c[0] for c in r.description]
    cols = sorted(df.columns)
    assert sorted(have) == cols
    exp = sorted((tuple(plain(x[have.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert sorted((tuple(plain(x[c]) for c in cols) for x in rows), key=repr) == exp
