"""Every core query with SQL gives the rows that DuckDB gives for it."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from inkloom.plans import queries as core

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(DATA + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(row):
    return tuple(round(v, 6) if isinstance(v, float) else None if v is None else str(v) for v in row)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(core.SQL))
def test_against_sql(spark, con, name):
    df = core.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = [norm([r[c] for c in cols]) for r in df.collect()]
    cur = con.execute(core.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = [norm([dict(zip(names, r, strict=True))[c] for c in cols]) for r in cur.fetchall()]
    key = lambda r: tuple((v is None, v or "") for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
