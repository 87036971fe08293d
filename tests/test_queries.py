"""Every core query against its SQL on the smallest data folder, where there is one."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corbel.plans.queries import ORACLES, QUERIES

DATA = os.environ.get("CORBEL_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data folder")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def check(spark, db, make, sql):
    df = make(spark, DATA)
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    if sql is None:
        return
    r = db.execute(sql)
    cols = [x[0] for x in r.description]
    assert sorted(cols) == names
    at = [cols.index(c) for c in names]
    assert got == sorted(repr(tuple(plain(row[i]) for i in at)) for row in r.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    check(spark, db, QUERIES[name], ORACLES.get(name))


@needs_data
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "chunk_id", "score"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
