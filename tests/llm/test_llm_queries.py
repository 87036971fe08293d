"""The training-data queries against their SQL, and the shapes of those that have none."""

import os

import duckdb
import pytest

from corbel.llm.queries import oracle_sql, queries

DATA = os.environ.get("CORBEL_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data folder")

SHAPES = {
    "p1_found": ["chunk_id", "term"],
    "p2_found": ["chunk_id_a", "chunk_id_b"],
    "p3_found": ["file_id"],
    "p4_found": ["chunk_id"],
    "p5_found": ["symbol_id"],
    "p6_found": ["query_id", "chunk_id"],
    "p7_ids": ["doc_id", "ids"],
    "p9_found": ["doc_id_a", "doc_id_b"],
}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    df = queries()[name](spark, DATA)
    assert df.columns == SHAPES.get(name, df.columns)
    rows = [tuple(r) for r in df.collect()]
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name in oracle_sql():
        r = db.execute(oracle_sql()[name])
        assert [x[0] for x in r.description] == df.columns
        assert sorted(rows) == sorted(tuple(x) for x in r.fetchall())


def test_every_document_is_encoded_and_packed(spark, db):
    n = db.execute("select count(*) from documents").fetchone()[0]
    assert queries()["p7_ids"](spark, DATA).count() == n
    packed = queries()["p8_containers"](spark, DATA)
    assert packed.select("doc_id").distinct().count() == n
    sizes = {r.doc_id: len(r.ids) for r in queries()["p7_ids"](spark, DATA).collect()}
    got = {r.doc_id: r[1] for r in packed.groupBy("doc_id").agg({"n_tokens": "sum"}).collect()}
    assert got == sizes
