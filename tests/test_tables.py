import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corbel.operators import context, ingest, spans, state

S = "id long, file_id long, start_line int, end_line int"


def _spans(rnd, n, files, width):
    out = []
    for i in range(n):
        a = rnd.randint(1, 3000)
        out.append((i, rnd.randrange(files), a, a + int(rnd.expovariate(1 / width))))
    return out


def test_span_joins_equal_brute_force(spark):
    rnd = random.Random(1)
    a = [*_spans(rnd, 120, 3, 40), (900, 0, 1, 100_000), (901, None, 1, 5), (902, 1, 9, 3), (903, 1, None, 4)]
    b = [*_spans(rnd, 120, 3, 200), (900, 0, 1, 70_000), (901, None, 1, 5)]
    left, right = spark.createDataFrame(a, S), spark.createDataFrame(b, S)
    fine = lambda rows: [r for r in rows if r[1] is not None and r[2] is not None and r[2] <= r[3]]
    pairs = [(x, y) for x in fine(a) for y in fine(b) if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]]
    got = [(r.l_id, r.r_id) for r in spans.overlap_join(left, right, "file_id").collect()]
    assert len(got) == len(set(got)) and set(got) == {(x[0], y[0]) for x, y in pairs}
    inside = {(x[0], y[0]) for x, y in pairs if x[2] <= y[2] and y[3] <= x[3]}
    assert {(r.l_id, r.r_id) for r in spans.containment_join(left, right, "file_id").collect()} == inside
    around = {(x[0], y[0]) for x, y in pairs if y[2] <= x[2] and x[3] <= y[3]}
    assert {(r.l_id, r.r_id) for r in spans.partial_overlaps(left, right, "file_id").collect()} == {(x[0], y[0]) for x, y in pairs} - inside - around
    first = {}
    for x, y in sorted(inside):
        first.setdefault(y, x)
    assert {r.r_id: r.l_id for r in spans.first_container(left, right, "file_id", "id").collect()} == first
    best = {}
    for x, y in pairs:
        if y[2] <= x[2] and x[3] <= y[3]:
            best[x[0]] = min(best.get(x[0], (9e9,)), (y[3] - y[2], -y[2], y[0]))
    assert {r.r_id: r.l_id for r in spans.tightest_cover(left, right, "file_id").collect()} == {k: v[2] for k, v in best.items()}


def test_diff_and_upsert(spark):
    f = "id long, path string, content_hash string, note string"
    old = spark.createDataFrame([(1, "a", "x", "o"), (2, "b", "x", "o"), (3, "c", None, "o"), (4, "d", "x", "o")], f)
    new = spark.createDataFrame([(11, "a", "x", "n"), (12, "b", "y", "n"), (13, "c", None, "n"), (15, "e", "z", "n")], f)
    assert {r.path: (r.status, r.old_id, r.new_id) for r in ingest.file_diff(old, new).collect()} == {"a": ("unchanged", 1, 11), "b": ("changed", 2, 12), "c": ("unchanged", 3, 13), "d": ("deleted", 4, None), "e": ("added", None, 15)}
    assert {tuple(r) for r in ingest.upsert(old, new, ["path"]).collect()} == {(1, "a", "x", "n"), (2, "b", "y", "n"), (3, "c", None, "n"), (4, "d", "x", "o"), (15, "e", "z", "n")}
    assert ingest.file_diff(old.limit(0), new.limit(0)).count() == 0
    assert {r.path for r in ingest.duplicates(old.union(old.limit(1)), ["path"]).collect()} == {"a"}


def test_cascade(spark):
    t = {
        "files": spark.createDataFrame([(1,), (2,)], "id long"),
        "symbols": spark.createDataFrame([(10, 1), (20, 2)], "id long, file_id long"),
        "chunks": spark.createDataFrame([(100, 1), (200, 2)], "id long, file_id long"),
        "edges": spark.createDataFrame([(10, 20), (20, 20), (20, 10)], "src long, dst long"),
        "unresolved_refs": spark.createDataFrame([(10, "x"), (20, "y")], "src long, name string"),
        "postings": spark.createDataFrame([(100, "t"), (200, "t")], "chunk_id long, term string"),
        "vectors": spark.createDataFrame([(100,), (200,)], "chunk_id long"),
    }
    gone = spark.createDataFrame([(1,), (77,)], "id long")
    left = {k: [tuple(r) for r in v.collect()] for k, v in ingest.cascade_delete(t, gone).items()}
    assert left == {"files": [(2,)], "symbols": [(20, 2)], "chunks": [(200, 2)], "edges": [(20, 20)], "unresolved_refs": [(20, "y")], "postings": [(200, "t")], "vectors": [(200,)]}
    assert ingest.cascade_delete(t, gone, keep_file=True)["files"].count() == 2


def test_ids_and_parents(spark):
    rows = [(i % 7, i, None if i < 7 else i - 7) for i in range(300)]
    df = spark.createDataFrame(rows, "file_id long, temp_id long, temp_parent long")
    ids = ingest.global_ids(df, ["file_id", "temp_id"], 5, first=101)
    got = sorted((r.id, r.file_id, r.temp_id) for r in ids.collect())
    assert [g[0] for g in got] == list(range(101, 401)) and [g[1:] for g in got] == sorted((a, b) for a, b, _ in rows)
    by = {(r.file_id, r.temp_id): r for r in ingest.remap_parents(ids).collect()}
    assert all(r.parent_id == (by[r.file_id, r.temp_parent].id if r.temp_parent is not None else None) for r in by.values())
    with pytest.raises(Exception, match="without parent"):
        ingest.remap_parents(ids.where("temp_id <> 0")).collect()


def test_state(spark):
    t0 = datetime(2026, 1, 1)
    rows = [("k" if i % 3 else "m", i, t0 + timedelta(minutes=i)) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, id long, at timestamp")
    assert sorted(r.id for r in state.keep_latest_per_key(df, ["k"], [F.col("id").desc()], 2).collect()) == [24, 27, 28, 29]
    assert {(r.k, r.id) for r in state.latest_per_key(df, ["k"], [F.col("at")]).collect()} == {("k", 29), ("m", 27)}
    now = F.lit(t0 + timedelta(hours=1))
    cache = spark.createDataFrame([(str(i), t0 + timedelta(hours=i), t0 + timedelta(minutes=i)) for i in range(5)], "cache_key string, expires_at timestamp, last_accessed_at timestamp")
    hits, after = state.cache_get(cache, spark.createDataFrame([("0",), ("3",), ("9",)], "cache_key string"), now)
    assert [r.cache_key for r in hits.collect()] == ["3"]
    assert {r.cache_key for r in state.keep_latest(after, [F.col("last_accessed_at").desc(), F.col("cache_key")], 2).collect()} == {"3", "4"}
    put = state.cache_put(cache, cache.where("cache_key = '0'").withColumn("last_accessed_at", now), 3)
    assert {r.cache_key for r in put.collect()} == {"0", "3", "4"}
    sessions = spark.createDataFrame([(i, t0 + timedelta(hours=i), t0 + timedelta(hours=i)) for i in range(5)], "id long, expires_at timestamp, updated_at timestamp")
    events = spark.createDataFrame([(i % 5, i) for i in range(10)], "session_id long, id long")
    s, e, c = state.cleanup(sessions, events, cache, now, 2)
    assert {r.id for r in s.collect()} == {3, 4} and {r.session_id for r in e.collect()} == {3, 4} and c.count() == 3
    with pytest.raises(Exception, match="larger than"):
        spark.range(1).select(state.note(F.lit("é" * 1001))).collect()


def test_budget(spark):
    h = "query_id string, rank int, chunk_id long, path string, symbol string, start_line int, end_line int, text string, sources array<string>"
    rows = [("q", 1, 1, "a", "s", 1, 2, "x" * 50, ["bm25#1"]), ("q", 2, 2, "a", None, 3, 4, "é" * 40, []), ("q", 3, 3, "a", None, 3, 4, "z", []), ("q", 4, 4, "a", None, 5, 6, None, []), ("q", 1, 1, "a", "s", 1, 2, "x" * 50, ["bm25#1"])]
    df = spark.createDataFrame(rows, h)
    at = lambda budget: context.fill_budget(df, budget).first()
    r = at(100)
    assert [(e.id, e.snippet, e.truncated) for e in r.evidence] == [("e1", "x" * 50, False), ("e2", "é" * 23 + "…", True), ("e3", "z", False)] and r.omitted == 0
    assert [(e.id, len(e.snippet)) for e in at(70).evidence] == [("e1", 50), ("e2", 1)] and at(70).omitted == 1
    assert at(20).evidence == [] or [e.snippet for e in at(20).evidence] == ["z"]
    assert [e.truncated for e in at(40).evidence] == [True]
    assert context.fill_budget(df.limit(0)).count() == 0
