import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corbel.functions import vectors as V
from corbel.operators import bm25, embedding, evaluate, fusion
from corbel.operators.grep import grep
from corbel.operators.vector import knn

CHUNKS = "id long, context_header string, text string"


def _search(spark, rows, text, k=10):
    return [(r.chunk_id, r.score) for r in bm25.search_chunks(spark.createDataFrame(rows, CHUNKS), spark.createDataFrame([("q", text)], "query_id string, query_text string"), k).orderBy("rank").collect()]


def test_bm25_by_hand(spark):
    assert _search(spark, [(1, "", "cat cat dog"), (2, "", "dog bird")], "cat") == [(1, pytest.approx(0.902321773509988, abs=1e-6))]


def test_bm25_unions_terms_breaks_ties_by_id_and_counts_blank_chunks(spark):
    rows = [(i, "", "shared token") for i in range(5, 0, -1)] + [(9, "alpha", "beta"), (10, None, None), (11, "", "the of")]
    assert [c for c, _ in _search(spark, rows, "shared shared", 3)] == [1, 2, 3]
    assert {c for c, _ in _search(spark, rows, "beta shared")} == {1, 2, 3, 4, 5, 9}
    n, df, avg = 8, 1, (5 * 2 + 2 + 0 + 0) / 8
    want = math.log(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / avg))
    assert _search(spark, rows, "beta") == [(9, pytest.approx(want, abs=1e-6))]
    assert _search(spark, rows, "the") == [] and _search(spark, rows[:0], "beta") == []


def test_index_forms_and_changes(spark):
    df = spark.createDataFrame([(1, "h", "aB aB"), (2, None, "x")], CHUNKS)
    post = bm25.inverted_index(df)
    assert {(r.chunk_id, r.term, r.freq) for r in post.collect()} == {(1, "h", 1), (1, "ab", 2), (1, "b", 2), (2, "x", 1)}
    maps = {r.chunk_id: (r.length, r.term_freq) for r in bm25.term_maps(df).collect()}
    assert maps == {1: (5, {"h": 1, "ab": 2, "b": 2}), 2: (1, {"x": 1})}
    later = bm25.inverted_index(spark.createDataFrame([(1, "", "new")], CHUNKS))
    assert {(r.chunk_id, r.term) for r in bm25.reindex(post, later).collect()} == {(1, "new"), (2, "x")}
    assert {r.chunk_id for r in bm25.remove(post, later).collect()} == {2}


LISTS = "query_id string, retriever string, weight double, rank int, chunk_id long, score double"


def _lists(*lists):
    return [("q", name, w, i + 1, c, s) for name, w, items in lists for i, (c, s) in enumerate(items)]


def test_fusion_by_hand(spark):
    df = spark.createDataFrame(_lists(("bm25", 1.0, [(1, 9.0), (2, 8.0), (3, 7.0)]), ("vector", None, [(1, 0.0), (3, 0.0), (4, 0.0)])), LISTS)
    hits = fusion.top_k(fusion.rrf(df), 10).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in hits] == [(1, round(2 / 61, 9)), (3, round(1 / 63 + 1 / 62, 9)), (2, round(1 / 62, 9)), (4, round(1 / 63, 9))]
    assert [(s.retriever, s["rank"], s.score) for s in hits[0].sources] == [("bm25", 1, 9.0), ("vector", 1, 0.0)]
    assert {r.score for r in fusion.rrf(df.where("retriever = 'bm25'"), 0).collect()} == {round(1 / (60 + i), 9) for i in (1, 2, 3)}
    heavy = spark.createDataFrame(_lists(("a", 0.0, [(1, 1.0)]), ("b", 3.0, [(2, 1.0)])), LISTS)
    assert {r.chunk_id: r.score for r in fusion.rrf(heavy).collect()} == {1: round(1 / 61, 9), 2: round(3 / 61, 9)}
    assert fusion.rrf(df.limit(0)).count() == 0


def test_lists_without_ranks(spark):
    rows = [("q", "bm25", 1.0, None, c, s) for c, s in [(1, 3.0), (2, 9.0), (3, 3.0), (4, 1.0)]] + [("q", "vector", 1.0, None, c, s) for c, s in [(7, 0.5), (8, 0.1)]]
    got = {(r.retriever, r.chunk_id): r["rank"] for r in fusion.assign_ranks(spark.createDataFrame(rows, LISTS)).collect()}
    assert got == {("bm25", 2): 1, ("bm25", 1): 2, ("bm25", 3): 2, ("bm25", 4): 4, ("vector", 8): 1, ("vector", 7): 2}


def test_graph_boost(spark):
    hits = spark.createDataFrame([("q", 1, 0.5), ("q", 2, 0.4), ("q", 3, 0.3), ("q", 4, 0.2), ("p", 1, 0.5)], "query_id string, chunk_id long, score double")
    chunks = spark.createDataFrame([(1, 10, 100), (2, 11, 200), (3, 12, 100), (4, None, 300)], "id long, symbol_id long, file_id long")
    edges = spark.createDataFrame([(11, 10), (10, 10)], "src long, dst long")
    got = {(r.query_id, r.chunk_id): r.score for r in fusion.graph_boost(hits, chunks, edges, 0.1).collect()}
    # The seed shares its own file and, by its self-loop, is its own neighbour.
    assert got == {("q", 1): 0.8, ("q", 2): 0.6, ("q", 3): 0.4, ("q", 4): 0.2, ("p", 1): 0.5}
    assert fusion.graph_boost(hits, chunks, edges, -1.0) is hits


def test_hybrid_degrades(spark):
    good = spark.createDataFrame([("q", 1, 7, 2.0)], "query_id string, rank int, chunk_id long, score double")

    def bad():
        raise RuntimeError("down")

    hits, failed = fusion.hybrid_search({"bm25": lambda: good, "vector": bad}, 5)
    assert failed == ["vector"] and [r.chunk_id for r in hits.collect()] == [7]
    with pytest.raises(RuntimeError, match="down"):
        fusion.hybrid_search({"vector": bad}, 5)


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner_product"])
def test_knn_is_exact(spark, metric):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    x[7] = 0
    x[11] = x[12]
    rows = [("a" if i < 150 else "b", i, x[i].tolist()) for i in range(200)] + [("a", 900, None), ("a", 901, [1.0]), ("a", 902, [float("nan")] * 8)]
    v = spark.createDataFrame(rows, "scope string, chunk_id long, embedding array<float>")
    q = v.where("chunk_id % 40 = 0 or chunk_id = 7").withColumnRenamed("chunk_id", "query_id")
    got = {}
    for r in knn(q, v, 5, metric, 8, query_block=3, base_block=60).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    x64 = x.astype(np.float64)
    for i in [0, 7, 40, 80, 120, 160]:
        own = range(150) if i < 150 else range(150, 200)
        dist = {}
        for j in own:
            dot, scale = x64[i] @ x64[j], np.linalg.norm(x64[i]) * np.linalg.norm(x64[j])
            dist[j] = round({"cosine": 1 - dot / scale if scale else 1.0, "l2": np.linalg.norm(x64[i] - x64[j]), "inner_product": -dot}[metric], 6)
        assert got[i] == sorted(own, key=lambda j: (dist[j], j))[:5]
    assert knn(q, v.limit(0), 5, metric, 8).count() == 0


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [6.0, 8.0])], "a array<float>, z array<float>, b array<float>")
    r = df.select(V.cosine_distance(F.col("a"), F.col("b")).alias("c"), V.cosine_distance(F.col("a"), F.col("z")).alias("cz"), V.l2_distance(F.col("a"), F.col("b")).alias("l"), V.negative_inner_product(F.col("a"), F.col("b")).alias("i"), V.normalize(F.col("a")).alias("n"), V.usable(F.col("z"), 2).alias("u")).first()
    assert (round(r.c, 12), r.cz, r.l, r.i, [round(x, 6) for x in r.n], r.u) == (0.0, 1.0, 5.0, -50.0, [0.6, 0.8], False)
    with pytest.raises(Exception, match="must have 3 dimensions"):
        df.select(V.checked(F.col("a"), 3)).collect()


def test_stand_in_embeddings(spark):
    a, b = embedding.stand_in(["x", "y"], 64), embedding.stand_in(["x"], 64)
    assert np.allclose(np.linalg.norm(a, axis=1), 1, atol=1e-6) and (a[0] == b[0]).all() and not (a[0] == a[1]).all()
    df = spark.createDataFrame([(1, "x", 0), (2, None, 0), (3, "x", 0)], "id long, t string, embedding int")
    got = {r.id: r.embedding for r in embedding.embed(df, "id", "t").collect()}
    assert np.allclose(got[1], a[0]) and got[2] is None and got[3] == got[1]
    with pytest.raises(Exception, match="embedder returned"):
        embedding.embed(df, "id", "t", lambda texts: [[1.0]] * len(texts)).collect()


def test_embedding_cache(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id long, t string")
    empty = spark.createDataFrame([], "key string, embedding array<float>")
    vectors, fresh = embedding.embed_cached(df, empty, "id", "t", "m")
    assert vectors.count() == 3 and fresh.count() == 2
    marked = fresh.withColumn("embedding", F.transform("embedding", lambda x: x * 0 + 7)).cache()
    again, more = embedding.embed_cached(df, marked, "id", "t", "m")
    assert more.count() == 0 and {r.embedding[0] for r in again.collect()} == {7.0}
    assert embedding.embed_cached(df, marked, "id", "t", "other")[1].count() == 2
    broken = marked.withColumn("embedding", F.slice("embedding", 1, 3))
    assert embedding.embed_cached(df, broken, "id", "t", "m")[1].count() == 2


def test_embedding_space(spark):
    repos = spark.createDataFrame([(1, "v", "m"), (2, None, "")], "id long, embedding_provider string, embedding_model string")
    embedding.check_space(repos, 1, "v", "m")
    embedding.check_space(repos, 2, "unknown", "unknown")
    with pytest.raises(ValueError, match="embedded by"):
        embedding.check_space(repos, 1, "v", "n")


def test_grep(spark):
    files = spark.createDataFrame([(1, "b.py", "def foo_bar():\n  foo bar\nBAR foo"), (1, "a.py", "bar\nfoobar"), (2, "c.py", "foo bar"), (1, "n", None)], "scope long, path string, text string")
    q = spark.createDataFrame([("q", 1, "foo bar of"), ("e", 1, ""), ("n", None, "foo")], "query_id string, scope long, query_text string")
    assert [(r.query_id, r["rank"], r.path, r.line, r.score) for r in grep(files, q).orderBy("rank").collect()] == [("q", 1, "b.py", 2, 2), ("q", 2, "b.py", 3, 2), ("q", 3, "a.py", 1, 1)]


def test_metrics(spark):
    items = spark.createDataFrame([("s", "q", 1, "x", 50, 60), ("s", "q", 2, "a", 1, 5), ("s", "q", 3, "a", 4, 9), ("s", "q", 6, "b", 1, 1), ("s", "late", 6, "a", 1, 9), ("s", "none", 1, "a", 1, 1)], "system string, query_id string, rank int, path string, start_line int, end_line int")
    labels = spark.createDataFrame([("q", 1, "a", 5, 6), ("q", 2, "b", 1, 1), ("late", 1, "a", 1, 2)], "query_id string, label int, path string, start_line int, end_line int")
    queries = spark.createDataFrame([("q", "semantic"), ("late", None), ("none", "semantic")], "query_id string, query_type string")
    m = evaluate.query_metrics(items, labels, queries)
    got = {r.query_id: (r.precision, r.recall, r.reciprocal_rank) for r in m.collect()}
    assert got == {"q": (0.4, 0.5, 0.5), "late": (0.0, 0.0, 0.0), "none": (0.0, 0.0, 0.0)}
    avg = {r.query_type: (r.queries, r.precision, r.recall, r.mrr) for r in evaluate.averages(m, queries).collect()}
    assert avg == {None: (3, 0.133333, 0.166667, 0.166667), "semantic": (2, 0.2, 0.25, 0.25), "": (1, 0.0, 0.0, 0.0)}


def test_label_spans(spark):
    labels = spark.createDataFrame([(1, "a", 1, 2), (2, "a", 3, 3), (3, "a", 2, 9), (4, "zz", 1, 1)], "label int, path string, start_line int, end_line int")
    src = spark.createDataFrame([("a", "x\n\n  \ny")], "path string, text string")
    assert {r.label: r.ok for r in evaluate.verify_spans(labels, src).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_retrying_waits_longer_each_time_and_gives_up():
    waits, calls = [], []

    def flaky(texts):
        calls.append(texts)
        if len(calls) < 4:
            raise ConnectionError("busy")
        return [[1.0]] * len(texts)

    assert embedding.Retrying(flaky, sleep=waits.append)(["a"]) == [[1.0]]
    assert len(waits) == 3 and all(0.8 * w <= got <= 1.2 * w for got, w in zip(waits, [0.5, 1, 2], strict=True))

    def dead(texts):
        raise TimeoutError

    with pytest.raises(TimeoutError):
        embedding.Retrying(dead, retries=2, sleep=waits.append)(["a"])

    def wrong(texts):
        raise ValueError("bad key")

    with pytest.raises(ValueError, match="bad key"):
        embedding.Retrying(wrong, sleep=lambda s: pytest.fail("must not wait"))(["a"])


def test_unit_vectors_of_an_embedder(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, t string")
    got = embedding.embed(df, "id", "t", lambda texts: [[3.0, 4.0]] * len(texts), dim=2, unit=True).collect()
    assert all([round(x, 6) for x in r.embedding] == [0.6, 0.8] for r in got)
    with pytest.raises(Exception, match="zero vector"):
        embedding.embed(df, "id", "t", lambda texts: [[0.0, 0.0]] * len(texts), dim=2, unit=True).collect()


def test_a_retriever_that_fails_as_it_runs_is_left_out(spark):
    good = spark.createDataFrame([("q", 1, 7, 2.0), ("q", 2, 8, 1.0)], "query_id string, rank int, chunk_id long, score double")
    broken = good.withColumn("score", F.raise_error(F.lit("no answer")).cast("double"))
    hits, failed = fusion.hybrid_search({"bm25": lambda: good, "vector": lambda: broken}, 5)
    assert failed == ["vector"] and [r.chunk_id for r in hits.orderBy("rank").collect()] == [7, 8]
    with pytest.raises(Exception, match="no answer"):
        fusion.hybrid_search({"vector": lambda: broken}, 5)


def test_cache_misses_are_embedded_once(spark, tmp_path):
    log = str(tmp_path / "asked")

    def embedder(texts):
        with open(log, "a") as f:
            f.write("x" * len(texts))
        return [[1.0] * 64 for _ in texts]

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, t string")
    vectors, fresh = embedding.embed_cached(df, spark.createDataFrame([], "key string, embedding array<float>"), "id", "t", "m", embedder)
    assert vectors.count() == 3 and fresh.count() == 2
    with open(log) as f:
        assert len(f.read()) == 2
