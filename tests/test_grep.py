"""Line search in blocks under bounds: the same lines as counting them all, without the rows of a join on words."""

import random

import pytest

from corbel.operators import grep as G
from corbel.plans.queries import QUERIES


def counted(files, queries, k=5):
    """By definition."""
    lines = {}
    for scope, path, text in files:
        for i, t in enumerate(text.split("\n") if text is not None else []):
            lines.setdefault((scope, path, i + 1), set()).update(t.lower().replace("-", " ").split())
    out = []
    for q, scope, text in queries:
        terms = {t for t in text.lower().split() if len(t) >= 3}
        hits = sorted((-len(terms & w), path is not None, path or "", line) for (s, path, line), w in lines.items() if s == scope and terms & w)
        out += [(q, i + 1, path if there else None, line, -score) for i, (score, there, path, line) in enumerate(hits[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "sets", "share"), [(1 << 26, 200_000, 16), (500, 7, 3), (200, 200_000, 2)])
def test_grep_is_whole_whatever_the_blocks(spark, monkeypatch, block, sets, share):
    monkeypatch.setattr(G, "BLOCK_BYTES", block)
    monkeypatch.setattr(G, "BLOCK_SETS", sets)
    monkeypatch.setattr(G, "SHARE", share)
    rng = random.Random(block)
    vocabulary = [f"{a}{b}" for a in ("alpha", "beta", "größe", "of") for b in ("", "x", "yy", "z_z", "7")]
    some = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    files = [(rng.choice([None, 1, 1, 2]), f"p{rng.randrange(60)}", "\n".join(rng.choice([" ", "-"]).join(some(rng.randrange(9)).split()).upper() for _ in range(rng.randrange(6)))) for _ in range(150)]
    files += [(1, None, "alpha beta"), (1, "", "alpha beta"), (None, "none", None), (3, "unasked", "alpha"), (2, "twice", "alphax\nbeta"), (2, "twice", "betax\nalpha alphax")]
    queries = [(f"q{i:02}", rng.choice([None, 1, 2, 4]), some(rng.randrange(8))) for i in range(60)] + [("same1", 1, "alpha beta"), ("same2", 1, "beta alpha alpha"), ("", 2, "alpha alphax beta betax"), (None, 1, "beta")]
    got = G.grep(spark.createDataFrame(files, "scope long, path string, text string"), spark.createDataFrame(queries, "query_id string, scope long, query_text string").where("true"))
    plain = [(q, s, t.replace("_", " ") + " " + t) for q, s, t in queries]  # z_z gives itself and parts that are too short
    key = lambda r: tuple((x is not None, x if x is not None else "") for x in r)
    want = sorted((r for q in plain for r in counted(files, [q])), key=key)
    assert sorted(map(tuple, got.collect()), key=key) == want


def most_rows(plan):
    """The most rows that a node of an executed plan put out."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return most_rows(plan.executedPlan())
    inner = [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    rows = plan.metrics().get("numOutputRows")
    return max([rows.get().value() if rows.isDefined() else 0, *map(most_rows, inner)])


def test_grep_documents_does_not_pair_all_lines_with_all_queries(spark, tmp_path):
    d, rng = str(tmp_path), random.Random(0)
    common = ["window", "writer", "wrapper", "weight", "worker", "vector", "vertex", "before"]
    docs = [(i, "\n".join(" ".join(rng.sample(common, 5)) for _ in range(10))) for i in range(300)]
    queries = [(f"q{i}", f"{' '.join(rng.sample(common, 4))} word{i}") for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(queries, "query_id string, query_text string").write.parquet(f"{d}/eval_queries.parquet")
    found = QUERIES["grep_documents"](spark, d)
    assert found.count() == 1000
    found.collect()
    assert most_rows(found._jdf.queryExecution().executedPlan()) <= 20_000  # 3,000 lines; 1.5 million pairs of a line's and a query's word
