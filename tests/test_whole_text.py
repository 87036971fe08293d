"""Queries on rows that their SQL leaves out, on small fixtures."""

from corbel.plans.queries import QUERIES


def test_grep_reads_sources_that_are_not_utf8(spark, tmp_path):
    d = str(tmp_path)
    sources = [
        b"retry = 1\n",
        "# coding: latin-1\nwei\xdf = retry\n".encode("latin-1"),
        b"x = 1\nretry = '\xff\xfe'\n",  # no coding comment, wrong bytes
        b"# coding: nonsense\n\nretry = '\xe9'\n",
        "\n\n\nretry\n".encode("utf-16"),
    ]
    rows = [(i, 1, f"p{i}.py", c) for i, c in enumerate(sources)] + [(8, 1, "none.py", None), (9, 2, "other.py", sources[1])]
    spark.createDataFrame(rows, "id long, repo_id long, path string, content binary").write.parquet(f"{d}/files.parquet")
    spark.createDataFrame([(5, 1, "retry"), (6, 1, "wei\xdf")], "query_id long, repo_id long, query_text string").write.parquet(f"{d}/eval_queries.parquet")
    got = sorted((r.query_id, r.path, r.line) for r in QUERIES["grep_baseline"](spark, d).collect())
    assert got == [(5, "p0.py", 1), (5, "p1.py", 2), (5, "p2.py", 2), (5, "p3.py", 3), (5, "p4.py", 4), (6, "p1.py", 2)]


def test_truncation_takes_every_chunk(spark, tmp_path):
    d = str(tmp_path)
    texts = ["", "short", "a" * 50, "é" * 30, "a" * 39 + "é", "a" * 38 + "€uro", "a" * 37 + "😀😀", "€" * 20, "é" * 20, None]
    spark.createDataFrame(list(enumerate(texts)), "id long, text string").write.parquet(f"{d}/chunks.parquet")
    want = {i: None if t is None else t.encode()[:40].decode("utf-8", "ignore") for i, t in enumerate(texts)}
    got = {r.id: (r.head, r.bytes) for r in QUERIES["truncate_bytes"](spark, d).collect()}
    assert got == {i: (t, None if t is None else len(t.encode())) for i, t in want.items()}


def test_module_names_know_packages(spark, tmp_path):
    d = str(tmp_path)
    paths = ["src/pkg/__init__.py", "src/pkg/core.py", "src/pkg/sub/__init__.py", "src/pkg/sub/deep.py", "tool.py", "README.md"]
    spark.createDataFrame([(i, 1, p) for i, p in enumerate(paths)] + [(9, 2, "src/pkg/core.py")], "id long, repo_id long, path string").write.parquet(f"{d}/files.parquet")
    got = {r.id: r.module for r in QUERIES["module_names_all"](spark, d).collect()}
    assert got == {0: "pkg", 1: "pkg.core", 2: "pkg.sub", 3: "pkg.sub.deep", 4: "tool", 5: "", 9: "core"}
