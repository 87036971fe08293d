import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corbel.functions import names as N
from corbel.functions import text as T
from corbel.operators.python_chunks import count_tokens

CASES = {
    "merge_queue": ["merge_queue", "merge", "queue"],
    "parseChunkHeader": ["parsechunkheader", "parse", "chunk", "header"],
    "HTTPServer": ["httpserver", "http", "server"],
    "MAX_RETRY": ["max_retry", "max", "retry"],
    "a.bC.d_e": ["bc", "b", "c", "d_e", "d", "e"],
    "__init__": ["init"],
    "_private ___": ["private"],
    "utf8 v2 parseJSON2": ["utf8", "v2", "parsejson2", "parse", "json2"],
    "the cat is on_the mat": ["cat", "on_the", "mat"],
    "": [],
    " \t\n": [],
    "a_b": ["a_b", "b"],
    "größeÄnderung": ["größeänderung", "größe", "änderung"],
}


def _one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in rows.select("i", column.alias("x")).orderBy("i").collect()]


def test_tokens(spark):
    assert _one(spark, T.tokenize_code(F.col("t")), *CASES, None) == [*CASES.values(), []]


def test_token_estimate_agrees_in_both_forms(spark):
    texts = ["", None, "foo_bar(x, y)", "a" * 9, "  \t", "naïve 123 — x", "日本語テキスト", "x²y", "ab́c", "…"]
    assert _one(spark, T.count_tokens(F.col("t")), *texts) == [count_tokens(t or "") for t in texts]
    assert count_tokens("foo_bar(x, y)") == 2 + 1 + 1 + 1 + 1 + 1


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(max_size=12), min_size=1, max_size=20), limit=st.integers(0, 20))
def test_truncation_is_the_longest_valid_prefix(spark, texts, limit):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    want = [t.encode()[:limit].decode("utf-8", "ignore") for t in texts]
    assert _one(spark, T.truncate_bytes(F.col("t"), limit), *texts) == want


def test_bounded_text(spark):
    assert _one(spark, T.snippet(F.col("t"), 2, 5), "ab\ncdef\ng") == ["ab\ncd"]
    assert _one(spark, T.squeeze(F.col("t")), "  a  \n b ") == ["a b"]
    assert _one(spark, T.slice_lines(F.col("t"), F.lit(2), 2), "a\nb\nc\nd") == ["b\nc"]
    assert _one(spark, T.truncate_to_tokens(F.col("t"), 2), "a b c d e f g h i j", "!!!") == ["a b c d ", "!!!"]
    assert _one(spark, T.embedding_text(F.lit(None).cast("string"), F.col("t")), "x") == ["x"]
    assert _one(spark, T.embedding_text(F.lit("h"), F.col("t")), "x") == ["h\nx"]


def test_modules(spark):
    assert _one(spark, N.module_from_path(F.col("t")), "pkg/routing.py", "pkg/__init__.py", "a/b/c/__init__.py", "top.py") == ["pkg.routing", "pkg", "a.b.c", "top"]
    assert _one(spark, N.module_paths(F.col("t")), "a.b") == [["a/b.py", "a/b/__init__.py"]]
    ab = lambda mod, pkg, level, written: _one(spark, N.absolute_module(F.lit(mod), F.lit(pkg), F.lit(level), F.lit(written)), "x")[0]
    assert [ab("a.b.c", False, 1, "x"), ab("a.b", True, 1, ""), ab("a.b.c", False, 2, ""), ab("a.b.c", False, 3, "x"), ab("a.b.c", False, 4, "x"), ab("", False, 1, "x"), ab("a", False, 0, "os.path"), ab("a", False, 1, "")] == ["a.b.x", "a.b", "a", "x", None, None, "os.path", None]


@pytest.mark.parametrize(("raw", "want"), [("https://github.com/o/r", "https://github.com/o/r.git"), (" git@github.com:o/r.git ", "https://github.com/o/r.git"), ("https://www.github.com/o/r/", "https://github.com/o/r.git"), ("http://github.com/o/r", None), ("https://github.com/o", None), ("https://u:p@github.com/o/r", None), ("https://github.com/o/r?x=1", None), ("https://example.com/o/r", None), ("https://github.com/o/..", None), (None, None)])
def test_urls(spark, raw, want):
    assert _one(spark, N.canonical_repository_url(F.col("t")), raw) == [want]


def test_citations(spark):
    c = N.unknown_citations(F.col("t"), F.array(F.lit("e2"), F.lit("e9")), F.array(F.lit("e1"), F.lit("e2")))
    assert [sorted(x) for x in _one(spark, c, "see [e1] and [e3]", None)] == [["e3", "e9"], ["e9"]]
