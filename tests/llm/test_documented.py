import ast

import pytest
from pyspark.sql import functions as F

from corbel.llm.documented import columns_of, documented_functions, functions_of, telling

SOURCE = '''"""Module."""
import os  # comment

# First note
# second note
@dec(1)
@other
def one(a, b={"x": "y"}, *c) -> "str":
    """Adds
        deep

    two."""
    return "not a doc"


class C:
    \'\'\'Class text.\'\'\'
    x = ("a",
"b")
    def two(self,
            a=")", # odd )
            b="""x
def no(): pass
"""):

        # remark
        r"raw \\d" ' joined'
        def inner(): "inline text"
        if a:
            pass
    async  def three(self): return "x"
    @property
    def four(self):
        f"not {a} doc"
    # below class
    def five(self): pass

def six():
    b"bytes"
def seven():
    "text" % 3
def eight():
    "kept"; x = 1
def nine(a=lambda: "s"):
    \\
    "after\\tjoin"
\tdef_ = 1
'''


def _expected(source):
    out = {}
    for n in ast.walk(ast.parse(source)):
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            doc = ast.get_docstring(n)
            out[min([n.lineno, *(d.lineno for d in n.decorator_list)])] = (n.lineno, n.end_lineno, doc and " ".join(doc.split()))
    return out


def test_functions_equal_the_syntax_tree(spark):
    source = SOURCE.rpartition("\tdef_")[0]
    texts = [source, source.replace("    ", "\t"), "", None, "x = 1", "def f():\n  'd'", "class A:\n  def f(self):\n    '''d'''\n\n\n\n# end\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    rows = functions_of(df).collect()
    for i, text in enumerate(texts):
        got = {r.start_line: (r.def_line, r.end_line, r.docstring and " ".join(r.docstring.split())) for r in rows if r.file_id == i}
        assert got == (_expected(text) if text else {}), i
    assert next(r.comment for r in rows if r.file_id == 0 and r.def_line == 8) == "First note\nsecond note"
    assert next(r.comment for r in rows if r.file_id == 0 and r.def_line == 36) == "below class"


TELLING = ["Undo for the gate.", "Ties go to the older index.", "TODO: move this.\n\nCalling x wraps the ranker.", "Mengen werden sortiert.", "Args:\n    item: open encoder of the pipeline", "Load_rows reads every row twice.", "Écrit la liste.", "行を読む", ":param x: the number of rows\n:return: nothing", "Age, in seconds."]
EMPTY = [None, "", "  \n ", "...", "=====", "?", "TODO", "todo: write docs", "FIXME\n\nload rows.", "Load rows!", "load_rows()", "The load_rows function.", "This method is used to load rows.", "Loads row.", "noqa: D102", "type: ignore", "Args:\n    x (int):\n\nReturns:\n    dict:\n\nRaises:", ":param x:\n:type x: str\n:rtype: None", "Parameters\n----------\nx\ny", "Dokumentation folgt.", "Beschreibung fehlt.", "À compléter.", "Falta la documentación de esta función; se añadirá más adelante.", "This docstring was generated automatically and nobody has edited it so far.", "N/A", "[summary]", "Funktion load_rows.", "The documentation for this method will be added later by the owner of the module.", "x: int"]


@pytest.mark.parametrize(("docs", "want"), [(TELLING, True), (EMPTY, False)])
def test_telling(spark, docs, want):
    df = spark.createDataFrame([(d, "load_rows") for d in docs], "doc string, name string")
    got = [(r.doc, r.t) for r in df.select("doc", telling(F.col("doc"), F.col("name")).alias("t")).collect()]
    assert got == [(d, want) for d in docs]


def test_pairs(spark):
    data = "# coding: latin-1\r\n@d\r\ndef load(a):\r\n    'Liest é.'\r\n    return 1\r\n".encode("latin-1")
    odd = "# -*- coding: cp1252 -*-\ndef load(a):\n    '''Costs 5 \u20ac.'''\n".encode("cp1252")
    files = spark.createDataFrame([(1, "a.py", data, 0), (2, "b.py", b"\xff\xfe def", 0), (3, None, None, 0), (4, "c.py", odd, 0), (5, "d.py", b"# coding: nonsense\ndef load(a):\n  'x y'\n", 0)], "id long, path string, content binary, start_line int")
    cols = "id long, file_id long, kind string, name string, qualified_name string, parent_id long, start_line int, end_line int, signature string, docstring string"
    lost = (1, 1, "function", "load", "a.load", None, 2, 5, None, None)
    rows = [lost, lost, (2, 1, "function", "load", "a.load", None, 3, 5, "def load(a):", ""), (3, 1, "class", "K", "a.K", None, 2, 5, None, "Real text here."), (4, 2, "method", "m", "b.m", None, 1, 1, "def m():", "Has its own text."), (5, 2, "method", "m", "b.m", None, 1, 1, "def m():", None), (6, None, "function", None, None, None, None, None, None, "Speaks anyway."), (None, 1, "function", "load", "a.load", None, 2, 5, None, None), (7, 4, "function", "load", "c.load", None, 2, 3, None, None), (8, 5, "function", "load", "d.load", None, 2, 3, None, None)]
    symbols = spark.createDataFrame(rows, cols)
    got = {r.symbol_id: r for r in documented_functions(symbols, files).collect()}
    assert set(got) == {1, 2, 4, 6, 7} and got[7].documentation == "Costs 5 \u20ac."
    assert got[1].documentation == "Liest é." and got[1].signature == "@d\ndef load(a):" and got[1].code.startswith("@d\ndef load") and got[1].code.endswith("return 1")
    assert {r.symbol_id for r in documented_functions(symbols, files, code=False).collect()} == set(got)
    assert documented_functions(symbols.limit(0), files.limit(0)).count() == 0


def test_late_coding_line_and_deep_indents(spark):
    from corbel.llm.documented import sources_of

    late = ("# " + "x" * 500 + "\n# coding: latin-1\ndef f():\n    'Größe des Puffers in Zeilen.'\n").encode("latin-1")
    deep = b"if 1:\n" + b" " * 450 + b"def g():\n" + b" " * 451 + b"return 1\n"
    files = spark.createDataFrame([(1, "a.py", late), (2, "b.py", deep)], "id long, path string, content binary")
    got = {r.file_id: (r.docstring, r.end_line) for r in functions_of(sources_of(files)).collect()}
    assert got == {1: ("Größe des Puffers in Zeilen.", 4), 2: (None, 3)}


def test_columns_of_white_space(spark):
    cases = {"": 0, "    ": 4, "\t": 8, "  \t": 8, "       \t": 8, "        \t": 16, "\t \t  ": 18, "    \f  ": 2, "\f": 0, "\t\f\t": 8}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "b string, n int")
    assert all(r.n == r.c for r in df.select("b", "n", columns_of(F.col("b")).alias("c")).collect())


def test_the_source_decides_where_a_function_is_found(spark):
    content = b'def a():\n    """Counts the retries."""\n\ndef b():\n    pass\n'
    files = spark.createDataFrame([(1, "m.py", content)], "id long, path string, content binary")
    symbols = spark.createDataFrame([(1, 1, "function", "a", "m.a", None, 1, 2, "stale"), (2, 1, "function", "b", "m.b", None, 4, 5, "Says what the source does not."), (3, 1, "function", "c", "m.c", None, 40, 50, "Walks all edges of the graph.")], "id long, file_id long, kind string, name string, qualified_name string, signature string, start_line int, end_line int, docstring string")
    got = {r.symbol_id: r.documentation for r in documented_functions(symbols, files).collect()}
    assert got == {1: "Counts the retries.", 3: "Walks all edges of the graph."}
