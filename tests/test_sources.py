import os

import pytest
from pyspark.sql import functions as F

from corbel.operators.python_chunks import MAX_BYTES, FileChunker, count_tokens, text_chunks
from corbel.operators.python_source import clean, cut_lines, header, import_lines, line_offsets, parse, symbols
from corbel.sources import evalset
from corbel.sources.files import IgnoreRules, excerpt, keep_unignored, language, module_names, pruned, scan
from corbel.sources.store import Store, load_index_json, save_index_json, write_report

NESTED = '''"""Top."""
import os, sys as system
from a.b import (c,
    d as e)

LIMIT: int = 3
x = y = f = lambda: 0
a, b = 1, 2


@deco(":", key={1: 2})
async def outer(p: dict[str, int] = {1: 2}, *, q=lambda v: v) -> "a:b":
    """Doc.

        Deep.
    Back.
    """
    inside = 1
    class Local:
        def m(self): return lambda: {"a": 1}
    def helper():
        pass


class C(Base[int], metaclass=M):
    # a note
    'Class doc.'
    attr = 1
    if True:
        def cond(self): pass
    else:
        def cond(self): pass
    @property
    def value(self):
        f"""not {1} doc"""
    class D: z = 2

try:
    def guarded(): b"bytes"
except ImportError:
    guarded = None
match 1:
    case 1:
        matched = 2
'''


def test_symbols_of_nested_definitions():
    found, _ = symbols(parse(NESTED), "pkg.mod")
    got = [(s.kind, s.qualified_name.removeprefix("pkg.mod"), s.start_line, s.end_line, found[s.parent - 1].name if s.parent else None) for s in found]
    assert got == [
        ("module", "", 1, 45, None),
        ("variable", ".LIMIT", 6, 6, "pkg.mod"),
        ("variable", ".x", 7, 7, "pkg.mod"),
        ("function", ".outer", 11, 22, "pkg.mod"),
        ("class", ".outer.<locals>.Local", 19, 20, "outer"),
        ("method", ".outer.<locals>.Local.m", 20, 20, "Local"),
        ("function", ".outer.<locals>.helper", 21, 22, "outer"),
        ("class", ".C", 25, 36, "pkg.mod"),
        ("variable", ".C.attr", 28, 28, "C"),
        ("method", ".C.cond", 30, 30, "C"),
        ("method", ".C.cond", 32, 32, "C"),
        ("method", ".C.value", 33, 35, "C"),
        ("class", ".C.D", 36, 36, "C"),
        ("variable", ".C.D.z", 36, 36, "D"),
        ("function", ".guarded", 39, 39, "pkg.mod"),
        ("variable", ".guarded", 41, 41, "pkg.mod"),
        ("variable", ".matched", 44, 44, "pkg.mod"),
    ]
    docs = {s.qualified_name.removeprefix("pkg.mod"): s.docstring for s in found}
    assert docs[""] == "Top." and docs[".outer"] == "Doc.\n\n    Deep.\nBack." and docs[".C"] == "Class doc." and docs[".C.value"] == "" and docs[".guarded"] == ""
    signs = {s.qualified_name.removeprefix("pkg.mod"): s.signature for s in found}
    assert signs[".outer"] == '@deco(":", key={1: 2})\nasync def outer(p: dict[str, int] = {1: 2}, *, q=lambda v: v) -> "a:b":'
    assert signs[".C"] == "class C(Base[int], metaclass=M):" and signs[".C.D"] == "class D:" and signs[".outer.<locals>.Local.m"] == "def m(self):"


def test_pieces_of_source():
    p = parse(NESTED)
    assert import_lines(p) == [("import os, sys as system", ["os", "system"]), ("from a.b import (c, d as e)", ["c", "e"])]
    assert clean("one  \n    two\n\n      three\n  ") == "one\ntwo\n\n  three"
    assert header("def f(\n  a): pass", line_offsets("def f(\n  a): pass"), parse("def f(\n  a): pass").body[0]) == "def f(\n  a):"
    cuts = cut_lines(parse("x = 1\n# c\n# d\ny = 2\nif x:\n    a = 1\n    b = 2; c = 3\n    z = 4\n"))
    assert cuts == {2: 0, 5: 0, 7: 1, 8: 1}


def test_recovery_keeps_what_parses():
    p = parse("import os\ndef ok():\n    return 1\n\nclass Broken(:\n    def lost(self): pass\n\n@deco\ndef fine(): pass\nx = (\n")
    names = {s.name for s in symbols(p, "m")[0]}
    assert {"ok", "fine"} <= names and "lost" not in names and p.errors
    assert symbols(parse("def ok(): pass\nx = (", False), "m")[0][0].kind == "module" and len(symbols(parse("def ok(): pass\nx = (", False), "m")[0]) == 1


def _covered(chunks, n):
    lines = [x for c in chunks for x in range(c["start_line"], c["end_line"] + 1)]
    assert lines == list(range(1, n + 1))


BIG = "import os\nimport re\n\n\n" + "".join(f"def f{i}(a):\n    return os.path.join(a, '{i}')\n\n\n" for i in range(4)) + "class Big:\n    'Doc.'\n    limit = 1\n\n" + "".join(f"    def m{i}(self):\n" + "".join(f"        value_{j} = re.sub('a', 'b', self.name) + str({j})\n" for j in range(30)) + "\n" for i in range(3)) + "\n\nif __name__ == '__main__':\n    f0(1)\n"


@pytest.mark.parametrize("text", [NESTED, BIG, BIG.rstrip("\n"), "x = 1\n\n\n\n", "\n\n", "def a(): pass\nclass (:\n    def b(self): pass\n"])
def test_chunks_cover_every_line_and_cut_no_symbol(text):
    p = parse(text)
    found, _ = symbols(p, "m")
    chunker = FileChunker("m.py", p, found)
    chunks = chunker.chunks()
    _covered(chunks, len(chunker.lines))
    for c in chunks:
        assert c["text"] == "\n".join(chunker.lines[c["start_line"] - 1 : c["end_line"]])
        assert c["token_count"] == count_tokens(c["context_header"] + "\n" + c["text"])
        for s in found[1:]:
            a, b = s.start_line, s.end_line
            assert c["end_line"] < a or c["start_line"] > b or (a <= c["start_line"] and c["end_line"] <= b) or (c["start_line"] <= a and b <= c["end_line"])


def test_chunk_headers():
    p = parse(BIG)
    found, _ = symbols(p, "m")
    chunks = FileChunker("m.py", p, found).chunks()
    heads = [c["context_header"] for c in chunks]
    assert heads[0].startswith("file: m.py\nscope: module-level code\nimports: import os; import re")
    assert any("\nsymbols: m.f0, m.f1" in h and "signature: def f0(a):" in h for h in heads)
    assert any("symbol: m.Big\nclass: Big\nscope: class body (signature, docstring, attributes)" in h and h.endswith("signature: class Big:") for h in heads)
    assert any("symbol: m.Big.m2\nclass: Big\nimports: import re\nsignature: def m2(self):\npart 1 of " in h for h in heads)
    # A blank line taken in behind a symbol makes the piece larger than it, so its statements are no legal cuts any more.
    assert any(c["token_count"] > 512 and "m0" in c["context_header"] for c in chunks)


def test_text_chunks():
    long = "é" * 5000
    text = "".join(f"line {i} of text\n" for i in range(300)) + long + "\nend"
    chunks = text_chunks("docs/" + "p" * 200, text.encode())
    assert all(len(c["text"].encode()) <= MAX_BYTES and c["end_line"] - c["start_line"] < 128 and c["token_count"] <= 512 for c in chunks)
    whole = [c for c in chunks if c["start_line"] != 301]
    assert "\n".join(c["text"] for c in whole if c["end_line"] <= 300) + "\n" == text[: text.index(long)]
    assert "".join(c["text"] for c in chunks if c["start_line"] == 301) == long
    assert len(chunks[0]["context_header"].split("\n")[0]) == 128 + 6
    assert text_chunks("a", b"") == [] and text_chunks("a", b"\xff") is None and [c["text"] for c in text_chunks("a", b"\n\n")] == ["\n"]


def test_ignore_rules():
    r = IgnoreRules({"": "*.log\n!keep.log\n/top\nsub/only.py\nfolder/\n# note\n**/deep/x?.[ch]\n\\#odd\n", "a": "!b.log\nz.py\n"})
    yes = ["x.log", "a/b.log", "top", "top/y.py", "sub/only.py", "folder/q.py", "n/folder/q.py", "p/deep/x1.c", "deep/x1.h", "#odd", "a/z.py", "a/k/z.py"]
    no = ["keep.log", "n/top", "n/sub/only.py", "folder", "p/deep/x12.c", "z.py", "note"]
    assert [p for p in yes if not r.ignored(p)] == [] and [p for p in no if r.ignored(p)] == []


@pytest.fixture
def tree(tmp_path):
    for path, data in {
        "pkg/__init__.py": "", "pkg/core.py": "def f(): pass\n", "pkg/sub/__init__.py": "", "pkg/sub/deep.py": "", "loose/x.py": "", "loose/pk/__init__.py": "", "loose/pk/y.py": "",
        ".venv/z.py": "", "x.egg-info/q.py": "", "readme.md": "# hi", "skip.py": "", ".gitignore": "skip.py\n", "pkg/.gitignore": "*.tmp.py\n", "pkg/a.tmp.py": "", "data.bin": "",
    }.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(data)
    return str(tmp_path)


def test_scan(spark, tree):
    got = {r.path: r for r in scan(spark, tree, 7, text=True).collect()}
    assert {p: r.module_name for p, r in got.items()} == {"pkg/__init__.py": "pkg", "pkg/core.py": "pkg.core", "pkg/sub/__init__.py": "pkg.sub", "pkg/sub/deep.py": "pkg.sub.deep", "loose/x.py": "x", "loose/pk/__init__.py": "pk", "loose/pk/y.py": "pk.y", "readme.md": ""}
    assert got["pkg/core.py"].content == b"def f(): pass\n" and got["readme.md"].language == "text" and len(got["pkg/core.py"].content_hash) == 64
    assert {r.path for r in scan(spark, tree).collect()} == set(got) - {"readme.md"}


def test_file_tables(spark):
    f = spark.createDataFrame([(1, "a/b/x.py"), (1, "a/b/__init__.py"), (1, "__init__.py"), (2, "a/b/x.py"), (1, "build/q.py"), (1, "n.MD"), (1, "o.exe")], "repo_id long, path string")
    got = {(r.repo_id, r.path): r.module_name for r in module_names(f).collect()}
    assert got[1, "a/b/x.py"] == "b.x" and got[2, "a/b/x.py"] == "x" and got[1, "a/b/__init__.py"] == "b" and got[1, "__init__.py"] == "" and got[1, "n.MD"] == ""
    assert {r.path for r in f.where(pruned(F.col("path"))).collect()} == {"build/q.py"}
    assert {r.path: r.l for r in f.select("path", language(F.col("path")).alias("l")).collect()}["n.MD"] == "text"
    ig = spark.createDataFrame([(1, "", "*.exe\n"), (1, "a", "b/x.py")], "repo_id long, dir string, text string")
    assert {(r.repo_id, r.path) for r in keep_unignored(f, ig).collect()} == {(1, "a/b/__init__.py"), (1, "__init__.py"), (2, "a/b/x.py"), (1, "build/q.py"), (1, "n.MD")}
    src = spark.createDataFrame([("a", b"1\n2\n3")], "path string, content binary")
    assert [tuple(r) for r in excerpt(src, "a", 2, 99).collect()] == [("a", 2, 3, "2\n3")] and excerpt(src, "zz", 1, 1).count() == 0
    with pytest.raises(ValueError, match="in order"):
        excerpt(src, "a", 3, 2)


def test_evaluation_set(spark, tmp_path):
    q = {"id": "x1", "type": "semantic", "query": "how", "verification": "source", "labels": [{"path": "a.py", "start_line": 1, "end_line": 2}]}
    import yaml

    p = tmp_path / "q.yaml"
    p.write_text(yaml.safe_dump({"queries": [q, {**q, "id": "x2"}]}))
    queries, labels = evalset.load(spark, str(p), least=2)
    assert queries.count() == 2 and labels.first().end_line == 2
    p.write_text(yaml.safe_dump({"queries": [q, {**q, "type": "odd", "extra": 1, "labels": [{"path": "", "start_line": 3, "end_line": 1}]}]}))
    with pytest.raises(ValueError) as e:
        evalset.load(spark, str(p))
    for part in ("at least 20", "repeated", "unknown field extra", "type must be", "lines in order"):
        assert part in str(e.value)


def test_store_validates_and_replaces_one_repository(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.read("edges").count() == 0 and s.next_id("edges") == 1
    e = spark.createDataFrame([(1, 1, 5, 6, "calls", 1.0), (2, 2, 5, 6, "calls", 0.5)], "id long, repo_id long, src long, dst long, kind string, confidence double")
    s.replace("edges", e)
    s.replace("edges", e.where("repo_id = 1").withColumn("id", F.lit(9).cast("long")))
    assert {(r.repo_id, r.id) for r in s.read("edges").collect()} == {(1, 9), (2, 2)} and s.next_id("edges") == 10
    assert s.read("edges", 2).count() == 1
    with pytest.raises(Exception, match="confidence out of range"):
        s.replace("edges", e.withColumn("confidence", F.lit(2.0)))
    with pytest.raises(Exception, match="unknown edge kind"):
        s.replace("edges", e.withColumn("kind", F.lit("likes")))
    s.drop_repo("edges", 1)
    assert s.read("edges", 1).count() == 0
    maps = spark.createDataFrame([(1, 3, {"a": 2, "b": 1}), (2, 0, {})], "chunk_id long, length int, term_freq map<string,int>")
    save_index_json(maps, str(tmp_path / "ix"))
    post, stats = load_index_json(spark, str(tmp_path / "ix"))
    assert {tuple(r) for r in post.collect()} == {(1, "a", 2), (1, "b", 1)} and stats.count() == 2
    write_report(str(tmp_path / "r" / "x.json"), {"a": 1})
    assert os.path.exists(tmp_path / "r" / "x.json")
