import ast
import json
import os
import random
import tomllib
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corbel.llm import derivatives
from corbel.llm.syntax import flag_files, invalid_rates, verdict

VALID = """
@a.b(c)[0]
async def f[T: int = str, *U, **V](a, b: int = 1, /, c=2, *d: *e, g, h=3, **k) -> x:
    'doc'
    async with (a as b, c as (d, e),): await x
    async for i, *j in *k, l: yield
    return *a, b
class C(A, *B, metaclass=M, **kw): x: int = 3 if 0 else lambda *a, b=lambda: 1, **k: (yield)
try: pass
except* A as e: raise B from e
else: del a, (b, [c]), d.e[1:2, ::3]
finally: global q, r
match x, *y:
    case [1, -2.5 + 3j, *_] | {"a": b, **r} | P.Q(s, t=None) as u if v: type X[T] = int
    case _: match = case = type = print(f"{x!r:>{w}} {y=}{{" "s", rb'' if 0 else b'b' b"c")
(a.b, [c, *d]), f(x)[0] = e = yield from g
(n): int; x += 1; f(x for x in y if z if w); f(a := 1, *b, c=2, *d, **e, h=3)
{**a, 1: 2}; {*a, b}; {a: b for c in d}; [*a, (b := c)]; not -a ** ~b is not c not in d
from ... import (a as b, c,); from .x import *; import a.b as c, d; nonlocal z; assert a, b
while x: break
else: continue
lambda: (yield); print(*a, sep=''); x = yield; x[a:b, *c]; x = a if b else c if d else lambda: e
"""
BROKEN = ["f() = 1", "x = = 1", "def f(a=1, b): pass", "def f(*): pass", "f(a=1, b)", "f(**a, *b)", "f(x for x in y, 1)", "a + not b", "print 'x'", "if x:\npass", "try: pass", "x := 1", "for f() in x: pass", "[x, y for x in z]", "(*a)", "del f()", "lambda a=1, b: 0", "'a' b'b'", "'\\x1'", "b'é'", "f'{}'", "f'{a!z}'", "1__0", "0777", "a b", "class C: x = 1\n y = 2", "except: pass", "import a.b as c.d", "from a import (b", "x = (1,", "'''abc", "<<<<<<< HEAD\na = 1\n=======\n", "async x", "match x:\n    case a.b():\n        pass\n    case 1 + 2: pass", "None = 1", "a <> b", "x = $y", "\\ x", "return = 3", "@x\na = 1", "else: pass", "while: pass", "case x: pass"]


def _parses(source):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(source)
    except (SyntaxError, ValueError):
        return False
    return True


def test_whole_grammar_is_accepted():
    assert _parses(VALID.encode()) and verdict("python", VALID.encode()) == (None, None)


@pytest.mark.parametrize("source", BROKEN)
def test_broken_sources(source):
    assert not _parses(source.encode())
    assert verdict("python", source.encode())[0] is not None


def test_mutations_agree_with_the_language_itself():
    rnd = random.Random(12)
    bits = ["(", ")", ":", ",", "=", " if ", "*", "**", "[", "]", "{", "}", ".", " lambda ", " for ", "\n", "    ", "await ", ";", "@", ":=", '"', "f'", "1", "None", " as ", "match ", "!", "$", "\\", "_", "|", "\t"]
    for _ in range(3000):
        s = VALID
        for _ in range(rnd.choice([1, 1, 2])):
            i = rnd.randrange(len(s) + 1)
            op = rnd.random()
            s = s[:i] + s[i + rnd.choice([1, 2, 9]) :] if op < 0.4 else s[:i] + rnd.choice(bits) + s[i:] if op < 0.9 else s[:i]
        assert (verdict("python", s.encode())[0] is None) == _parses(s.encode()), s


def test_reasons_and_lines():
    assert verdict("python", b"x = 1\ny = )\n")[1] == 2
    assert verdict("python", b"def f(a,\n")[0] == "truncated" and verdict("python", b"x = '''a\nb")[0] == "truncated"
    assert verdict("python", b"if x:\n")[0] == "truncated"
    assert verdict("python", b"a = 1\nb c\n") == ("token", 2)
    assert verdict("json", b'{"a": [1, 2')[0] == "truncated" and verdict("json", b'{"a"\n 1}') == ("token", 2)
    assert verdict("toml", b"a = [1,\n")[0] == "truncated" and verdict("toml", b"a = 1\nb\n") == ("token", 2)


@pytest.mark.parametrize(("data", "ok"), [(b"", True), (b"# coding: latin-1\nx = '\xe9'\n", True), (b"x = '\xe9'\n", False), (b"\xef\xbb\xbfx = 1\n", True), (b"\xef\xbb\xbf# coding: latin-1\n", False), (b"# coding: nonsense\n", False), (b"x = 1\x00\n", False), (b"x = 1\r\ny = 2\r", True), (b"if x:\n\ty\n        z\n", False), (b"\x0cx = 1\n", True), ("x = “a”".encode(), False), ("é = 1".encode(), True)])
def test_encodings(data, ok):
    assert _parses(data) == ok == (verdict("python", data)[0] is None)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='{}[]:,"\\u0e-+. \n\t1tfnrulasea/x', max_size=14))
def test_json_agrees(s):
    s2 = s.replace("NaN", "").replace("Infinity", "")
    try:
        json.loads(s2)
        ok = True
    except ValueError:
        ok = False
    assert (verdict("json", s2.encode())[0] is None) == ok


def test_json_documents():
    for s, ok in [('{"a": [1, 2.5e-3, null, {"b": "\\u00e9"}]}', True), ("", False), ('{"a": 1,}', False), ("{'a': 1}", False), ('{"a": 1} x', False), ("[1 2]", False), ("01", False), ('"a\nb"', False), (" 7 ", True)]:
        assert (verdict("json", s.encode())[0] is None) == ok, s


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", '"k"', " = ", "=", "1", "1.5", "true", '"s"', "'l'", "[", "]", "{", "}", ",", "\n", "[[", "]]", "# c", "1979-05-27", "07:32:00", '"""m\n"""', "-", "inf", "."]), max_size=9))
def test_toml_agrees_but_for_repeated_keys(parts):
    s = "".join(parts)
    try:
        tomllib.loads(s)
        ok = True
    except tomllib.TOMLDecodeError as e:
        if any(w in str(e) for w in ("overwrite", "Cannot", "twice", "Duplicate")):
            return
        ok = False
    assert (verdict("toml", s.encode())[0] is None) == ok, s


def test_derivatives_are_shared_and_forgettable():
    g, start = derivatives.json_language()
    codes = [g.code(c) for c in "[[[]]]"]
    assert g.parse(start, codes) == (6, True)
    before = len(g._seen)
    assert g.parse(start, codes) == (6, True) and len(g._seen) == before
    g.forget()
    assert len(g._seen) < before and g.parse(start, codes) == (6, True) and g.parse(start, codes[:4]) == (4, False)


def test_files_and_rates(spark):
    rows = [(1, 1, "a.py", b"x = 1\n"), (2, 1, "b.PY", b"x = \n"), (3, 1, "c.json", b""), (4, 1, "d.txt", b"x = ("), (5, 2, None, b"x"), (6, 2, "e.toml", None), (7, 2, "f.toml", b""), (8, 1, "dir.py/noext", b"("), (2, 1, "b.PY", b"x = \n")]
    df = spark.createDataFrame([(*r, "python") for r in rows], "id long, repo_id long, path string, content binary, language string")
    got = {r.file_id: (r.language, r.invalid, r.reason) for r in flag_files(df).collect()}
    assert got == {1: ("python", False, None), 2: ("python", True, "token"), 3: ("json", True, "truncated"), 4: (None, False, None), 5: (None, False, None), 6: ("toml", False, None), 7: ("toml", False, None), 8: (None, False, None)}
    assert sorted(map(tuple, invalid_rates(df).collect())) == [(1, "json", 1, 1, 1.0), (1, "python", 2, 1, 0.5), (2, "toml", 1, 0, 0.0)]
    assert flag_files(df.limit(0)).count() == 0 and invalid_rates(df.limit(0)).count() == 0


def test_bases_of_a_class_are_no_comprehension():
    assert verdict("python", b"class A(x for x in y): pass\n") == ("token", 1)
    for good in (b"f(x for x in y)\n", b"class A(B, metaclass=C): pass\n", b"class A(*b, **c): pass\n", b"class A((x for x in y)): pass\n"):
        assert verdict("python", good) == (None, None)


def test_what_is_cut_off_is_truncated():
    """5,000 beginnings of valid sources are valid or truncated, by the end derivative, and agree with the language's parser."""
    rnd, folder = random.Random(3), os.path.dirname(ast.__file__)
    texts = []
    for name in ("ast", "json/decoder", "textwrap", "dataclasses", "contextlib", "enum", "statistics", "heapq", "bisect", "queue"):
        with open(os.path.join(folder, f"{name}.py"), encoding="utf-8") as f:
            texts.append(f.read()[:12_000].rpartition("\n")[0] + "\n")
    checked = 0
    while checked < 5000:
        text = rnd.choice(texts)
        start = text[: rnd.randrange(min(len(text), rnd.choice([200, 2000, 12_000])))]
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(start)
            valid = True
        except SyntaxError:
            valid = False
        reason, _ = verdict("python", start.encode())
        assert (reason is None) == valid and (valid or reason == "truncated" or start.endswith("..")), start[-80:]
        checked += 1
    for name, whole in (("json", b'{"a": [1, 2.5e3, "x\\n", null], "b": {"c": true}}'), ("toml", b'a = [1, "x"]\n')):
        for n in range(1, len(whole)):
            if name == "json":
                assert verdict(name, whole[:n])[0] in ("truncated", "lexical"), whole[:n]
    assert verdict("toml", b"a = [1, ")[0] == verdict("toml", b"a =")[0] == verdict("toml", b'a = "x')[0] == "truncated"
