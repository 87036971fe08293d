import pytest

from corbel.operators.extract import edges_of, extract_facts, extract_symbols, number_symbols, resolution_stats, resolve_snapshots, unresolved_of
from corbel.operators.resolve import EXACT, HIGH, LOW, MEDIUM, ancestor_order

IMPORTS = {
    "lib/__init__.py": "from .engine import Motor\nfrom . import tools\n",
    "lib/engine.py": "class Motor:\n    def start(self):\n        pass\n",
    "lib/tools.py": "def wrench():\n    pass\n",
    "lib/in/__init__.py": "",
    "lib/in/deep.py": "from .. import tools\nfrom ..engine import Motor as M\nimport os\nimport requests.adapters as ra\nfrom . import gone\nfrom .. import nothing\nfrom ... import too_far\ndef g():\n    tools.wrench()\n    M.start(None)\n",
    "main.py": "import lib.tools\nimport lib.engine as e\nfrom lib import Motor, tools as t\nfrom lib.in.deep import *\nfrom os.path import join\nimport json\ndef run():\n    lib.tools.wrench()\n    e.Motor.start(None)\n    Motor()\n    t.wrench()\n    g()\n    join('a')\n    json.dumps({})\n    unknown()\n",
}
IMPORTS = {k.replace("/in/", "/inn/"): v.replace("lib.in.", "lib.inn.") for k, v in IMPORTS.items()}


CLASSES = """
import abc
class Base:
    def hook(self): pass
    def shared(self): self.late()
class Child(Base):
    def hook(self, other=None):
        super().hook()
        self.hook(); self.shared(); Base.hook(self); self.nope()
        other.only_here(); other.hook(); other.__len__()
        len([]); x().run()
    def late(self): pass
class Outside(abc.ABC):
    def m(self): self.register(); super().m()
class Solo:
    def only_here(self): pass
def f(hook, print):
    hook(); print(); [y for y in hook]
    s = Solo(); s.only_here(); s.absent()
    (lambda: 1)()
def twice(): pass
def twice(): pass
def g(): twice()
"""

CASES = {
    "imports": IMPORTS,
    "classes": {"m.py": CLASSES},
    "receivers": {"m.py": "class A:\n    def go(self): pass\nclass B:\n    def go(self): pass\ndef f(p):\n    p.go(); p.q.go(); zzz.go()\n"},
    "diamond": {"m.py": "class A:\n    def x(self): pass\nclass B(A):\n    def x(self): pass\nclass C(A):\n    def x(self): pass\nclass D(B, C):\n    def x(self): pass\nclass E(D): pass\nclass F(E):\n    def x(self): pass\nclass G(A, B):\n    def x(self): super().x()\n"},
    "stars": {"p/__init__.py": "from .a import *\nfrom .b import loop\n", "p/a.py": "from .b import *\ndef one(): pass\n", "p/b.py": "from p import loop\ndef two(): pass\n", "u.py": "from p import one, two\nimport p\none(); two(); p.two(); p.loop()\n"},
    "made": {"m.py": "class A:\n    class In:\n        def deep(self): pass\n    def go(self): pass\nclass K(A): pass\ndef make(): return A()\na = A()\ndef f():\n    x = A\n    a.go()\n    b = K()\n    b.go(); b.In.deep(); b.lost()\n    y = z()\n    z = y()\n    y.go()\n    c = b()\n    c.go()\nclass L(K.In):\n    def deep(self): super().deep()\n"},
    "many": {"m.py": "".join(f"class C{i}:\n    def same(self): pass\n" for i in range(6)) + "def f(p):\n    p.same()\n"},
    "hooks": {"m.py": "class A:\n    def run(self): self.hook()\nclass B(A):\n    def hook(self): pass\nclass C(B):\n    def hook(self): pass\n" + "class Z:\n    def run(self): self.late()\n" + "".join(f"class Z{i}(Z):\n    def late(self): pass\n" for i in range(6))},
    "last": {"a.py": "def f(): pass\nif x:\n    def f(): pass\nclass T:\n    def m(self): pass\n    def m(self, y): self.m()\n", "b.py": "from a import f, T\nf()\nT.m(1)\nclass U(T):\n    def m(self): super().m()\n"},
    "cycle": {"m.py": "class A(B):\n    def go(self): self.no()\nclass B(A):\n    def no(self): pass\n"},
}


@pytest.fixture(scope="module")
def resolved(spark):
    """All cases, each a repository of its own, resolved in one go: case -> (edges, missing, imports, counts) by names."""
    rows = []
    for repo, files in enumerate(CASES.values(), 1):
        for path, text in files.items():
            rows.append((len(rows) + 1, repo, path, path.removesuffix(".py").replace("/", ".").removesuffix(".__init__"), text.encode()))
    files = spark.createDataFrame(rows, "id long, repo_id long, path string, module_name string, content binary")
    names = {(r.file_id, r.temp_id): r.qualified_name for r in extract_symbols(files).collect()}
    out = {name: ({}, {}, set(), {}) for name in CASES}
    for r in resolve_snapshots(extract_facts(files)).collect():
        edges, missing, imports, counts = out[list(CASES)[r.repo_id - 1]]
        src, dst = names.get((r.src_file, r.src_temp)), names.get((r.dst_file, r.dst_temp))
        if r.what == "edge":
            assert (src, dst, r.kind) not in edges
            edges[src, dst, r.kind] = r.confidence
        elif r.what == "missing":
            assert (src, r.name, r.kind) not in missing
            missing[src, r.name, r.kind] = r.label == "external"
        elif r.what == "import":
            imports.add((src, r.name, dst, r.label))
        else:
            counts[r.kind, r.label] = r.n
    return out


def test_imports_in_every_form(resolved):
    edges, missing, imports, _ = resolved["imports"]
    for dst in ("lib.tools", "lib.engine", "lib", "lib.inn.deep"):
        assert edges["main", dst, "imports"] == EXACT
    assert edges["lib", "lib.engine", "imports"] == edges["lib", "lib.tools", "imports"] == edges["lib.inn.deep", "lib", "imports"] == EXACT
    assert ("lib", "lib", "imports") not in edges
    assert missing["lib.inn.deep", "os", "imports"] and missing["lib.inn.deep", "requests.adapters", "imports"] and missing["main", "os.path.join", "imports"]
    assert not missing["lib.inn.deep", ".gone", "imports"] and not missing["lib.inn.deep", "..nothing", "imports"] and not missing["lib.inn.deep", "...too_far", "imports"]
    assert edges["main.run", "lib.tools.wrench", "calls"] == EXACT and edges["main.run", "lib.engine.Motor.start", "calls"] == EXACT
    assert edges["main.run", "lib.engine.Motor", "calls"] == EXACT and edges["main.run", "lib.inn.deep.g", "calls"] == HIGH
    assert missing["main.run", "join", "calls"] and missing["main.run", "json.dumps", "calls"] and not missing["main.run", "unknown", "calls"]
    assert {("lib.inn.deep", "os", None, "stdlib"), ("lib.inn.deep", "requests.adapters", None, "third-party"), ("main", "lib.Motor", "lib", "resolved"), ("lib.inn.deep", ".gone", None, "unresolved")} <= imports




def test_calls_and_confidences(resolved):
    edges, missing, _, counts = resolved["classes"]
    me = "m.Child.hook"
    assert edges[me, "m.Base.hook", "calls"] == EXACT  # super() of the only base
    assert edges[me, "m.Child.hook", "calls"] == EXACT and edges[me, "m.Base.shared", "calls"] == HIGH
    assert edges[me, "m.Solo.only_here", "calls"] == MEDIUM
    assert edges[me, "m.Base.hook", "calls"] == EXACT and not missing[me, "self.nope", "calls"] and not missing[me, "other.__len__", "calls"]
    assert missing[me, "len", "calls"] and not missing[me, "?.run", "calls"]
    assert edges["m.Child.hook", "m.Base.hook", "implements"] == EXACT and edges["m.Child", "m.Base", "inherits"] == EXACT
    assert edges["m.Base.shared", "m.Child.late", "calls"] == MEDIUM  # a hook that only subclasses define
    assert missing["m.Outside", "abc.ABC", "inherits"] and missing["m.Outside.m", "self.register", "calls"] and missing["m.Outside.m", "super().m", "calls"]
    assert not missing["m.f", "hook", "calls"] and not missing["m.f", "print", "calls"] and not missing["m.f", "<dynamic>", "calls"]
    assert edges["m.f", "m.Solo.only_here", "calls"] == EXACT and not missing["m.f", "s.absent", "calls"]
    assert edges["m.g", "m.twice", "calls"] == HIGH
    assert counts["calls", "resolved"] > 0 and counts["inherits", "resolved"] == counts["inherits", "external"] == 1 and ("inherits", "unresolved") not in counts


def test_unknown_receivers_need_a_known_root(resolved):
    edges, missing, _, _ = resolved["receivers"]
    assert edges["m.f", "m.A.go", "calls"] == edges["m.f", "m.B.go", "calls"] == LOW
    assert missing["m.f", "zzz.go", "calls"] is False
    edges, missing, _, _ = resolved["many"]
    assert not edges and missing["m.f", "p.same", "calls"] is False


def test_diamond_links_each_branch_and_hierarchies_that_contradict(resolved):
    edges = resolved["diamond"][0]
    assert edges["m.D.x", "m.B.x", "implements"] == edges["m.D.x", "m.C.x", "implements"] == EXACT
    assert edges["m.F.x", "m.D.x", "implements"] == HIGH
    assert ("m.D.x", "m.A.x", "implements") not in edges
    assert edges["m.G.x", "m.A.x", "calls"] == HIGH


def test_order_of_ancestors():
    plain = {"D": ["B", "C"], "B": ["A"], "C": ["A"]}
    assert ancestor_order("D", plain) == ["D", "B", "C", "A"] and ancestor_order("A", plain) == ["A"]
    assert ancestor_order("G", {"G": ["A", "B"], "B": ["A"]}) == ["G", "A", "B"]
    assert ancestor_order("A", {"A": ["B"], "B": ["A"]}) == ["A", "B"]

    class A: ...
    class B(A): ...
    class C(A): ...
    class D(C, A): ...
    class E(B, D): ...
    graph = {c: [b for b in c.__bases__ if b is not object] for c in (A, B, C, D, E)}
    for c in graph:
        assert ancestor_order(c, graph) == [k for k in c.__mro__ if k is not object]


def test_star_and_cyclic_reexports(resolved):
    edges, missing, _, _ = resolved["stars"]
    assert edges["u", "p.a.one", "calls"] == HIGH and edges["u", "p.b.two", "calls"] == HIGH
    assert not missing["p.b", "p.loop", "imports"]


def test_locals_have_the_type_of_their_constructor(resolved):
    edges, missing, _, _ = resolved["made"]
    assert edges["m.f", "m.A.go", "calls"] == EXACT and edges["m.f", "m.K", "calls"] == EXACT
    assert edges["m.f", "m.A.In.deep", "calls"] == LOW and missing["m.f", "b.lost", "calls"] is False  # two methods of that name
    assert edges["m.L", "m.A.In", "inherits"] == HIGH  # a class that a base inherits
    assert ("m.f", "y", "calls") in missing and ("m.f", "z", "calls") in missing


def test_hooks_of_subclasses(resolved):
    edges = resolved["hooks"][0]
    assert edges["m.A.run", "m.B.hook", "calls"] == edges["m.A.run", "m.C.hook", "calls"] == MEDIUM
    assert [edges["m.Z.run", f"m.Z{i}.late", "calls"] for i in range(6)] == [LOW] * 6


def test_last_definition_counts(resolved):
    edges = resolved["last"][0]
    assert edges["b", "a.f", "calls"] == HIGH and edges["b", "a.T.m", "calls"] == HIGH
    assert edges["a.T.m", "a.T.m", "calls"] == HIGH and edges["b.U.m", "a.T.m", "calls"] == HIGH


def test_classes_that_inherit_from_themselves(resolved):
    edges = resolved["cycle"][0]
    assert edges["m.A", "m.B", "inherits"] == edges["m.B", "m.A", "inherits"] == EXACT and edges["m.A.go", "m.B.no", "calls"] == HIGH


def test_tables(spark):
    rows = [(i, 1 + (i % 2 == 9), p, p.removesuffix(".py").replace("/", ".").removesuffix(".__init__"), t.encode()) for i, (p, t) in enumerate({**IMPORTS, "m.py": CLASSES, "bad.py": "def ok(): pass\nclass (:\n"}.items())]
    files = spark.createDataFrame(rows, "id long, repo_id long, path string, module_name string, content binary")
    numbered = number_symbols(extract_symbols(files)).cache()
    resolved = resolve_snapshots(extract_facts(files))
    edges = edges_of(resolved, numbered).collect()
    names = {r.id: r.qualified_name for r in numbered.collect()}
    assert {r.id for r in numbered.collect()} == set(range(1, len(names) + 1))
    got = {(names[e.src], names[e.dst], e.kind): e.confidence for e in edges}
    assert got["main.run", "lib.inn.deep.g", "calls"] == HIGH and got["m.Child", "m.Base", "inherits"] == EXACT
    assert "bad.ok" in names.values()
    assert any(u.name == "os" and u.external for u in unresolved_of(resolved, numbered).collect())
    stats = {r.kind: r for r in resolution_stats(resolved).collect()}
    assert stats["inherits"].resolved == 1 and stats["inherits"].external == 1 and stats["inherits"].ratio == 1.0
    assert resolve_snapshots(extract_facts(files.limit(0))).count() == 0


def test_a_file_needs_its_module_symbol(spark):
    files = spark.createDataFrame([(1, 1, "a.py", "a", b"x = 1")], "id long, repo_id long, path string, module_name string, content binary")
    with pytest.raises(Exception, match="no module symbol"):
        resolve_snapshots(extract_facts(files).selectExpr("file_id", "repo_id", "path", "module_name", "filter(symbols, s -> s.temp > 1) AS symbols", "imports", "scopes", "binds", "bases", "calls")).count()
