"""Facts of one Python source file: symbols, cut lines, imports, scopes, class bases and call sites.

Plain functions over a file's bytes; :mod:`corbel.operators.extract` runs them on tables, a file at a time.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
import warnings
from dataclasses import dataclass, field

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
DEFINITIONS = (*FUNCTIONS, ast.ClassDef)


def decode(content: bytes) -> str | None:
    """Text by the language's own encoding rules, with line feeds only; null if the bytes don't fit them."""
    try:
        encoding, _ = tokenize.detect_encoding(io.BytesIO(content).readline)
        text = content.decode(encoding)
    except (SyntaxError, LookupError, UnicodeError, ValueError):
        return None
    return text.replace("\r\n", "\n").replace("\r", "\n")


@dataclass
class Parsed:
    """Statements that parse, and where the others begin."""

    text: str
    body: list[ast.stmt]
    errors: list[tuple[int, str]] = field(default_factory=list)

    @property
    def lines(self) -> list[str]:
        return self.text.split("\n")


_STATEMENT = re.compile(r"^(?=[^\s#)\]}])", re.M)


def _try(text: str) -> list[ast.stmt]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(text).body


def parse(text: str, recover: bool = True) -> Parsed:
    """All statements; if the file as a whole has an error, those top-level blocks that parse by themselves."""
    try:
        return Parsed(text, _try(text))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        out = Parsed(text, [], [(getattr(e, "lineno", None) or 1, str(getattr(e, "msg", e)))])
    if not recover:
        return out
    starts = [m.start() for m in _STATEMENT.finditer(text)]
    pending = ""  # decorators, or the head of a block whose tail begins at the margin
    for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
        pending = pending + text[a:b] if pending else text[a:b]
        first = text.count("\n", 0, b - len(pending))
        try:
            body = _try(pending)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            if pending.lstrip().startswith("@") and not re.search(r"^(?:async\s+)?(?:def|class)\b", pending, re.M):
                continue
            out.errors.append((first + (getattr(e, "lineno", None) or 1), str(getattr(e, "msg", e))))
            pending = ""
            continue
        for s in body:
            ast.increment_lineno(s, first)
        out.body += body
        pending = ""
    return out


# -- symbols ------------------------------------------------------------------------------------------------------------
def clean(raw: str) -> str:
    """Documentation without its common indentation, trailing blanks, and blank ends."""
    head, *rest = raw.split("\n")
    indents = [len(x) - len(x.lstrip(" \t")) for x in rest if x.strip(" \t")]
    cut = min(indents, default=0)
    lines = [head.rstrip(" \t"), *((x[cut:] if len(x) >= cut else x.lstrip(" \t")).rstrip(" \t") for x in rest)]
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def docstring(body: list[ast.stmt]) -> str:
    """The string literal that opens a body, cleaned; '' without one. Neither f-strings nor bytes are documentation."""
    if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
        return clean(body[0].value.value)
    return ""


def first_line(node: ast.stmt) -> int:
    """Line of the first decorator, or of the statement."""
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])


_SCAN = re.compile(r"""(?:[rRuUbBfF]{0,2})(?:\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|\#[^\n]*|[()\[\]{}:]|\blambda\b""", re.S)


def header(text: str, offsets: list[int], node: ast.stmt) -> str:
    """Source of a definition from its first decorator through the colon that ends its header; '' if there is none."""
    line = first_line(node)
    begin = offsets[line - 1] + len(text[offsets[line - 1] :]) - len(text[offsets[line - 1] :].lstrip(" \t\f"))
    depth = lambdas = 0
    for m in _SCAN.finditer(text, offsets[node.lineno - 1]):
        t = m.group()
        if t in "([{":
            depth += 1
        elif t in ")]}":
            depth -= 1
        elif t == "lambda":
            lambdas += depth == 0
        elif t == ":" and depth == 0:
            if not lambdas:
                return text[begin : m.end()]
            lambdas -= 1
    return ""


def line_offsets(text: str) -> list[int]:
    out, at = [0], text.find("\n")
    while at >= 0:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def inner_blocks(node: ast.stmt) -> list[list[ast.stmt]]:
    """Suites of a compound statement, in source order; definitions are no compound statements here."""
    if isinstance(node, ast.If | ast.For | ast.AsyncFor | ast.While):
        return [node.body, node.orelse]
    if isinstance(node, ast.With | ast.AsyncWith):
        return [node.body]
    if isinstance(node, ast.Try | ast.TryStar):
        return [node.body, *(h.body for h in node.handlers), node.orelse, node.finalbody]
    if isinstance(node, ast.Match):
        return [c.body for c in node.cases]
    return []


@dataclass
class Symbol:
    id: int
    kind: str
    name: str
    qualified_name: str
    parent: int | None
    start_line: int
    end_line: int
    signature: str = ""
    docstring: str = ""


def symbols(parsed: Parsed, module: str) -> tuple[list[Symbol], dict[ast.stmt, Symbol]]:
    """The module, every class, function and method, and bare names assigned at module or class level, parents first.

    Names are lexical paths; inside a function ``<locals>`` is put between. Conditional and guarded definitions count.
    """
    text, offsets = parsed.text, line_offsets(parsed.text)
    out = [Symbol(1, "module", module, module, None, 1, text.count("\n") + 1, "", docstring(parsed.body))]
    of: dict[ast.stmt, Symbol] = {}

    def add(kind: str, name: str, prefix: str, parent: int, node: ast.stmt, **more: str) -> Symbol:
        s = Symbol(len(out) + 1, kind, name, f"{prefix}.{name}" if prefix else name, parent, first_line(node), node.end_lineno, **more)
        out.append(s)
        return s

    def walk(body: list[ast.stmt], prefix: str, parent: int, where: str) -> None:
        for n in body:
            if isinstance(n, DEFINITIONS):
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if where == "class" else "function"
                s = of[n] = add(kind, n.name, prefix, parent, n, signature=header(text, offsets, n), docstring=docstring(n.body))
                if kind == "class":
                    walk(n.body, s.qualified_name, s.id, "class")
                else:
                    walk(n.body, s.qualified_name + ".<locals>", s.id, "function")
            elif isinstance(n, ast.Assign | ast.AnnAssign):
                target = n.targets[0] if isinstance(n, ast.Assign) else n.target
                if isinstance(target, ast.Name) and where != "function":
                    add("variable", target.id, prefix, parent, n)
            else:
                for b in inner_blocks(n):
                    walk(b, prefix, parent, where)

    walk(parsed.body, module, 1, "module")
    return out, of


# -- cut lines and imports for chunks -----------------------------------------------------------------------------------
def _comments(text: str) -> list[int]:
    """Lines that hold a comment."""
    out = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                out.append(t.start[0])
    except (tokenize.TokenError, SyntaxError):
        pass
    return out


def cut_lines(parsed: Parsed) -> dict[int, int]:
    """Lines before which a statement of a block begins (with the comments right above it), and the block's depth.

    The first statement of a suite stays with its header. A statement that shares a line with the one before can't be
    cut off.
    """
    commented = set(_comments(parsed.text))
    cuts: dict[int, int] = {}

    def block(body: list[ast.stmt], depth: int, before: int) -> None:
        for n in body:
            start = cut = first_line(n)
            while cut - 1 in commented:
                cut -= 1
            if cut > before and cut > 1:
                cuts.setdefault(cut, depth)
            before = n.end_lineno
            for b in [n.body] if isinstance(n, DEFINITIONS) else inner_blocks(n):
                if b:
                    block(b, depth + 1, first_line(b[0]))
            del start

    block(parsed.body, 0, 0)
    return cuts


def import_lines(parsed: Parsed) -> list[tuple[str, list[str]]]:
    """Imports outside functions: their source with single spaces, and the names they bind."""
    out = []

    def walk(body: list[ast.stmt]) -> None:
        for n in body:
            if isinstance(n, ast.Import):
                names = [a.asname or a.name.split(".")[0] for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                names = [a.asname or a.name for a in n.names if a.name != "*"]
            else:
                for b in [n.body] if isinstance(n, ast.ClassDef) else inner_blocks(n):
                    walk(b)
                continue
            source = ast.get_source_segment(parsed.text, n) or ""
            out.append((" ".join(source.split()), names))

    walk(parsed.body)
    return out


# -- scopes, bases and calls for resolution -----------------------------------------------------------------------------
def dotted(node: ast.AST | None) -> list[str] | None:
    """``a.b.c`` as its parts; null for anything else."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.insert(0, node.attr)
        node = node.value
    return [node.id, *names] if isinstance(node, ast.Name) else None


def _made_by(node: ast.AST) -> tuple[str, list[str]] | None:
    """The name an assignment gives to the result of a call, and what is called."""
    match node:
        case ast.Assign(targets=[*_, ast.Name(id=name)], value=ast.Call(func=f)) | ast.AnnAssign(target=ast.Name(id=name), value=ast.Call(func=f)):
            called = dotted(f)
            return (name, called) if called and called[0] != name else None
    return None


def _bound_name(node: ast.AST) -> str | None:
    """The name that this very node binds in its scope."""
    match node:
        case ast.Name(id=name, ctx=ast.Store()) | ast.arg(arg=name) | ast.ExceptHandler(name=name):
            return name
        case ast.MatchAs(name=name, pattern=ast.pattern()):
            return name
        case ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name) | ast.ClassDef(name=name):
            return name
    return None


def _call_row(scope: int, f: ast.expr) -> dict:
    """A call's form: super, a dotted chain, an attribute of some expression, or dynamic."""
    match f:
        case ast.Attribute(value=ast.Call(func=ast.Name(id="super")), attr=name):
            return {"scope": scope, "form": "super", "parts": [name]}
        case ast.Attribute(attr=name):
            chain = dotted(f)
            return {"scope": scope, "form": "chain" if chain else "attribute", "parts": chain or [name]}
        case ast.Name(id=name):
            return {"scope": scope, "form": "chain", "parts": [name]}
    return {"scope": scope, "form": "dynamic", "parts": []}


def references(parsed: Parsed, of: dict[ast.stmt, Symbol]) -> dict[str, list[dict]]:
    """What resolution needs of a file, as rows: imports, scopes, events that bind a name, class bases, and calls.

    A scope has its symbol, the scopes around it from itself outwards, and, in methods and what they hold, the class and
    the name of the instance. An event names the call that made the value, if there is one. Nodes are visited in source
    order from a stack, so nesting is not bounded by the interpreter's own.
    """
    out: dict[str, list[dict]] = {"imports": [], "scopes": [{"id": 0, "form": "module", "symbol": 1, "up": [0], "cls": None, "me": None}], "binds": [], "bases": [], "calls": []}

    def enter(form: str, node: ast.stmt, scope: int, cls: int | None, me: str | None) -> int:
        number = len(out["scopes"])
        out["scopes"].append({"id": number, "form": form, "symbol": of[node].id, "up": [number, *out["scopes"][scope]["up"]], "cls": cls, "me": me})
        return number

    todo: list[tuple[ast.AST, int, bool]] = [(s, 0, True) for s in reversed(parsed.body)]  # node, scope, whether names are bound there
    while todo:
        n, scope, binds = todo.pop()
        made = _made_by(n)
        if binds and (name := _bound_name(n)):
            out["binds"].append({"scope": scope, "name": name, "ctor": None})
        inside: list[tuple[ast.AST, int, bool]] = []
        if isinstance(n, ast.Import):
            out["imports"] += [{"form": "plain", "level": 0, "written": a.name, "alias": a.asname or "", "names": [], "star": False} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            names = [{"name": a.name, "alias": a.asname or ""} for a in n.names if a.name != "*"]
            out["imports"].append({"form": "from", "level": n.level, "written": n.module or "", "alias": "", "names": names, "star": len(names) < len(n.names)})
        elif isinstance(n, ast.ClassDef):
            plain = [b.value if isinstance(b, ast.Subscript) else b for b in n.bases]
            out["bases"] += [{"symbol": of[n].id, "scope": scope, "parts": dotted(b)} for b in plain]
            body = enter("class", n, scope, None, None)
            inside = [(x, scope, False) for x in [*n.decorator_list, *n.bases, *n.keywords]] + [(x, body, False) for x in n.body]
        elif isinstance(n, FUNCTIONS):
            around = out["scopes"][scope]
            parameters = [x for x in ast.iter_child_nodes(n.args) if isinstance(x, ast.arg)]
            first = [p.arg for p in [*n.args.posonlyargs, *n.args.args, *([n.args.vararg] if n.args.vararg else []), *n.args.kwonlyargs, *([n.args.kwarg] if n.args.kwarg else [])]][:1]
            own = (around["symbol"], "".join(first)) if of[n].kind == "method" else (around["cls"], around["me"])
            body = enter("function", n, scope, *own)
            out["binds"] += [{"scope": body, "name": p.arg, "ctor": None} for p in parameters]
            inside = [(x, scope, False) for x in [*n.decorator_list, n.args, *([n.returns] if n.returns else [])]] + [(x, body, True) for x in n.body]
        else:
            if isinstance(n, ast.Call):
                out["calls"].append(_call_row(scope, n.func))
            binds = binds and not isinstance(n, ast.Lambda)
            inside = [(x, scope, binds) for x in ast.iter_child_nodes(n)]
        if made and binds:
            out["binds"].append({"scope": scope, "name": made[0], "ctor": made[1]})
        todo += reversed(inside)
    return out
