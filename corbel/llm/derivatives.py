"""Parsing with derivatives: grammars as shared expressions, memoised derivatives, compaction.

The derivative of a language by a token is what may follow that token. Expressions are interned, so each derivative of
each expression is computed once for a process and found again afterwards; on ordinary files nearly every step is one
look-up. The expression left after a prefix is empty exactly if no continuation of the prefix is valid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Node:
    __slots__ = ("a", "b", "by", "key", "kind", "null")

    def __init__(self, kind: str, a=None, b=None) -> None:
        self.kind, self.a, self.b, self.by, self.null = kind, a, b, {}, None


class Language:
    """Expressions over integer tokens. Kinds: empty, eps, tok (set), cat, alt (nodes), star, ref (by name)."""

    def __init__(self, limit: int = 400_000) -> None:
        self.empty, self.eps = Node("empty"), Node("eps")
        self.limit, self.tokens, self.rules, self._seen = limit, {}, {}, {}
        self._refs: dict[str, Node] = {}

    # -- expressions ---------------------------------------------------------------------------------------------
    def code(self, token: str) -> int:
        return self.tokens.setdefault(token, len(self.tokens))

    def tok(self, *tokens: str) -> Node:
        return self._intern("tok", frozenset(self.code(t) for t in tokens))

    def ref(self, name: str) -> Node:
        if name not in self._refs:
            self._refs[name] = Node("ref", name)
        return self._refs[name]

    def cat(self, *parts: Node) -> Node:
        out = self.eps
        for p in reversed(parts):
            out = self._cat(p, out)
        return out

    def _cat(self, a: Node, b: Node) -> Node:
        if a is self.empty or b is self.empty:
            return self.empty
        if a is self.eps:
            return b
        if a.kind == "cat":
            return self._cat(a.a, self._cat(a.b, b))
        return a if b is self.eps else self._intern("cat", a, b)

    def alt(self, *parts: Node) -> Node:
        """Union; members with the same first part are joined, so parallel readings of a prefix share what follows."""
        flat: dict[Node, None] = {}
        for p in parts:
            if p.kind == "alt":
                flat.update(dict.fromkeys(p.a))
            elif p is not self.empty:
                flat[p] = None
        if len(flat) > 1:
            heads: dict[Node, list[Node]] = {}
            for p in flat:
                head, rest = (p.a, p.b) if p.kind == "cat" else (p, self.eps)
                heads.setdefault(head, []).append(rest)
            if len(heads) < len(flat):
                return self.alt(*(self._cat(h, self.alt(*r)) for h, r in heads.items()))
        if len(flat) < 2:
            return next(iter(flat), self.empty)
        return self._intern("alt", frozenset(flat))

    def star(self, a: Node) -> Node:
        return self.eps if a in (self.empty, self.eps) else a if a.kind == "star" else self._intern("star", a)

    def opt(self, *parts: Node) -> Node:
        return self.alt(self.eps, self.cat(*parts))

    def plus(self, a: Node) -> Node:
        return self.cat(a, self.star(a))

    def listed(self, a: Node, comma: Node, trailing: bool = False) -> Node:
        out = self.cat(a, self.star(self.cat(comma, a)))
        return self.cat(out, self.opt(comma)) if trailing else out

    def _intern(self, kind: str, a, b=None) -> Node:
        key = (kind, a, b)
        node = self._seen.get(key)
        if node is None:
            node = self._seen[key] = Node(kind, a, b)
        return node

    # -- derivatives ---------------------------------------------------------------------------------------------
    def nullable(self, n: Node) -> bool:
        if n.null is None:
            if n.kind == "ref":
                n.null = False  # least solution for recursive rules
                n.null = self.nullable(self.rules[n.a])
            else:
                n.null = n.kind in ("eps", "star") or n.kind == "cat" and self.nullable(n.a) and self.nullable(n.b) or n.kind == "alt" and any(map(self.nullable, n.a))
        return n.null

    def derive(self, n: Node, token: int) -> Node:
        out = n.by.get(token)
        if out is None:
            if n.kind == "tok":
                out = self.eps if token in n.a else self.empty
            elif n.kind == "cat":
                out = self._cat(self.derive(n.a, token), n.b)
                if self.nullable(n.a):
                    out = self.alt(out, self.derive(n.b, token))
            elif n.kind == "alt":
                out = self.alt(*[self.derive(x, token) for x in n.a])
            elif n.kind == "star":
                out = self._cat(self.derive(n.a, token), n)
            elif n.kind == "ref":
                out = self.derive(self.rules[n.a], token)
            else:
                out = self.empty
            n.by[token] = out
        return out

    def parse(self, start: Node, tokens: Iterable[int]) -> tuple[int, bool]:
        """``(number of tokens read, complete)``. An incomplete parse failed at the next token, or at the end of input
        (all tokens read, but what is left isn't nullable)."""
        if len(self._seen) > self.limit:
            self.forget()
        state, n, empty = start, 0, self.empty
        for t in tokens:
            after = state.by.get(t)
            if after is None:
                after = self.derive(state, t)
            if after is empty:
                return n, False
            state = after
            n += 1
        return n, self.nullable(state)

    def forget(self) -> None:
        """Drop all derivatives but the grammar's own expressions."""
        keep: dict = {}
        todo = list(self.rules.values())
        known = set()
        while todo:
            n = todo.pop()
            if n in known:
                continue
            known.add(n)
            n.by = {}
            if n.kind in ("tok", "cat", "alt", "star"):
                keep[(n.kind, n.a, n.b)] = n
            todo += n.a if n.kind == "alt" else [x for x in (n.a, n.b) if isinstance(x, Node)]
        for n in self._refs.values():
            n.by = {}
        self._seen = keep


# Hard keywords and operators of Python 3.13.
_KEYWORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
_OPERATORS = "( ) [ ] { } , : ; . ... = -> := @ + - * / // % ** << >> & | ^ ~ < > <= >= == != += -= *= /= //= %= @= &= |= ^= >>= <<= **= !".split()
# Names with a meaning of their own in some places: soft keywords, and the conversions of f-strings.
_SOFT = "match case type _ s r a".split()


def python_language() -> tuple[Language, Node]:
    """Python 3.13 over keywords, operators, soft keywords and classes of tokens such as <NAME>, <STR> or <INDENT>."""
    g = Language()
    for t in [*_KEYWORDS, *_OPERATORS, *_SOFT]:
        g.code(t)
    t, r, cat, alt, opt, star, plus = g.tok, g.ref, g.cat, g.alt, g.opt, g.star, g.plus
    comma, name = t(","), t("<NAME>", *_SOFT)
    lst = lambda x, trailing=True: g.listed(x, comma, trailing)
    R = g.rules

    # Expressions. Precedence does not matter for validity, so chains of operators are flat.
    expression, named, star_exprs = r("expression"), r("named"), r("star_exprs")
    R["arith"] = g.listed(cat(star(t("+", "-", "~")), opt(t("await")), r("primary")), t("+", "-", "*", "/", "//", "%", "@", "**", "<<", ">>", "&", "|", "^"))
    arith = r("arith")
    compare = alt(t("==", "!=", "<", "<=", ">", ">=", "in"), cat(t("not"), t("in")), cat(t("is"), opt(t("not"))))
    R["disjunction"] = g.listed(cat(star(t("not")), g.listed(arith, compare)), t("and", "or"))
    disjunction = r("disjunction")
    R["expression"] = alt(cat(disjunction, opt(t("if"), disjunction, t("else"), expression)), cat(t("lambda"), r("lambda_params"), t(":"), expression))
    R["named"] = alt(cat(name, t(":="), expression), expression)
    R["star_expr"] = alt(cat(t("*"), arith), expression)
    R["star_exprs"] = lst(r("star_expr"))
    R["star_named"] = alt(cat(t("*"), arith), named)
    R["yield"] = cat(t("yield"), alt(cat(t("from"), expression), opt(star_exprs)))
    value = alt(r("yield"), star_exprs)
    R["comp"] = plus(cat(opt(t("async")), t("for"), r("targets"), t("in"), disjunction, star(cat(t("if"), disjunction))))
    comp = r("comp")
    piece = alt(cat(opt(expression), t(":"), opt(expression), opt(t(":"), opt(expression))), named)
    R["slices"] = lst(alt(piece, cat(t("*"), arith)))

    # Arguments: positional, then keywords, then double stars.
    pos, star_arg = named, cat(t("*"), expression)
    kw, dstar = cat(name, t("="), expression), cat(t("**"), expression)
    R["args1"] = opt(comma, alt(g.eps, cat(alt(pos, star_arg), r("args1")), cat(kw, r("args2")), cat(dstar, r("args3"))))
    R["args2"] = opt(comma, alt(g.eps, cat(alt(kw, star_arg), r("args2")), cat(dstar, r("args3"))))
    R["args3"] = opt(comma, alt(g.eps, cat(alt(kw, dstar), r("args3"))))
    R["args"] = alt(g.eps, cat(alt(pos, star_arg), r("args1")), cat(kw, r("args2")), cat(dstar, r("args3")), cat(named, comp))
    call = cat(t("("), r("args"), t(")"))
    # Bases of a class are arguments, but a bare comprehension is not one.
    bases = cat(t("("), alt(g.eps, cat(alt(pos, star_arg), r("args1")), cat(kw, r("args2")), cat(dstar, r("args3"))), t(")"))
    index = cat(t("["), r("slices"), t("]"))
    R["trailer"] = alt(cat(t("."), name), call, index)

    # Atoms.
    field = cat(t("{"), value, opt(t("=")), opt(t("!"), t("s", "r", "a")), opt(t(":"), star(alt(t("<FMID>"), r("field")))), t("}"))
    R["field"] = field
    fstring = cat(t("<FSTART>"), star(alt(t("<FMID>"), r("field"))), t("<FEND>"))
    strings = alt(plus(alt(t("<STR>"), fstring)), plus(t("<BYTES>")))
    elements = lst(r("star_named"))
    tuple_ = opt(r("star_named"), comma, opt(elements))
    paren = cat(t("("), alt(tuple_, r("yield"), named, cat(named, comp)), t(")"))
    list_ = cat(t("["), alt(opt(elements), cat(named, comp)), t("]"))
    pair = cat(expression, t(":"), expression)
    braces = cat(t("{"), alt(g.eps, lst(alt(pair, cat(t("**"), arith))), cat(pair, comp), elements, cat(named, comp)), t("}"))
    R["atom"] = alt(name, t("True", "False", "None", "<NUMBER>", "<IMAG>", "..."), strings, paren, list_, braces)
    R["primary"] = cat(r("atom"), star(r("trailer")))

    # Targets.
    place = cat(r("atom"), star(r("trailer")), alt(cat(t("."), name), index))
    R["target"] = alt(name, place, cat(t("("), opt(r("targets_in")), t(")")), cat(t("["), opt(r("targets")), t("]")))
    R["star_target"] = cat(opt(t("*")), r("target"))
    R["targets"] = lst(r("star_target"))
    R["targets_in"] = alt(r("target"), cat(r("star_target"), comma, opt(r("targets"))))
    R["single"] = alt(name, place, cat(t("("), r("single"), t(")")))
    R["del_target"] = alt(name, place, cat(t("("), opt(lst(r("del_target"))), t(")")), cat(t("["), opt(lst(r("del_target"))), t("]")))

    # Parameters: defaults once begun go on, one '/', then stars.
    def params(prefix: str, param: Node, star_param: Node) -> Node:
        default, kwonly = cat(param, t("="), expression), opt(t("="), expression)
        tail = cat(t("**"), param, opt(comma))
        R[f"{prefix}_kw"] = opt(comma, alt(g.eps, cat(param, kwonly, r(f"{prefix}_kw")), tail))
        stars = alt(cat(t("*"), star_param, r(f"{prefix}_kw")), cat(t("*"), comma, param, kwonly, r(f"{prefix}_kw")), tail)
        for d in (0, 1):
            for s in (0, 1):
                more = [g.eps, cat(default, r(f"{prefix}_1{s}")), stars]
                more += [] if d else [cat(param, r(f"{prefix}_0{s}"))]
                more += [] if s else [cat(t("/"), r(f"{prefix}_{d}1"))]
                R[f"{prefix}_{d}{s}"] = opt(comma, alt(*more))
        return alt(g.eps, cat(param, r(f"{prefix}_00")), cat(default, r(f"{prefix}_10")), stars)

    R["def_params"] = params("def", cat(name, opt(t(":"), expression)), cat(name, opt(t(":"), r("star_expr"))))
    R["lambda_params"] = params("lambda", name, name)
    bound = opt(t("="), expression)
    type_params = opt(t("["), lst(alt(cat(name, opt(t(":"), expression), bound), cat(t("*"), name, opt(t("="), r("star_expr"))), cat(t("**"), name, bound))), t("]"))

    # Simple statements.
    augmented = t("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**=")
    annotated = cat(r("single"), t(":"), expression, opt(t("="), value))
    dotted = g.listed(name, t("."))
    as_name = opt(t("as"), name)
    imported = alt(t("*"), lst(cat(name, as_name), False), cat(t("("), lst(cat(name, as_name)), t(")")))
    dots = t(".", "...")
    R["simple"] = alt(
        star_exprs,
        r("yield"),
        cat(plus(cat(r("targets"), t("="))), value),
        annotated,
        cat(r("single"), augmented, value),
        t("pass", "break", "continue"),
        cat(t("return"), opt(star_exprs)),
        cat(t("raise"), opt(expression, opt(t("from"), expression))),
        cat(t("global", "nonlocal"), lst(name, False)),
        cat(t("del"), lst(r("del_target"))),
        cat(t("assert"), expression, opt(comma, expression)),
        cat(t("import"), lst(cat(dotted, as_name), False)),
        cat(t("from"), alt(cat(star(dots), dotted), plus(dots)), t("import"), imported),
        cat(t("type"), name, type_params, t("="), expression),
    )
    R["simples"] = cat(g.listed(r("simple"), t(";")), opt(t(";")), t("<NEWLINE>"))
    R["block"] = alt(cat(t("<NEWLINE>"), t("<INDENT>"), plus(r("statement")), t("<DEDENT>")), r("simples"))
    block = cat(t(":"), r("block"))

    # Patterns.
    signed = cat(opt(t("-")), t("<NUMBER>", "<IMAG>"))
    complex_ = cat(opt(t("-")), t("<NUMBER>"), t("+", "-"), t("<IMAG>"))
    literal = alt(signed, complex_, plus(t("<STR>")), plus(t("<BYTES>")), t("None", "True", "False"))
    attr = g.listed(name, t("."))
    values = alt(literal, cat(name, plus(cat(t("."), name))))
    capture = t("<NAME>", *[x for x in _SOFT if x != "_"])
    star_pattern = cat(t("*"), name)
    seq = alt(star_pattern, r("pattern"))
    item = cat(values, t(":"), r("pattern"))
    rest = cat(t("**"), capture)
    mapping = cat(t("{"), alt(g.eps, cat(rest, opt(comma)), cat(lst(item, False), opt(comma, opt(rest, opt(comma))))), t("}"))
    keyword = cat(name, t("="), r("pattern"))
    in_class = alt(g.eps, lst(r("pattern")), lst(keyword), cat(lst(r("pattern"), False), comma, lst(keyword)))
    R["closed"] = alt(values, name, cat(t("("), alt(g.eps, r("pattern"), cat(seq, comma, opt(lst(seq)))), t(")")), cat(t("["), opt(lst(seq)), t("]")), mapping, cat(attr, t("("), in_class, t(")")))
    R["pattern"] = cat(g.listed(r("closed"), t("|")), opt(t("as"), capture))
    case = cat(t("case"), alt(r("pattern"), cat(seq, comma, opt(lst(seq)))), opt(t("if"), named), block)
    match = cat(t("match"), alt(named, cat(r("star_named"), comma, opt(elements))), t(":"), t("<NEWLINE>"), t("<INDENT>"), plus(case), t("<DEDENT>"))

    # Compound statements.
    otherwise = opt(t("else"), block)
    with_item = cat(expression, opt(t("as"), r("star_target")))
    with_ = cat(t("with"), alt(lst(with_item, False), cat(t("("), lst(with_item), t(")"))), block)
    for_ = cat(t("for"), r("targets"), t("in"), star_exprs, block, otherwise)
    handler = cat(t("except"), opt(expression, as_name), block)
    group = cat(t("except"), t("*"), expression, as_name, block)
    finally_ = cat(t("finally"), block)
    try_ = cat(t("try"), block, alt(finally_, cat(alt(plus(handler), plus(group)), otherwise, opt(finally_))))
    def_ = cat(t("def"), name, type_params, t("("), r("def_params"), t(")"), opt(t("->"), expression), block)
    class_ = cat(t("class"), name, type_params, opt(bases), block)
    decorated = cat(plus(cat(t("@"), named, t("<NEWLINE>"))), alt(class_, cat(opt(t("async")), def_)))
    R["statement"] = alt(
        r("simples"),
        cat(t("if"), named, block, star(cat(t("elif"), named, block)), otherwise),
        cat(t("while"), named, block, otherwise),
        cat(opt(t("async")), alt(for_, with_, def_)),
        try_,
        class_,
        decorated,
        match,
    )
    R["file"] = star(r("statement"))
    return g, R["file"]


def json_language() -> tuple[Language, Node]:
    g = Language()
    t, r = g.tok, g.ref
    pair = g.cat(t("STRING"), t(":"), r("value"))
    g.rules["value"] = g.alt(t("STRING", "ATOM"), g.cat(t("["), g.opt(g.listed(r("value"), t(","))), t("]")), g.cat(t("{"), g.opt(g.listed(pair, t(","))), t("}")))
    return g, g.rules["value"]


def toml_language() -> tuple[Language, Node]:
    """TOML 1.0 over KEY, STR (a quoted key or a string), MULTI, ATOM, NL and marks. ``[[`` and ``]]`` are single tokens."""
    g = Language()
    t, r = g.tok, g.ref
    key = g.listed(t("KEY", "STR"), t("."))
    pair = g.cat(key, t("="), r("value"))
    blank = g.star(t("NL"))
    element = g.cat(r("value"), blank)
    array = g.cat(t("["), blank, g.opt(g.listed(element, g.cat(t(","), blank)), g.opt(t(","), blank)), t("]"))
    g.rules["value"] = g.alt(t("STR", "MULTI", "ATOM"), array, g.cat(t("{"), g.opt(g.listed(pair, t(","))), t("}")))
    line = g.opt(g.alt(pair, g.cat(t("[t"), key, t("]t")), g.cat(t("[["), key, t("]]"))))
    g.rules["file"] = g.listed(line, t("NL"))
    return g, g.rules["file"]


_languages: dict[str, tuple[Language, Node]] = {}


def language(name: str) -> tuple[Language, Node]:
    """The process's grammar with all derivatives found so far."""
    if name not in _languages:
        makers: dict[str, Callable[[], tuple[Language, Node]]] = {"python": python_language, "json": json_language, "toml": toml_language}
        _languages[name] = makers[name]()
    return _languages[name]
