"""Problem 5: functions paired with their documentation, from lexed tokens as rows.

Sources are lexed by one regular expression into the few tokens that decide about structure, exploded into rows, and
delimited by window functions inside each file: cumulative bracket depth separates statements (gaps and islands),
decorators form islands with their function, falling indentation ends a body, and lag and lead attach the comment above
and the string below a header.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corbel.operators.python_source import decode
from corbel.session import spread

_PREFIX = r"[rRuUbBfF]{0,2}+"
_LEXER = "|".join(
    [
        r"#[^\n]*+",  # comment
        _PREFIX + r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""',
        _PREFIX + r"'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''",
        _PREFIX + r'"(?:[^"\\\n]++|\\[\s\S])*+"',
        _PREFIX + r"'(?:[^'\\\n]++|\\[\s\S])*+'",
        r"[(\[{][^()\[\]{}\n\"'#]*+[)\]}]",  # innermost brackets on a line: balanced, left out below where they can be
        r"\\\n",  # line joined by a backslash
        # A line's indentation and what it begins with: a function header, a decorator, other code, or nothing.
        r"\n[ \t\f]*+(?:(?:async[ \t]++)?+def\b|@|(?![rRuUbBfF]{0,2}[\"'])[^\s#()\[\]{}\"'\\])?+",
        r"[()\[\]{}]",
        r":[ \t]*+(?=[rRuU]?[\"'])",  # a colon before a string: a body on the header's line
        r"(?<=[\"'])[ \t]*+(?![rRuUbBfF]{0,2}[\"'])[^\s#()\[\]{}\"'\\;]",  # code behind a string; a semicolon ends it
    ]
)


def _coding(content: Column) -> Column:
    """Lower-case encoding that a coding comment in the first two lines names; '' without one."""
    head = F.substring_index(F.decode(content, "ISO-8859-1"), "\n", 2)
    return F.lower(F.regexp_extract(head, r"\A(?:\xEF\xBB\xBF)?(?:[ \t\f]*(?:#[^\n\r]*)?\r?\n)?[ \t\f]*#[^\n\r]*?coding[:=][ \t]*([-\w.]+)", 1))


_LATIN, _UTF8 = r"\A(?:latin[-_]?1|iso[-_]?8859[-_]1|l1|cp819)(?:-|\z)", r"\A(?:|utf[-_]?8(?:[-_].*)?)\z"


def source_text(content: Column) -> Column:
    """Text of Python sources in UTF-8 or Latin-1 by their coding comment, without mark, line ends as line feeds; null if invalid."""
    text = F.when(_coding(content).rlike(_LATIN), F.decode(content, "ISO-8859-1")).otherwise(F.try_validate_utf8(content.cast("string")))
    return F.regexp_replace(F.regexp_replace(text, "\\A\ufeff", ""), r"\r\n?", "\n")


def sources_of(files: DataFrame) -> DataFrame:
    """``(file_id, text)`` of Python files. The common encodings are read in the JVM, any other that the language knows in Python."""
    python = F.lower(F.coalesce(F.col("path"), F.lit(""))).rlike(r"\.pyi?\z")
    rows = files.where(python & F.col("content").isNotNull()).select(F.col("id").cast("bigint").alias("file_id"), F.col("content").cast("binary").alias("content"))
    common = _coding(F.col("content")).rlike(f"{_LATIN}|{_UTF8}")

    def read(batches):
        for b in batches:
            texts = [decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else t.removeprefix("\ufeff") for t in texts], pa.string())], names=["file_id", "text"])

    return rows.where(common).select("file_id", source_text(F.col("content")).alias("text")).unionByName(rows.where(~common).mapInArrow(read, "file_id bigint, text string"))


def columns_of(blank: Column) -> Column:
    """Columns of leading white space as the language counts them: a tab goes on to the next multiple of eight, a form
    feed begins anew."""
    rest = F.regexp_replace(blank, r"\A[\s\S]*\f", "")
    parts = F.split(rest, "\t")  # what stands before each tab, and what stands behind the last one
    tabbed = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.lit(0), lambda n, x: (F.floor((n + F.length(x)) / 8) * 8 + 8).cast("int"))
    return F.when(F.instr(blank, "\t") + F.instr(blank, "\f") > 0, tabbed + F.length(F.element_at(parts, -1))).otherwise(F.length(blank))


def _statements(sources: DataFrame) -> DataFrame:
    """``(file_id, stmt, head, indent, first, last, n_code, docs, inline, notes)``: one row for each statement line."""
    raw = sources.select("file_id", F.posexplode(F.regexp_extract_all(F.concat(F.lit("\n"), "text"), F.lit(_LEXER), F.lit(0))).alias("pos", "tok"))
    c1, size = F.substring("tok", 1, 1), F.length("tok")
    quoted = F.col("tok").endswith('"') | F.col("tok").endswith("'")
    kind = (
        F.when(c1 == "\n", "n")
        .when(c1 == "#", "c")
        .when(c1.isin("(", "[", "{"), F.when(size == 1, "o").otherwise("x"))
        .when(c1.isin(")", "]", "}"), "d")
        .when(c1 == "\\", "k")
        .when(c1 == ":", "q")
        .when(quoted, F.when(F.col("tok").rlike(r"\A[rRuU]?[\"']"), "s").otherwise("x"))
        .otherwise("x")
    )
    t = raw.select("file_id", "pos", "tok", kind.alias("kind"))
    w = Window.partitionBy("file_id").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.when(F.col("kind").isin("n", "k"), 1).when(F.col("kind").isin("s", "x"), F.length("tok") - F.length(F.replace("tok", F.lit("\n"), F.lit("")))).otherwise(0)
    t = t.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("kind") == "o", 1).when(F.col("kind") == "d", -1).otherwise(0)).over(before), F.lit(0)).alias("depth"),
        F.sum(breaks).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("line"),
        F.lag("kind").over(w).alias("prev"),
        F.lead("kind").over(w).alias("next"),
    )
    last = F.substring("tok", -1, 1)
    begins = F.when(F.col("tok").endswith("def"), "def").when(last == "@", "dec").when(last.rlike(r"[\s]"), "bare").otherwise("code")
    t = t.withColumn("head", F.when((F.col("kind") == "n") & (F.col("depth") <= 0), begins))
    # Blank lines and lines with a comment only begin no statement.
    t = t.withColumn("head", F.when((F.col("head") == "bare") & (F.col("next").isNull() | F.col("next").isin("n", "c")), "gap").otherwise(F.col("head")))
    t = t.withColumn("stmt", F.sum(F.when(F.col("head").isin("def", "dec", "bare", "code"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    note = (F.col("kind") == "c") & (F.col("prev") == "n") & (F.col("depth") <= 0)
    code = F.col("kind").isin("x", "o", "d", "q") | F.col("head").isin("def", "dec", "code") | ((F.col("kind") == "n") & (F.col("depth") > 0))
    starts = F.col("head").isin("def", "dec", "bare", "code")
    indent = columns_of(F.regexp_extract("tok", r"\A\n([ \t\f]*)", 1))
    # A string counts as the documentation's part only behind a line's begin, another string or a joined line.
    doc = F.when((F.col("kind") == "s") & F.col("prev").isin("n", "s", "k"), F.struct("pos", "tok"))
    inline = F.when((F.col("kind") == "s") & (F.col("prev") == "q") & (F.col("depth") <= 0), F.struct("pos", "tok"))
    return (
        t.where("stmt > 0")
        .groupBy("file_id", "stmt")
        .agg(
            F.min(F.when(starts, F.struct("pos", "head", indent.alias("indent"), "line"))).alias("h"),
            F.max(F.when(~(note | (F.col("head") == "gap").eqNullSafe(True)), F.col("line"))).alias("last"),
            F.sum(F.when(code, 1).otherwise(0)).alias("n_code"),
            F.array_sort(F.collect_list(doc)).alias("docs"),
            F.array_sort(F.collect_list(inline)).alias("inline"),
            F.array_sort(F.collect_list(F.when(note, F.struct("line", "tok")))).alias("notes"),
        )
        .select("file_id", "stmt", "h.head", "h.indent", F.col("h.line").alias("first"), "last", "n_code", "docs", "inline", "notes")
    )


def _value(literal: Column) -> Column:
    """The text of a string literal; escapes that matter for reading it are resolved."""
    raw = F.lower(F.substring(literal, 1, 1)) == "r"
    bare = F.regexp_replace(literal, r"\A[rRuU]?", "")
    quotes = F.when(bare.startswith('"""') | bare.startswith("'''"), 3).otherwise(1)
    inner = F.substring(bare, quotes + 1, F.length(bare) - 2 * quotes)
    # Backslash pairs are set aside first, so that they don't take part in other escapes.
    out = F.regexp_replace(inner, r"\\\\", "\x00")
    for pattern, by in [(r"\\\n", ""), (r"\\n", "\n"), (r"\\t", "\t"), (r"\\r", "\n"), (r"\\([\"'])", "$1")]:
        out = F.regexp_replace(out, pattern, by)
    return F.when(raw, inner).otherwise(F.regexp_replace(out, "\x00", r"\\\\"))


def clean_documentation(text: Column) -> Column:
    """First line stripped, common indentation of the others removed, blank ends dropped."""
    lines = F.split(F.replace(text, F.lit("\t"), F.lit("        ")), "\n")
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    margin = F.coalesce(F.array_min(F.transform(F.filter(rest, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.ltrim(x)))), F.lit(0))
    body = F.transform(rest, lambda x: F.rtrim(F.substring(x, margin + 1, F.length(x))))
    whole = F.array_join(F.concat(F.array(F.trim(F.get(lines, F.lit(0)))), body), "\n")
    return F.regexp_replace(whole, r"\A\s+|\s+\z", "")


def functions_of(sources: DataFrame, ends: bool = True) -> DataFrame:
    """``(file_id, start_line, def_line, end_line, docstring, comment)`` of all functions in ``sources(file_id, text)``.

    ``start_line`` is that of the first decorator; ``docstring`` is null where the body opens with no plain string;
    ``comment`` holds the comment lines directly above. ``ends=False`` leaves ``end_line`` null and saves its windows.
    Everything is partitioned by file, so the text is shuffled once and nothing after it.
    """
    s = _statements(spread(sources.where(F.col("text").isNotNull() & F.col("file_id").isNotNull()), "file_id"))
    w = Window.partitionBy("file_id").orderBy("stmt")
    near = ["head", "indent", "n_code", "docs"]
    s = s.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in near], F.lag("head").over(w).alias("prev_head"), F.lag("notes").over(w).alias("above"), F.lag("last").over(w).alias("prev_last"), F.lag("indent").over(w).alias("prev_indent"))
    s = s.withColumn("island", F.sum(F.when(F.col("prev_head") == "dec", 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("file_id", "island").orderBy("stmt").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("start_line", F.first("first").over(island)).withColumn("above", F.first("above").over(island))
    below = (F.col("next_head") == "bare") & (F.col("next_n_code") == 0) & (F.size("next_docs") > 0) & (F.col("next_indent") > F.col("indent"))
    literals = F.when(below, F.col("next_docs")).when(F.size("inline") > 0, F.col("inline"))
    defs = s.where(F.col("head") == "def")
    text = F.array_join(F.transform(literals, lambda d: _value(d["tok"])), "")
    # The comment block must end right above the function.
    touching = F.filter("above", lambda n: n["line"] >= F.col("start_line") - F.size("above"))
    comment = F.when(F.size("above") > 0, F.when(F.element_at("above", -1)["line"] == F.col("start_line") - 1, F.array_join(F.transform(touching, lambda n: F.regexp_replace(n["tok"], r"\A#+[ \t]?", "")), "\n")))
    out = defs.select("file_id", "stmt", "indent", "start_line", F.col("first").alias("def_line"), "last", F.when(literals.isNotNull(), clean_documentation(text)).alias("docstring"), comment.alias("comment"))
    if not ends:
        return out.select("file_id", "start_line", "def_line", F.lit(None).cast("int").alias("end_line"), "docstring", "comment")
    closed = s.where(F.col("indent") <= F.col("prev_indent")).select("file_id", "stmt", F.explode(F.sequence("indent", "prev_indent")).alias("indent"), F.col("prev_last").alias("closed"))
    finish = s.groupBy("file_id").agg((F.max("stmt") + 1).alias("stmt"), F.max("last").alias("closed"))
    finish = finish.join(out.select("file_id", "indent").distinct(), "file_id").select("file_id", "stmt", "indent", "closed")
    both = out.select("*", F.lit(None).cast("bigint").alias("closed")).unionByName(closed.unionByName(finish), allowMissingColumns=True)
    back = Window.partitionBy("file_id", "indent").orderBy(F.col("stmt").desc()).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("end_line", F.last("closed", ignorenulls=True).over(back).cast("int"))
    return both.where(F.col("closed").isNull()).select("file_id", "start_line", "def_line", "end_line", "docstring", "comment")


# Words, in the corpus's languages, by which a remark speaks of documentation itself ...
_ABOUT = r"docs?|docstrings?|documentation|documented|describe|description|documentación|documentar|descripción|dokumentation|dokumentiert|beschreibung|documenter|placeholder|stub"
# ... and by which it says that it is missing, generated or still to come.
_MISSING = r"missing|later|add|added|write|written|todo|fixme|tbd|goes here|generated|edited|replace|yet|no|what|see|un|fehlt|fehlen|folgt|nachtragen|falta|faltan|añadirá|pendiente|sin|manque|reste|écrire|compléter|needed|needs|coming|soon"
# Remarks that are placeholders as a whole.
_WHOLE = r"todo|fixme|xxx|tbd|wip|none|null|n/?a|doc|docs|docstring|summary|description|beschreibung|descripción|placeholder|undocumented|not documented|no description|missing|see above|see below|write me|fill me in|à compléter|à écrire|à faire|pendiente|por hacer|offen|folgt|ausstehend|pass|test|stub|ditto|same as above|to do|to be done|to be documented|lorem ipsum"
# Marks of tools.
_TOOLS = r"noqa|type:\s*ignore|pylint:|pragma:|fmt:|mypy:|flake8|nosec|isort:|yapf:|ruff:|pyright:|black:"
# Headings of parameter lists, and words of types.
_HEADINGS = r"args|arguments|parameters|params|keyword args|keyword arguments|other parameters|returns?|yields?|raises|attributes|types?|paramètres|retourne|renvoie|parámetros|devuelve|parameter|argumente|rückgabe|examples?|notes?"
_TYPES = r"(?:int|integer|str|string|float|bool|boolean|dict|list|tuple|set|bytes|object|any|none|optional|callable|iterable|iterator|sequence|mapping|type|or|of|[A-Za-z_][\w.]*\[[^\]]*\])"
# Words that only frame a function's name.
_FRAME = "a an the this that these it its is are was be to of for in and or function functions method methods func fn def class routine procedure helper utility used use does do just simply implementation implements die der das den dem des diese dieser ist funktion methode le la les l un une ce cette est fonction méthode pour de du el los las una este esta es función método para wird".split()


def telling(doc: Column, name: Column) -> Column:
    """Whether a documentation says something: some sentence is left without placeholders and remarks about missing
    documentation, tool marks, bare parameter or type lists, and the function's own name in other dress. Null is false."""
    low = F.lower(F.coalesce(doc, F.lit("")))
    listing = low.rlike(rf"(?m)^\s*(?:{_HEADINGS})\s*:?\s*$")
    name_words = F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"(\p{Ll})(\p{Lu})", "$1_$2")), r"[^\p{L}\p{Nd}]+"), lambda x: x != "")
    frame = F.array(*[F.lit(x) for x in _FRAME])

    def own(word: Column) -> Column:
        """A word of the name, or one with the same stem."""
        stem = lambda n: F.substring(n, F.lit(1), F.greatest(F.length(n) - 1, F.lit(3)))
        return F.exists(name_words, lambda n: (word == n) | (word.startswith(stem(n)) & (F.length(n) >= 3) & (F.abs(F.length(word) - F.length(n)) <= 3)))

    def says(part: Column) -> Column:
        t = F.regexp_replace(part, r"\A[\s\p{P}\p{S}]+|[\s\p{P}\p{S}]+\z", "")
        words = F.filter(F.split(t, r"[^\p{L}\p{Nd}]+"), lambda x: x.rlike(r"\p{L}"))
        bare = part.rlike(rf"\A\s*(?:[:@](?:param|parameter|arg|argument|key|keyword|var|ivar|raises?|except|exception)\b[^:]*:?\s*|[:@](?:type|rtype|vartype)\b.*|[:@](?:returns?|yields?)\b\s*:?\s*|(?:{_HEADINGS})\s*:?\s*)\z")
        item = listing & part.rlike(rf"\A\s*[*\w.\[\], ]*\s*(?:\([^)]*\))?\s*:?\s*\z") & (F.size(words) <= 3) | part.rlike(rf"\A\s*[*]*[\w.]+\s*(?:\([^)]*\))?\s*:\s*(?:{_TYPES}[\s,|]*)+\z")
        remark = t.rlike(rf"\A(?:{_WHOLE})\z") | t.rlike(r"\A(?:todo|fixme|xxx|tbd|wip)\b") | part.rlike(rf"\A\W*(?:{_TOOLS})") | (t.rlike(rf"(?<!\p{{L}})(?:{_ABOUT})(?!\p{{L}})") & t.rlike(rf"(?<!\p{{L}})(?:{_MISSING})(?!\p{{L}})|\Aauto")) | t.rlike(r"\A(?:docstring|placeholder)")
        left = F.filter(words, lambda x: ~F.array_contains(frame, x) & ~own(x))
        return (F.size(left) > 0) & ~bare & ~item & ~remark

    return F.exists(F.split(low, r"(?<=[.!?])\s+|\n+"), says)


def documented_functions(symbols: DataFrame, files: DataFrame, code: bool = True) -> DataFrame:
    """``(symbol_id, file_id, qualified_name, signature, documentation[, comment, code])`` of functions and methods with telling documentation.

    ``documentation`` is what the tokens of the file's content say for every function found there; only where no function
    begins at a symbol's lines, or the content can't be read, the symbol's own docstring stands in ('' means none). ``code`` is the function's lines in the content (null if the content can't be read), the header
    stands in for a null ``signature``. Symbols with null id count as no symbol, repeated rows count once, files that do
    not decode have no functions, symbols whose lines no function begins at keep their docstring. Empty tables give an
    empty result. Files are shuffled by id once; a symbol only meets its own file's functions.
    """
    wanted = symbols.where(F.col("kind").isin("function", "method") & F.col("id").isNotNull())
    wanted = wanted.select(F.col("id").alias("symbol_id"), "file_id", "name", "qualified_name", "signature", "start_line", "end_line", "docstring").distinct()
    sources = sources_of(files)
    found = functions_of(sources, ends=code).withColumn("at", F.explode(F.array_distinct(F.array("start_line", "def_line"))))
    found = found.select("file_id", F.col("at").cast("int").alias("start_line"), F.col("docstring").alias("source_doc"), "comment", F.col("end_line").alias("found_end"), F.col("def_line").alias("header_line"))
    pairs = wanted.join(found, ["file_id", "start_line"], "left")
    lexed = F.when(F.col("header_line").isNotNull(), F.col("source_doc")).otherwise(F.col("docstring"))
    pairs = pairs.withColumn("documentation", lexed).where(telling(F.col("documentation"), F.col("name")))
    if not code:
        return pairs.select("symbol_id", "file_id", "qualified_name", "signature", "documentation").distinct()
    lines = sources.select("file_id", F.split("text", "\n").alias("lines"))
    pairs = pairs.join(lines, "file_id", "left")
    last = F.coalesce("end_line", "found_end")
    own = F.slice("lines", F.greatest(F.col("start_line"), F.lit(1)), F.greatest(last - F.col("start_line") + 1, F.lit(0)))
    header = F.regexp_extract(F.array_join(own, "\n"), r"\A\s*((?:@[^\n]*\n\s*)*(?:async\s+)?def\b[\s\S]*?\)[^:\n]*:)", 1)
    return pairs.select("symbol_id", "file_id", "qualified_name", F.coalesce("signature", F.when(header != "", header)).alias("signature"), "documentation", "comment", F.array_join(own, "\n").alias("code")).dropDuplicates(["symbol_id"])
