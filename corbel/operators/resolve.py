"""Resolution of names as relations: imports, inheritance, overrides and calls of all snapshots at once, with confidences.

Every question is a table and every rule a join. What a module's namespace holds is computed to a fixed point over
re-exports and star imports; a reference finds its first part in the scopes around it, in the file's imports or among
the builtins; what follows a module is looked up in namespaces, what follows a class in the order of its ancestors; last
comes the bare name of a method. It is a heuristic: flow and dynamic dispatch are not modelled, and what can't be bound
is reported, so recall can be measured.

All tables carry the snapshot's id, but no step gathers a snapshot: a repository with a third of all files is spread by
file, name and class like any other.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corbel.session import cut

EXACT, HIGH, MEDIUM, LOW = 1.0, 0.75, 0.5, 0.25
MANY = 5  # a method name that more classes share says nothing
CONSTRUCTOR_STEPS = 3

# Names of standard modules, used only to tell standard from third-party imports.
STANDARD = set(
    """__future__ abc argparse array ast asyncio base64 binascii bisect builtins bz2 calendar cgi cmath codecs collections colorsys concurrent
    configparser contextlib contextvars copy csv ctypes dataclasses datetime decimal difflib dis email enum errno faulthandler fnmatch fractions
    functools gc getpass gettext glob gzip hashlib heapq hmac html http importlib inspect io ipaddress itertools json keyword linecache locale
    logging lzma marshal math mimetypes multiprocessing numbers operator os pathlib pickle pkgutil platform pprint queue random re reprlib secrets
    select selectors shlex shutil signal site smtplib socket sqlite3 ssl stat statistics string struct subprocess sys sysconfig tempfile textwrap
    threading time timeit tkinter token tokenize tomllib traceback types typing unicodedata unittest urllib uuid warnings weakref webbrowser xml
    zipfile zlib zoneinfo""".split()
)
# Builtin names.
BUILTINS = set(
    """abs aiter all anext any ascii bin bool breakpoint bytearray bytes callable chr classmethod compile complex delattr dict dir divmod enumerate
    eval exec filter float format frozenset getattr globals hasattr hash help hex id input int isinstance issubclass iter len list locals map max
    memoryview min next object oct open ord pow print property range repr reversed round set setattr slice sorted staticmethod str sum super tuple
    type vars zip __import__ Exception BaseException ValueError TypeError KeyError IndexError RuntimeError AttributeError NotImplementedError
    StopIteration AssertionError ImportError OSError IOError LookupError ArithmeticError Warning DeprecationWarning UserWarning RuntimeWarning
    StopAsyncIteration KeyboardInterrupt SystemExit NameError ZeroDivisionError PermissionError FileNotFoundError TimeoutError""".split()
)

SYM = "struct<file:bigint,temp:int>"
RESOLVED = "repo_id bigint, what string, src_file bigint, src_temp int, dst_file bigint, dst_temp int, kind string, name string, confidence double, label string, n bigint"
KEY = ["repo_id", "file_id", "scope", "parts"]  # a reference: a dotted chain in a scope


def _sym(file: str, temp: str) -> Column:
    return F.struct(F.col(file).alias("file"), F.col(temp).alias("temp"))


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _last(parts: Column) -> Column:
    return F.element_at(parts, -1)


def _special(name: Column) -> Column:
    return name.startswith("__") & name.endswith("__")


def by_bare_name(methods: DataFrame, names: DataFrame, many: int = MANY) -> DataFrame:
    """``(repo_id, name, dst, confidence)``: methods that a receiver of unknown type may mean, by their name alone.

    ``methods(repo_id, dst, name)``, ``names(repo_id, name)``. One method of that name: 0.5; two to ``many``: 0.25 to
    each; more, or a special method: none. Names are counted before they are joined, so a frequent one costs one row.
    """
    few = methods.groupBy("repo_id", "name").agg(F.countDistinct("dst").alias("n")).where((F.col("n") <= many) & ~_special(F.col("name")))
    wanted = few.join(names.select("repo_id", "name").distinct(), ["repo_id", "name"], "left_semi")
    hit = methods.select("repo_id", "name", "dst").distinct().join(wanted, ["repo_id", "name"])
    return hit.select("repo_id", "name", "dst", F.when(F.col("n") == 1, MEDIUM).otherwise(LOW).alias("confidence"))


def ancestor_order(cls: object, bases: dict, path: tuple = ()) -> list:
    """A class and its ancestors as attribute lookup visits them (C3). Where the orders of its bases contradict each
    other, they are taken one after the other; a class that is its own ancestor is not entered again."""
    if cls in path:
        return [cls]
    direct = bases.get(cls, [])
    lines = [ancestor_order(b, bases, (*path, cls)) for b in direct] + [list(direct)]
    found = [cls]
    left = lines
    while left := [rest for line in left if (rest := [k for k in line if k not in found])]:
        blocked = {k for line in left for k in line[1:]}
        free = [line[0] for line in left if line[0] not in blocked]
        if not free:
            return list(dict.fromkeys([cls, *(k for line in lines for k in line)]))
        found.append(free[0])
    return found


class Snapshots:
    """The relations of all snapshots in ``facts`` (see :func:`corbel.operators.extract.extract_facts`)."""

    def __init__(self, facts: DataFrame) -> None:
        self.spark = facts.sparkSession
        f = facts.select("repo_id", "file_id", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("module_name", F.lit("")).alias("module"), "symbols", "imports", "scopes", "binds", "bases", "calls")
        f = f.withColumn("package", F.element_at(F.split("path", "/"), -1) == "__init__.py")
        headless = F.raise_error(F.concat(F.lit("no module symbol in file "), F.col("file_id").cast("string")))
        f = f.withColumn("symbols", F.when(F.exists("symbols", lambda s: s["temp"] == 1), F.col("symbols")).otherwise(headless))
        self.files = f = cut(f)  # every relation is read from this one table; sources are parsed once
        s = f.select("repo_id", "file_id", F.explode("symbols").alias("s")).select("repo_id", "file_id", "s.*").withColumn("sym", _sym("file_id", "temp"))
        self.symbols = s
        place = F.struct("start", "temp")
        #: (parent, name): the last definition, how many there are, whether all are variables; the same of methods alone.
        method = F.col("kind") == "method"
        self.members = cut(
            s.where("parent IS NOT NULL").groupBy(_sym("file_id", "parent").alias("parent"), "name").agg(
                F.max_by(F.struct("sym", (F.col("kind") == "class").alias("is_class")), place).alias("d"),
                F.count(F.lit(1)).alias("n"),
                F.every(F.col("kind") == "variable").alias("variables"),
                F.max_by("sym", F.when(method, place)).alias("method"),
                F.count(F.when(method, 1)).alias("methods"),
            ).select("parent", "name", F.col("d.sym").alias("dst"), F.col("d.is_class").alias("is_class"), "n", "variables", "method", "methods")
        )
        self.methods = s.where(method).select("repo_id", F.col("sym").alias("dst"), "name", "parent", "file_id", "start", "temp")
        #: The file that a module's name stands for: of several the last by path.
        self.homes = f.where("module <> ''").groupBy("repo_id", "module").agg(F.max_by("file_id", F.struct("path", "file_id")).alias("home"))
        self.scopes = f.select("file_id", F.explode("scopes").alias("s")).select("file_id", F.col("s.id").alias("scope"), "s.form", "s.symbol", "s.up", "s.cls", "s.me")
        self._imports()

    # -- imports and namespaces -----------------------------------------------------------------------------------------
    def _imports(self) -> None:
        tops = self.homes.select("repo_id", F.split("module", r"\.")[0].alias("top")).distinct().withColumn("inside", F.lit(True))
        i = self.files.select("repo_id", "file_id", F.col("module").alias("here"), "package", F.posexplode("imports").alias("ord", "i")).select("repo_id", "file_id", "here", "package", "ord", "i.*")
        i = i.withColumn("top", F.split("written", r"\.")[0]).join(tops, ["repo_id", "top"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
        path = F.when(F.col("here") != "", F.split("here", r"\.")).otherwise(F.array().cast("array<string>"))
        keep = F.size(path) - F.when(F.col("package"), F.col("level") - 1).otherwise(F.col("level"))
        below = F.array_join(F.concat(F.slice(path, F.lit(1), F.greatest(keep, F.lit(0))), F.when(F.col("written") != "", F.array("written")).otherwise(F.array().cast("array<string>"))), ".")
        relative = F.when((F.size(path) > 0) & (keep >= 0) & (below != ""), below)
        i = i.withColumn("target", F.when(F.col("level") == 0, F.col("written")).otherwise(relative))
        i = i.withColumn("outside", (F.col("level") == 0) & ~F.col("inside")).withColumn("label", F.when(F.col("top").isin(*sorted(STANDARD)), "stdlib").otherwise("third-party"))
        self.imports = i = cut(i)
        plain, given = i.where("form = 'plain'"), i.where("form = 'from' AND target IS NOT NULL")
        # Names bound by imports, the last one of a file.
        whole = plain.select("repo_id", "file_id", "ord", F.lit(0).alias("at"), F.when(F.col("alias") != "", F.col("alias")).otherwise(F.col("top")).alias("name"), F.when(F.col("outside"), "external").otherwise("module").alias("form"), F.when(F.col("alias") != "", F.col("written")).otherwise(F.col("top")).alias("module"), F.lit("").alias("member"))
        parts = given.select("repo_id", "file_id", "ord", F.posexplode("names").alias("at", "x"), "outside", "target")
        parts = parts.select("repo_id", "file_id", "ord", "at", F.when(F.col("x.alias") != "", F.col("x.alias")).otherwise(F.col("x.name")).alias("name"), F.when(F.col("outside"), "external").otherwise("member").alias("form"), F.col("target").alias("module"), F.col("x.name").alias("member"))
        named = whole.unionByName(parts)
        self.bindings = named.groupBy("repo_id", "file_id", "name").agg(F.max_by(F.struct("form", "module", "member"), F.struct("ord", "at")).alias("b")).select("repo_id", "file_id", "name", "b.*")
        stars = given.where("star")
        self.stars = stars.where("NOT outside").select("repo_id", "file_id", "ord", F.col("target").alias("module"))
        self.open_files = stars.where("outside").select("file_id").distinct()
        self.open_modules = self.homes.join(self.open_files.withColumnRenamed("file_id", "home"), "home", "left_semi").select("repo_id", "module")
        self._namespaces()

    def _namespaces(self) -> None:
        """``(repo_id, module, name) -> what, dst, is_class, target, confidence``: what each module's attributes are.

        Own definitions come first, then imported names, submodules and star imports in their order. Names that depend on
        other modules follow round by round until nothing changes; an answer remembers its way, so that no name is
        explained by itself.
        """
        homes = self.homes
        of_home = homes.select("repo_id", "module", F.col("home").alias("file_id"))
        at_module = homes.select("repo_id", "module", F.struct(F.col("home").alias("file"), F.lit(1).alias("temp")).alias("parent"))
        answer = ["what", "dst", "is_class", "target", "confidence"]
        way = F.array().cast("array<string>").alias("way")
        sure = F.when(F.col("n") > 1, HIGH).otherwise(EXACT).alias("confidence")
        own = self.members.join(at_module, "parent").select("repo_id", "module", "name", F.lit(0).alias("rank"), F.lit("symbol").alias("what"), "dst", "is_class", _null("string").alias("target"), sure, way)
        bound = self.bindings.withColumnsRenamed({"module": "from_module"}).join(of_home, ["repo_id", "file_id"])
        plain = bound.where("form <> 'member'").select("repo_id", "module", "name", F.lit(1).alias("rank"), F.col("form").alias("what"), _null(SYM).alias("dst"), F.lit(False).alias("is_class"), F.when(F.col("form") == "module", F.col("from_module")).alias("target"), F.lit(EXACT).alias("confidence"), way)
        split = F.split("module", r"\.")
        inner = homes.where(F.size(split) > 1).select("repo_id", F.array_join(F.slice(split, F.lit(1), F.size(split) - 1), ".").alias("outer"), _last(split).alias("name"), F.col("module").alias("target"))
        inner = inner.select("repo_id", F.col("outer").alias("module"), "name", F.lit(2).alias("rank"), F.lit("module").alias("what"), _null(SYM).alias("dst"), F.lit(False).alias("is_class"), "target", F.lit(EXACT).alias("confidence"), way)
        fixed = cut(own.unionByName(plain).unionByName(inner))
        refs = bound.where("form = 'member'").select("repo_id", "module", "name", F.col("from_module").alias("next"), F.col("member").alias("asked"))
        stars = self.stars.withColumnRenamed("module", "next").join(of_home, ["repo_id", "file_id"]).select("repo_id", "module", "next", (F.col("ord") + 3).alias("rank"))
        me = F.concat_ws("\0", "module", "name")

        def pick(rows: DataFrame) -> DataFrame:
            return rows.groupBy("repo_id", "module", "name").agg(F.min_by(F.struct(*answer, "way"), F.struct("rank", "way")).alias("a")).select("repo_id", "module", "name", "a.*")

        space, seen = cut(pick(fixed)), None
        loop = not refs.isEmpty() or not stars.isEmpty()
        while loop:
            there = space.withColumnsRenamed({"module": "next", "name": "asked"})
            opened = self.open_modules.select("repo_id", F.col("module").alias("next"), F.lit(True).alias("opened"))
            via = refs.join(there, ["repo_id", "next", "asked"], "left").join(opened, ["repo_id", "next"], "left").where("what IS NOT NULL OR opened")
            via = via.select("repo_id", "module", "name", F.lit(1).alias("rank"), F.coalesce("what", F.lit("external")).alias("what"), "dst", F.coalesce("is_class", F.lit(False)).alias("is_class"), "target", F.coalesce("confidence", F.lit(EXACT)).alias("confidence"), F.concat(F.array(F.concat_ws("\0", "next", "asked")), F.coalesce("way", F.array())).alias("way"))
            over = stars.join(there.where("what IN ('symbol', 'module')"), ["repo_id", "next"])
            over = over.select("repo_id", "module", F.col("asked").alias("name"), "rank", "what", "dst", "is_class", "target", F.least("confidence", F.lit(HIGH)).alias("confidence"), F.concat(F.array(F.concat_ws("\0", "next", "asked")), "way").alias("way"))
            grown = fixed.unionByName(via.unionByName(over).where(~F.array_contains("way", me)))
            space = cut(pick(grown))
            now = tuple(space.agg(F.count(F.lit(1)), F.sum(F.xxhash64("repo_id", "module", "name", *answer, "way").cast("decimal(38,0)"))).first())
            if now == seen:
                break
            seen = now
        self.space = space.drop("way")

    def look_up(self, asked: DataFrame, module: str, name: str) -> DataFrame:
        """``asked`` with what that attribute of that module is; ``what`` is external or unknown where nothing is known."""
        there = self.space.withColumnsRenamed({"module": module, "name": name})
        opened = self.open_modules.select("repo_id", F.col("module").alias(module), F.lit(True).alias("__open"))
        out = asked.join(there, ["repo_id", module, name], "left").join(opened, ["repo_id", module], "left")
        return out.withColumn("what", F.coalesce("what", F.when(F.col("__open"), "external").otherwise("unknown"))).drop("__open")

    def import_rows(self) -> DataFrame:
        """``(repo_id, file_id, name, dst, label, resolved)`` of each imported module or name, as it is written."""
        i, home = self.imports, self.homes.select("repo_id", F.col("module").alias("target"), "home")
        plain = i.where("form = 'plain'").join(home, ["repo_id", "target"], "left").select("repo_id", "file_id", F.col("written").alias("name"), F.when(~F.col("outside"), F.col("home")).alias("home"), F.when(F.col("outside"), F.col("label")).otherwise("").alias("label"), (F.col("home").isNotNull() & ~F.col("outside")).alias("resolved"))
        each = F.concat(F.transform("names", lambda x: x["name"]), F.when(F.col("star"), F.array(F.lit("*"))).otherwise(F.array().cast("array<string>")))
        given = i.where("form = 'from'").select("*", F.explode(each).alias("asked"))
        spelled = F.concat(F.repeat(F.lit("."), F.col("level")), F.when(F.col("written") != "", F.concat("written", F.lit("."), "asked")).otherwise(F.col("asked")))
        given = given.withColumn("name", spelled)
        lost = given.where("target IS NULL OR outside").select("repo_id", "file_id", "name", _null("bigint").alias("home"), F.when(F.col("target").isNull(), "").otherwise(F.col("label")).alias("label"), F.lit(False).alias("resolved"))
        inside = given.where("target IS NOT NULL AND NOT outside")
        all_ = inside.where("asked = '*'").join(home, ["repo_id", "target"], "left").select("repo_id", "file_id", "name", "home", F.lit("").alias("label"), F.col("home").isNotNull().alias("resolved"))
        one = self.look_up(inside.where("asked <> '*'").select("repo_id", "file_id", "name", F.col("target").alias("module"), "asked"), "module", "asked")
        # A symbol belongs to the module it is imported from, a module to itself.
        one = one.withColumn("target", F.when(F.col("what") == "module", F.col("target")).when(F.col("what") == "symbol", F.col("module"))).join(home, ["repo_id", "target"], "left")
        one = one.select("repo_id", "file_id", "name", "home", F.when(F.col("what") == "external", "third-party").otherwise("").alias("label"), ((F.col("what") == "symbol") | (F.col("what") == "module") & F.col("home").isNotNull()).alias("resolved"))
        return plain.unionByName(lost).unionByName(all_).unionByName(one)

    def import_edges(self) -> DataFrame:
        """Modules to the modules they import, or import from."""
        i, home = self.imports.where("NOT outside AND target IS NOT NULL"), self.homes.select("repo_id", F.col("module").alias("target"), "home")
        direct = i.join(home, ["repo_id", "target"]).select("repo_id", "file_id", "home")
        names = i.where("form = 'from'").select("repo_id", "file_id", F.col("target").alias("module"), F.explode("names").alias("x")).select("repo_id", "file_id", "module", F.col("x.name").alias("asked"))
        modules = self.look_up(names, "module", "asked").where("what = 'module'").join(home, ["repo_id", "target"]).select("repo_id", "file_id", "home")
        return direct.unionByName(modules).where("file_id <> home").distinct()

    # -- the first part of a reference ----------------------------------------------------------------------------------
    def first_parts(self, keys: DataFrame) -> DataFrame:
        """``(repo_id, file_id, scope, first, what, ctor, dst, is_class, target, confidence)`` for each distinct first part.

        Function locals and definitions of the scopes around, from the inside out, of class scopes only the own; then the
        file's imports, its star imports, and the builtins.
        """
        asked = keys.select("repo_id", "file_id", "scope", F.col("parts")[0].alias("first")).distinct()
        around = self.scopes.select("file_id", "scope", F.posexplode("up").alias("depth", "at"))
        where = self.scopes.select("file_id", F.col("scope").alias("at"), "form", _sym("file_id", "symbol").alias("parent"))
        events = self.files.select("file_id", F.explode("binds").alias("b")).select("file_id", F.col("b.scope").alias("at"), F.col("b.name").alias("first"), "b.ctor")
        bound = events.groupBy("file_id", "at", "first").agg(F.count(F.when(F.col("ctor").isNull(), 1)).alias("times"), F.first("ctor", ignorenulls=True).alias("ctor"))
        bound = bound.select("file_id", "at", "first", F.lit(True).alias("bound"), F.when(F.col("times") == 1, F.col("ctor")).alias("ctor"))
        c = asked.join(around, ["file_id", "scope"]).join(where, ["file_id", "at"]).where("form <> 'class' OR depth = 0")
        c = c.join(bound, ["file_id", "at", "first"], "left").join(self.members.withColumnRenamed("name", "first"), ["parent", "first"], "left")
        local = F.col("bound") & ((F.col("form") == "function") | (F.col("form") == "module") & F.col("ctor").isNotNull() & F.col("variables"))
        c = c.where(local | F.col("dst").isNotNull())
        row = F.struct(
            F.when(local, "local").otherwise("symbol").alias("what"),
            F.when(local, F.col("ctor")).alias("ctor"),
            F.when(~F.coalesce(local, F.lit(False)), F.col("dst")).alias("dst"),
            F.coalesce("is_class", F.lit(False)).alias("is_class"),
            _null("string").alias("target"),
            F.when(F.col("n") > 1, HIGH).otherwise(EXACT).alias("confidence"),
        )
        near = cut(c.groupBy("repo_id", "file_id", "scope", "first").agg(F.min_by(row, "depth").alias("r")).select("repo_id", "file_id", "scope", "first", "r.*"))
        free = asked.join(near.select("file_id", "scope", "first"), ["file_id", "scope", "first"], "left_anti")
        names = free.select("repo_id", "file_id", "first").distinct()
        imported = names.join(self.bindings.withColumnRenamed("name", "first"), ["repo_id", "file_id", "first"])
        plain = imported.where("form <> 'member'").select("repo_id", "file_id", "first", F.lit(0).alias("rank"), F.col("form").alias("what"), _null(SYM).alias("dst"), F.lit(False).alias("is_class"), F.when(F.col("form") == "module", F.col("module")).alias("target"), F.lit(EXACT).alias("confidence"))
        given = self.look_up(imported.where("form = 'member'"), "module", "member").select("repo_id", "file_id", "first", F.lit(0).alias("rank"), "what", "dst", F.coalesce("is_class", F.lit(False)).alias("is_class"), "target", F.coalesce("confidence", F.lit(EXACT)).alias("confidence"))
        starred = names.join(self.stars, ["repo_id", "file_id"]).join(self.space.withColumnRenamed("name", "first"), ["repo_id", "module", "first"]).where("what IN ('symbol', 'module')")
        starred = starred.select("repo_id", "file_id", "first", (F.col("ord") + 1).alias("rank"), "what", "dst", "is_class", "target", F.least("confidence", F.lit(HIGH)).alias("confidence"))
        known = plain.unionByName(given).unionByName(starred).groupBy("repo_id", "file_id", "first").agg(F.min_by(F.struct("what", "dst", "is_class", "target", "confidence"), "rank").alias("r")).select("repo_id", "file_id", "first", "r.*")
        rest = free.join(known, ["repo_id", "file_id", "first"], "left").join(self.open_files.withColumn("opened", F.lit(True)), "file_id", "left")
        outside = F.when(F.col("opened") | F.col("first").isin(*sorted(BUILTINS)), "external").otherwise("unknown")
        rest = rest.select("repo_id", "file_id", "scope", "first", F.coalesce("what", outside).alias("what"), _null("array<string>").alias("ctor"), "dst", F.coalesce("is_class", F.lit(False)).alias("is_class"), "target", F.coalesce("confidence", F.lit(EXACT)).alias("confidence"))
        return cut(near.unionByName(rest))

    # -- dotted references ----------------------------------------------------------------------------------------------
    def resolve(self, keys: DataFrame, order: DataFrame, foreign: DataFrame) -> DataFrame:
        """``(*KEY, what, dst, is_class, confidence)``: what each distinct reference in ``keys`` stands for; one row for each
        symbol it may mean, one without symbol where it is external or unknown.

        ``order(cls, pos, anc)``: ancestors in lookup order; ``foreign(cls)``: classes with an ancestor outside.
        """
        keys = keys.select(*KEY).distinct()
        # A local made by a call has the type of what is called, which is a reference of its own, looked up in the same scope.
        every = todo = cut(keys)
        first = self.first_parts(every)
        for _ in range(CONSTRUCTOR_STEPS):
            made = self._first_of(todo, first).where("what = 'local' AND ctor IS NOT NULL AND size(parts) > 1").select("repo_id", "file_id", "scope", F.col("ctor").alias("parts"))
            todo = cut(made.distinct().join(every, KEY, "left_anti"))
            if todo.isEmpty():
                break
            first = first.unionByName(self.first_parts(todo).join(first.select("file_id", "scope", "first"), ["file_id", "scope", "first"], "left_anti"))
            every = cut(every.unionByName(todo))
        seen = cut(self._first_of(every, first))
        method = (F.size("parts") > 1) & F.col("cls").isNotNull() & (F.col("parts")[0] == F.col("me"))
        waits = ~method & (F.col("what") == "local") & F.col("ctor").isNotNull() & (F.size("parts") > 1)
        rest = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))
        owner = F.struct(F.col("file_id").alias("file"), F.col("cls").alias("temp"))
        single = F.size("parts") == 1
        # state: done, class (attributes of it are left), self, module, or name (only the last part speaks)
        state = (
            F.when(method, F.when(F.size("parts") == 2, "self").otherwise("name"))
            .when(single | F.col("what").isin("external", "unknown"), "done")
            .when(F.col("what") == "module", "module")
            .when((F.col("what") == "symbol") & F.col("is_class"), "class")
            .otherwise("name")
        )
        done = F.when(F.col("what").isin("symbol", "external"), F.col("what")).otherwise("unknown")
        start = seen.where(~F.coalesce(waits, F.lit(False))).select(*KEY, state.alias("state"), done.alias("what"), F.when(method, owner).otherwise(F.col("dst")).alias("dst"), F.coalesce("is_class", F.lit(False)).alias("is_class"), "target", F.coalesce("confidence", F.lit(EXACT)).alias("confidence"), rest.alias("rest"))
        out = cut(self._finish(self._walk(start), order, foreign))
        late = seen.where(waits).select(*KEY, "ctor", rest.alias("rest"))
        for step in range(CONSTRUCTOR_STEPS + 1):
            if late.isEmpty():
                break
            made = out.select("repo_id", "file_id", "scope", F.col("parts").alias("ctor"), F.col("what"), "dst", "is_class", "confidence").where("what <> 'symbol' OR is_class IS NOT NULL")
            made = made.groupBy("repo_id", "file_id", "scope", "ctor").agg(F.max_by(F.struct("what", "dst", "is_class", "confidence"), F.col("is_class")).alias("m"))
            ready = late.join(made, ["repo_id", "file_id", "scope", "ctor"], "left" if step == CONSTRUCTOR_STEPS else "inner")
            ready = ready.select(*KEY, "rest", F.col("m.what").alias("what"), F.col("m.dst").alias("dst"), F.coalesce("m.is_class", F.lit(False)).alias("is_class"), F.coalesce("m.confidence", F.lit(EXACT)).alias("confidence"))
            state = F.when(F.col("what") == "external", "done").when((F.col("what") == "symbol") & F.col("is_class"), "class").otherwise("name")
            ready = cut(ready.select(*KEY, state.alias("state"), F.coalesce("what", F.lit("unknown")).alias("what"), "dst", "is_class", _null("string").alias("target"), "confidence", "rest"))
            if ready.isEmpty() and step < CONSTRUCTOR_STEPS:
                continue
            out = cut(out.unionByName(self._finish(self._walk(ready), order, foreign)))
            late = cut(late.join(ready.select(*KEY), KEY, "left_anti"))
        return out

    def _first_of(self, keys: DataFrame, first: DataFrame) -> DataFrame:
        k = keys.withColumn("first", F.col("parts")[0]).join(first, ["repo_id", "file_id", "scope", "first"], "left")
        return k.join(self.scopes.select("file_id", "scope", "cls", "me"), ["file_id", "scope"], "left")

    def _walk(self, state: DataFrame) -> DataFrame:
        """Takes parts off until no reference stands at a module, or at a class with more than one part left."""
        moving = "state = 'module' OR state = 'class' AND size(rest) > 1"
        ready, at = state.where(f"NOT ({moving})"), cut(state.where(moving))
        ended = []
        while not at.isEmpty():
            tail = F.slice("rest", F.lit(2), F.size("rest") - 1)
            m = at.where("state = 'module'").select(*KEY, F.col("target").alias("module"), F.col("rest")[0].alias("asked"), "rest")
            m = self.look_up(m, "module", "asked")
            more = F.size("rest") > 1
            to = (
                F.when(F.col("what") == "symbol", F.when(~more, "done").when(F.col("is_class"), "class").otherwise("name"))
                .when((F.col("what") == "module") & more, "module")
                .otherwise("done")
            )
            what = F.when(F.col("what") == "module", "unknown").otherwise(F.col("what"))
            m = m.select(*KEY, to.alias("state"), what.alias("what"), "dst", F.coalesce("is_class", F.lit(False)).alias("is_class"), "target", F.coalesce("confidence", F.lit(EXACT)).alias("confidence"), F.when((to == "name") | (to == "done"), F.col("rest")).otherwise(tail).alias("rest"))
            c = at.where("state = 'class'").select(*KEY, F.col("dst").alias("parent"), F.col("rest")[0].alias("name"), "rest", "confidence")
            c = c.join(self.members.select("parent", "name", "dst", "is_class"), ["parent", "name"], "left")
            inner = F.coalesce("is_class", F.lit(False))
            c = c.select(*KEY, F.when(inner, "class").otherwise("name").alias("state"), F.lit("symbol").alias("what"), "dst", inner.alias("is_class"), _null("string").alias("target"), "confidence", F.when(inner, tail).otherwise(F.col("rest")).alias("rest"))
            both = cut(m.unionByName(c))
            ended.append(both.where(f"NOT ({moving})"))
            at = both.where(moving)
        for e in ended:
            ready = ready.unionByName(e)
        return cut(ready)

    def _finish(self, state: DataFrame, order: DataFrame, foreign: DataFrame) -> DataFrame:
        """Attributes of classes by the order of ancestors, instances' hooks by what lies below, and bare names."""
        cols = [*KEY, "what", "dst", "is_class", "confidence"]
        done = state.where("state = 'done'").select(*cols)
        asked = state.where("state IN ('class', 'self')").select(*KEY, "state", F.col("dst").alias("cls"), F.col("rest")[0].alias("name"), "confidence")
        found = self.attributes(asked.select("cls", "name").distinct(), order)
        a = asked.join(found, ["cls", "name"], "left").join(foreign.withColumn("outside", F.lit(True)), "cls", "left")
        hit = a.where("dst IS NOT NULL").select(*KEY, F.lit("symbol").alias("what"), "dst", "is_class", F.least("confidence", F.when(F.col("pos") > 0, HIGH).otherwise(EXACT), F.when(F.col("n") > 1, HIGH).otherwise(EXACT)).alias("confidence"))
        miss = cut(a.where("dst IS NULL").drop("dst", "is_class", "n", "pos"))
        hooks = self.hooks(miss.where("state = 'self'").select("cls", "name").distinct(), order)
        miss = miss.join(hooks, ["cls", "name"], "left")
        miss = miss.select(*KEY, F.when(F.col("hook").isNotNull(), "symbol").when(F.col("outside"), "external").otherwise("unknown").alias("what"), F.col("hook").alias("dst"), F.lit(False).alias("is_class"), F.coalesce("hook_confidence", F.lit(EXACT)).alias("confidence"))
        names = state.where("state = 'name'").withColumn("name", _last(F.col("parts")))
        bare = by_bare_name(self.methods, names).withColumnRenamed("confidence", "c")
        names = names.drop("dst", "is_class", "confidence").join(bare, ["repo_id", "name"], "left")
        names = names.select(*KEY, F.when(F.col("dst").isNotNull(), "symbol").otherwise("unknown").alias("what"), "dst", F.lit(False).alias("is_class"), F.coalesce("c", F.lit(EXACT)).alias("confidence"))
        return done.unionByName(hit).unionByName(miss).unionByName(names)

    # -- classes --------------------------------------------------------------------------------------------------------
    def attributes(self, asked: DataFrame, order: DataFrame, least: int = 0) -> DataFrame:
        """``(cls, name, dst, is_class, n, pos, owner)``: the nearest definition from the ``least``-th ancestor on."""
        line = asked.join(order.where(F.col("pos") >= least), "cls") if least else asked.join(order, "cls", "left").select("cls", "name", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("anc", "cls").alias("anc"))
        m = line.join(self.members.withColumnRenamed("parent", "anc"), ["anc", "name"])
        best = F.min_by(F.struct("dst", "is_class", "n", "pos", F.col("anc").alias("owner")), "pos").alias("a")
        return m.groupBy("cls", "name").agg(best).select("cls", "name", "a.*")

    def hooks(self, asked: DataFrame, order: DataFrame) -> DataFrame:
        """``(cls, name, hook, hook_confidence)``: methods of that name on subclasses, which a class calls on itself."""
        below = order.where("pos > 0").select(F.col("anc").alias("cls"), F.col("cls").alias("parent"))
        methods = self.methods.select(F.struct(F.col("file_id").alias("file"), F.col("parent").alias("temp")).alias("parent"), "name", F.col("dst").alias("hook"))
        h = asked.join(below, "cls").join(methods, ["parent", "name"]).select("cls", "name", "hook").distinct()
        n = h.groupBy("cls", "name").agg(F.count(F.lit(1)).alias("n"))
        return h.join(n, ["cls", "name"]).select("cls", "name", "hook", F.when(F.col("n") > MANY, LOW).otherwise(MEDIUM).alias("hook_confidence"))

    def orders(self, bases: DataFrame) -> DataFrame:
        """``(cls, pos, anc)`` for classes with bases. Ancestors are closed level by level; a task orders one class's own."""
        direct = cut(bases.groupBy("cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "base"))), lambda x: x["base"]).alias("direct")))
        step = bases.select(F.col("cls").alias("anc"), F.col("base").alias("next")).distinct()
        reach = fresh = cut(bases.select("cls", F.col("base").alias("anc")).distinct())
        while not fresh.isEmpty():
            fresh = cut(fresh.join(step, "anc").select("cls", F.col("next").alias("anc")).distinct().join(reach, ["cls", "anc"], "left_anti"))
            reach = cut(reach.unionByName(fresh))
        parts = reach.unionByName(direct.select("cls", F.col("cls").alias("anc"))).distinct().join(direct.withColumnRenamed("cls", "anc"), "anc")
        graphs = parts.groupBy("cls").agg(F.collect_list(F.struct("anc", "direct")).alias("graph"))
        sym = pa.struct([("file", pa.int64()), ("temp", pa.int32())])

        def run(batches):
            for b in batches:
                out: list[tuple] = []
                for r in b.to_pylist():
                    key = lambda s: (s["file"], s["temp"])
                    graph = {key(g["anc"]): [key(x) for x in g["direct"]] for g in r["graph"]}
                    out += [(r["cls"], i, {"file": a[0], "temp": a[1]}) for i, a in enumerate(ancestor_order(key(r["cls"]), graph))]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], sym), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], sym)], names=["cls", "pos", "anc"])

        return cut(graphs.mapInArrow(run, f"cls {SYM}, pos int, anc {SYM}"))

    def overrides(self, bases: DataFrame, order: DataFrame) -> DataFrame:
        """``(repo_id, src, dst, confidence)``: methods to the ones they override, along each direct base the nearest."""
        m = self.methods.select("repo_id", F.col("dst").alias("src"), "name", F.struct(F.col("file_id").alias("file"), F.col("parent").alias("temp")).alias("cls"))
        m = m.join(bases.select("cls", "ord", "base", F.col("confidence").alias("sure")), "cls")
        line = m.join(order.select(F.col("cls").alias("base"), "pos", "anc"), "base", "left").select("repo_id", "src", "name", "ord", "sure", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("anc", "base").alias("anc"))
        hit = line.join(self.members.where("methods > 0").select(F.col("parent").alias("anc"), "name", "method", "methods"), ["anc", "name"])
        near = hit.groupBy("repo_id", "src", "ord").agg(F.min_by(F.struct("method", "methods", "pos", "sure"), "pos").alias("a")).select("repo_id", "src", "ord", "a.*")
        sure = F.when((F.col("pos") == 0) & (F.col("sure") == EXACT) & (F.col("methods") == 1), EXACT).otherwise(HIGH)
        return near.groupBy("repo_id", "src", F.col("method").alias("dst")).agg(F.min_by(sure, "ord").alias("confidence"))

    def through_super(self, asked: DataFrame, bases: DataFrame, order: DataFrame, strange: DataFrame) -> DataFrame:
        """``(cls, name, what, dst, confidence)`` of ``super().name()`` in ``asked(cls, name)``.

        Sure where the only base, one of the repository, defines the name itself; ``strange(cls)`` have a base outside.
        """
        asked = asked.distinct()
        found = self.attributes(asked, order, least=1)
        only = bases.groupBy("cls").agg(F.count(F.lit(1)).alias("direct"), F.min_by("base", "ord").alias("base"))
        a = asked.join(found, ["cls", "name"], "left").join(only, "cls", "left").join(strange.withColumn("outside", F.lit(True)), "cls", "left")
        sure = (F.col("direct") == 1) & F.col("outside").isNull() & (F.col("owner") == F.col("base")) & (F.col("n") == 1)
        beyond = F.when(F.col("outside") | F.col("direct").isNull(), "external").otherwise("unknown")
        return a.select("cls", "name", F.when(F.col("dst").isNotNull(), "symbol").otherwise(beyond).alias("what"), "dst", F.when(sure, EXACT).otherwise(HIGH).alias("confidence"))


def resolve_all(facts: DataFrame) -> DataFrame:
    """Everything that resolution finds in each snapshot, as rows of ``RESOLVED``, computed once.

    ``what``: edge (with confidence; of several the highest counts), missing (label external or internal; the first
    reference of a symbol, name and kind decides), import (label stdlib, third-party, resolved or unresolved), count
    (references by kind; label resolved, external or unresolved). Null paths and module names are '', an empty table
    gives an empty result; files without a module symbol stop the query.
    """
    s = Snapshots(facts)
    spark = s.spark
    none = spark.createDataFrame([], f"cls {SYM}, pos int, anc {SYM}")
    nobody = none.select("cls")
    # Bases, first by what the classes define themselves; what is inherited may be a base as well.
    asked = s.files.select("repo_id", "file_id", F.posexplode("bases").alias("ord", "b")).select("repo_id", "file_id", "ord", _sym("file_id", "b.symbol").alias("cls"), F.col("b.scope").alias("scope"), F.col("b.parts").alias("parts"))
    asked = cut(asked)

    def with_bases(order: DataFrame, foreign: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = s.resolve(asked.where("parts IS NOT NULL"), order, foreign)
        # Only a class is a base; of several definitions the last is meant.
        what = F.when(F.col("what") == "symbol", F.when(F.col("is_class"), "symbol").otherwise("unknown")).otherwise(F.coalesce("what", F.lit("unknown")))
        one = found.groupBy(*KEY).agg(F.max_by(F.struct("what", "dst", "is_class", "confidence"), F.col("is_class")).alias("r")).select(*KEY, "r.*")
        rows = cut(asked.join(one, KEY, "left").withColumn("what", what))
        return rows, rows.where("what = 'symbol'").select("cls", "ord", F.col("dst").alias("base"), "confidence")

    rows, bases = with_bases(none, nobody)
    order = s.orders(bases)
    if not rows.where("what = 'unknown' AND size(parts) > 1").isEmpty() and not bases.isEmpty():
        rows, bases = with_bases(order, nobody)
        order = s.orders(bases)
    strange = rows.where("what <> 'symbol'").select("cls").distinct()
    foreign = cut(strange.union(order.join(strange.withColumnRenamed("cls", "anc"), "anc", "left_semi").select("cls")).distinct())
    inherits = rows.select("repo_id", F.col("cls").alias("src"), F.coalesce(F.array_join("parts", "."), F.lit("<expr>")).alias("name"), F.lit("inherits").alias("kind"), "ord", "what", "dst", "confidence")
    calls = s.files.select("repo_id", "file_id", F.posexplode("calls").alias("ord", "c")).select("repo_id", "file_id", "ord", F.col("c.scope").alias("scope"), "c.form", "c.parts").join(s.scopes.select("file_id", "scope", "symbol", "cls"), ["file_id", "scope"])
    calls = cut(calls.select("repo_id", "file_id", "ord", "scope", "form", "parts", _sym("file_id", "symbol").alias("src"), F.when(F.col("cls").isNotNull(), _sym("file_id", "cls")).alias("cls")))
    to = ["repo_id", "src", "name", "kind", "ord", "what", "dst", "confidence"]
    kind = F.lit("calls").alias("kind")
    chains = calls.where("form = 'chain'")
    chains = chains.join(s.resolve(chains, order, foreign), KEY).withColumn("name", F.array_join("parts", ".")).withColumn("kind", kind).select(*to)
    supers = calls.where("form = 'super'").withColumn("at", F.col("parts")[0])
    above = s.through_super(supers.where("cls IS NOT NULL").select("cls", F.col("at").alias("name")), bases, order, strange).withColumnRenamed("name", "at")
    supers = supers.join(above, ["cls", "at"], "left").select("repo_id", "src", F.concat(F.lit("super()."), "at").alias("name"), kind, "ord", F.coalesce("what", F.lit("unknown")).alias("what"), "dst", "confidence")
    loose = calls.where("form = 'attribute'").withColumn("at", F.col("parts")[0])
    bare = by_bare_name(s.methods, loose.select("repo_id", F.col("at").alias("name"))).withColumnRenamed("name", "at")
    loose = loose.join(bare, ["repo_id", "at"], "left").select("repo_id", "src", F.concat(F.lit("?."), "at").alias("name"), kind, "ord", F.when(F.col("dst").isNotNull(), "symbol").otherwise("unknown").alias("what"), "dst", "confidence")
    dynamic = calls.where("form = 'dynamic'").select("repo_id", "src", F.lit("<dynamic>").alias("name"), kind, "ord", F.lit("unknown").alias("what"), _null(SYM).alias("dst"), F.lit(EXACT).alias("confidence"))
    refs = cut(inherits.select(*to).unionByName(chains).unionByName(supers).unionByName(loose).unionByName(dynamic))
    imports = cut(s.import_rows())
    over = cut(s.overrides(bases, order))
    module = lambda file: F.struct(F.col(file).alias("file"), F.lit(1).alias("temp"))
    edges = refs.where("what = 'symbol'").select("repo_id", "src", "dst", "kind", "confidence")
    edges = edges.unionByName(over.select("repo_id", "src", "dst", F.lit("implements").alias("kind"), "confidence"))
    edges = edges.unionByName(s.import_edges().select("repo_id", module("file_id").alias("src"), module("home").alias("dst"), F.lit("imports").alias("kind"), F.lit(EXACT).alias("confidence")))
    edges = edges.groupBy("repo_id", "src", "dst", "kind").agg(F.max("confidence").alias("confidence"))
    lost = refs.where("what <> 'symbol'").groupBy("repo_id", "src", "name", "kind").agg(F.min_by("what", "ord").alias("what")).withColumn("label", F.when(F.col("what") == "external", "external").otherwise("internal"))
    unseen = imports.where("NOT resolved").groupBy("repo_id", module("file_id").alias("src"), "name").agg(F.max(F.when(F.col("label") != "", "external")).alias("label")).select("repo_id", "src", "name", F.lit("imports").alias("kind"), F.coalesce("label", F.lit("internal")).alias("label"))
    verdict = lambda c: F.when(c == "symbol", "resolved").when(c == "external", "external").otherwise("unresolved")
    one = refs.groupBy("repo_id", "kind", "src", "name", "ord").agg(F.first("what").alias("what"))
    counts = one.groupBy("repo_id", "kind", verdict(F.col("what")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.unionByName(imports.groupBy("repo_id", F.lit("imports").alias("kind"), F.when(F.col("resolved"), "resolved").when(F.col("label") != "", "external").otherwise("unresolved").alias("label")).agg(F.count(F.lit(1)).alias("n")))
    counts = counts.unionByName(over.groupBy("repo_id", F.lit("implements").alias("kind"), F.lit("resolved").alias("label")).agg(F.count(F.lit(1)).alias("n")))

    def rows_of(df: DataFrame, what: str, src: Column | None = None, dst: Column | None = None) -> DataFrame:
        have = set(df.columns)
        get = lambda c, t: F.col(c) if c in have else _null(t)
        src, dst = src if src is not None else _null(SYM), dst if dst is not None else _null(SYM)
        return df.select("repo_id", F.lit(what).alias("what"), src["file"].alias("src_file"), src["temp"].alias("src_temp"), dst["file"].alias("dst_file"), dst["temp"].alias("dst_temp"), F.col("kind"), get("name", "string").alias("name"), get("confidence", "double").alias("confidence"), get("label", "string").alias("label"), get("n", "bigint").alias("n"))

    shown = F.when(F.col("resolved"), "resolved").when(F.col("label") != "", F.col("label")).otherwise("unresolved")
    listed = imports.withColumn("label", shown).withColumn("kind", F.lit("imports")).withColumn("dst", F.when(F.col("home").isNotNull(), module("home")))
    out = rows_of(edges, "edge", F.col("src"), F.col("dst")).unionByName(rows_of(lost.unionByName(unseen, allowMissingColumns=True), "missing", F.col("src")))
    out = out.unionByName(rows_of(listed, "import", module("file_id"), F.col("dst"))).unionByName(rows_of(counts, "count"))
    return cut(out)
