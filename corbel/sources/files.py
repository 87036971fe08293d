"""Source trees as tables: listing, pruning, ignore files, languages, module names, bounded excerpts."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.functions.text import slice_lines

# Directories that never hold source to index.
SKIPPED = [".git", ".hg", ".svn", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".nox", ".venv", "venv", "env", ".eggs", "node_modules", "dist", "build", ".idea", ".vscode", "testdata", "fixtures", "test-fixtures", "__snapshots__"]
# Extensions indexed as text.
TEXT = [".md", ".mdx", ".rst", ".txt", ".go", ".js", ".jsx", ".ts", ".tsx", ".java", ".rs", ".c", ".h", ".cpp", ".cc", ".cs", ".rb", ".php", ".swift", ".kt", ".kts", ".scala", ".sh", ".yaml", ".yml", ".toml", ".json", ".xml"]
MAX_EXCERPT = 501


def pruned(path: Column) -> Column:
    """Whether some directory of a relative path is never indexed."""
    return F.exists(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda d: d.isin(*SKIPPED) | d.endswith(".egg-info"))


def language(path: Column, text: bool = True) -> Column:
    """python, text, or null for what is not indexed."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)\z", 1))
    return F.when(path.endswith(".py"), "python").when(ext.isin(*TEXT), "text" if text else None)


def _glob(pattern: str) -> str:
    """Regular expression of an ignore pattern's path part."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
            continue
        if c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
            continue
        out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return out


class IgnoreFile:
    """Patterns of one ignore file; the last one that matches decides."""

    def __init__(self, text: str) -> None:
        self.rules: list[tuple[re.Pattern, bool]] = []
        for line in text.split("\n"):
            p = line.rstrip("\r")
            p = p if p.endswith("\\ ") else p.rstrip(" ")
            if not p or p.startswith("#"):
                continue
            keep = p.startswith("!")
            p = p[1:] if keep or p.startswith(("\\#", "\\!")) else p
            folder = p.endswith("/")
            body = p.rstrip("/")
            anchored = "/" in body
            body = body.lstrip("/")
            head = "" if anchored else "(?:.*/)?"
            # A pattern for a folder matches what is inside; any other also the path itself.
            self.rules.append((re.compile(head + _glob(body) + ("/.*" if folder else "(?:/.*)?") + r"\Z", re.S), keep))

    def matches(self, path: str) -> bool:
        """``path`` is relative to the file's directory; directories end in a slash."""
        hit = False
        for rule, keep in self.rules:
            if rule.match(path):
                hit = not keep
        return hit


class IgnoreRules:
    """All ignore files of a tree by directory ('' is the root). A file or a directory above it that any ignore file at or
    above its place matches is ignored; a deeper file can't take that back."""

    def __init__(self, by_dir: dict[str, str]) -> None:
        self.files = {d: IgnoreFile(t) for d, t in by_dir.items()}

    def ignored(self, path: str) -> bool:
        parts = path.split("/")
        for end in range(1, len(parts) + 1):
            here = "/".join(parts[:end]) + ("/" if end < len(parts) else "")
            for depth in range(end):
                rules = self.files.get("/".join(parts[:depth]))
                if rules and rules.matches("/".join(here.split("/")[depth:])):
                    return True
        return False


def keep_unignored(files: DataFrame, ignores: DataFrame, keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """Files that no ignore file of their snapshot excludes: ``ignores(keys, dir, text)``. The rules of a snapshot travel
    with its rows; paths are judged in batches."""
    rules = ignores.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("dir", "text"))).alias("__rules"))
    joined = files.join(rules, list(keys), "left")

    @F.pandas_udf("boolean")
    def excluded(path, rules):  # noqa: ANN001, ANN202
        cache: dict = {}
        out = []
        for p, r in zip(path, rules, strict=True):
            if not r:
                out.append(False)
                continue
            pairs = tuple(sorted(dict(r).items()))
            if pairs not in cache:
                cache[pairs] = IgnoreRules(dict(pairs))
            out.append(cache[pairs].ignored(p))
        return __import__("pandas").Series(out)

    return joined.where(~excluded("path", "__rules")).drop("__rules")


def module_names(files: DataFrame, keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """``files`` with ``module_name``: the unbroken chain of package directories above a Python file, and its own name.

    A package is a directory with an ``__init__.py``, which itself stands for the directory. Other files have ''.
    """
    base = files.where(F.col("path").endswith(".py")).select(*keys, "path").distinct()
    parts = F.split("path", "/")
    packages = base.where(F.element_at(parts, -1) == "__init__.py").select(*keys, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("__dir")).where("__dir <> ''").withColumn("__pkg", F.lit(True))
    above = base.withColumn("__n", F.size(parts) - 1).withColumn("__i", F.explode(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array(F.lit(0)))))
    above = above.withColumn("__dir", F.array_join(F.slice(parts, F.lit(1), F.col("__i")), "/")).join(packages, [*keys, "__dir"], "left")
    broken = above.groupBy(*keys, "path", "__n").agg(F.max(F.when(F.col("__pkg").isNull(), F.col("__i")).otherwise(0)).alias("__after"))
    own = F.regexp_replace(F.element_at(parts, -1), r"\.py\z", "")
    chain = F.slice(parts, F.col("__after") + 1, F.greatest(F.col("__n") - F.col("__after"), F.lit(0)))
    named = broken.select(*keys, "path", F.array_join(F.when(own == "__init__", chain).otherwise(F.concat(chain, F.array(own))), ".").alias("module_name"))
    return files.drop("module_name").join(named, [*keys, "path"], "left").withColumn("module_name", F.coalesce("module_name", F.lit("")))


def list_tree(root: str) -> Iterable[str]:
    """Relative paths of a directory that the driver and the executors see, without skipped directories."""
    for where, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in SKIPPED and not d.endswith(".egg-info"))
        for n in sorted(names):
            yield os.path.relpath(os.path.join(where, n), root).replace(os.sep, "/")


def scan(spark: SparkSession, root: str, repo_id: int = 1, text: bool = False) -> DataFrame:
    """``(repo_id, path, language, content, content_hash, module_name)`` of a tree on a shared file system.

    Python files, with ``text`` also the other text extensions. Skipped directories and ignore files are honoured. The
    driver lists names (Spark's own listing leaves out files that begin with an underscore, such as ``__init__.py``);
    contents are read by the executors.
    """
    root = os.path.abspath(root)
    paths = list(list_tree(root))
    rules = IgnoreRules({os.path.dirname(p): open(os.path.join(root, p), encoding="utf-8", errors="replace").read() for p in paths if os.path.basename(p) == ".gitignore"})
    kept = [(p,) for p in paths if not rules.ignored(p)]
    names = spark.createDataFrame(kept, "path string").withColumn("language", language(F.col("path"), text)).where("language IS NOT NULL")

    def read(batches):
        for b in batches:
            data = []
            for p in b.column(0).to_pylist():
                with open(os.path.join(root, p), "rb") as f:
                    data.append(f.read())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], names=["path", "language", "content"])

    files = names.mapInArrow(read, "path string, language string, content binary").withColumn("repo_id", F.lit(repo_id).cast("bigint"))
    return module_names(files.withColumn("content_hash", F.sha2("content", 256))).select("repo_id", "path", "language", "content", "content_hash", "module_name")


def excerpt(files: DataFrame, path: str, start: int, end: int, most: int = MAX_EXCERPT) -> DataFrame:
    """``(path, start_line, end_line, text)`` of an indexed file; only indexed paths can be read, and ``most`` lines at a time."""
    if start < 1 or end < start:
        raise ValueError("lines must be 1 or more, in order")
    count = min(end - start + 1, most)
    t = F.try_validate_utf8(F.col("content").cast("string"))
    lines = F.size(F.split(t, "\n"))
    return files.where(F.col("path") == path).select("path", F.lit(start).alias("start_line"), F.least(F.lit(start + count - 1), lines).alias("end_line"), slice_lines(t, F.lit(start), count).alias("text"))
