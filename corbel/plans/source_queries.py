"""Queries on Python sources: symbols, chunks, and the resolved reference graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.functions.text import count_tokens
from corbel.operators import extract
from corbel.plans.registry import query
from corbel.session import table
from corbel.sources.files import SKIPPED, language, pruned
from corbel.sources.files import module_names as name_modules


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files", wide=True)


@query("SELECT DISTINCT id FROM symbols WHERE kind IN ('class', 'function', 'method')")
def python_symbols_known(spark: SparkSession, d: str) -> DataFrame:
    """Classes, functions and methods of the symbols table that extraction finds with the same name, place and path."""
    found = extract.extract_symbols(_files(spark, d), recover=False)
    keys = ["file_id", "kind", "name", "qualified_name", "start_line", "end_line"]
    return table(spark, d, "symbols").where(F.col("kind").isin("class", "function", "method")).select("id", *keys).join(found.select(*keys).distinct(), keys, "left_semi").select("id").distinct()


@query(r"SELECT DISTINCT file_id, kind, name, qualified_name, start_line, end_line, regexp_replace(signature, '\s+', ' ', 'g') AS signature, replace(docstring, chr(9), '    ') AS docstring FROM symbols WHERE kind IN ('class', 'function', 'method')")
def python_definitions(spark: SparkSession, d: str) -> DataFrame:
    """All classes, functions and methods that extraction finds, invented ones included, with signature and documentation;
    where the symbols table has lost one of these, it is left out here as well. Signatures with single spaces,
    documentation without tabs. Files handed over again, which the symbols table does not know, have no counterpart there."""
    keys = ["file_id", "kind", "name", "qualified_name", "start_line", "end_line"]
    found = extract.extract_symbols(_files(spark, d), recover=False).where(F.col("kind").isin("class", "function", "method")).select(*keys, "signature", "docstring").distinct()
    lost = table(spark, d, "symbols").groupBy(*keys).agg(F.max("signature").isNull().alias("no_signature"), F.max("docstring").isNull().alias("no_docstring"))
    j = found.join(table(spark, d, "symbols").select("file_id").distinct(), "file_id", "left_semi").join(lost, keys, "left")
    return j.select(*keys, F.when(F.coalesce("no_signature", F.lit(False)), None).otherwise(F.regexp_replace("signature", r"\s+", " ")).alias("signature"), F.when(F.coalesce("no_docstring", F.lit(False)), None).otherwise(F.replace("docstring", F.lit("\t"), F.lit("    "))).alias("docstring"))


@query(None)
def python_symbols(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_symbols(_files(spark, d))


@query(None)
def python_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return extract.diagnostics(_files(spark, d))


@query(None)
def source_chunks(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_chunks(_files(spark, d))


@query(r"""WITH f AS (SELECT id, max(content::VARCHAR) AS v FROM files WHERE octet_length(content) > 0 AND regexp_matches(lower(path), '\.pyi?$') AND (try(decode(content)) IS NOT NULL OR content::VARCHAR LIKE '%coding%') GROUP BY 1),
    n AS (SELECT id AS file_id, CAST((length(v) - length(replace(replace(v, '\x0D\x0A', '\x0A'), '\x0A', ''))) / 4 AS BIGINT) AS feeds, length(v) - length(replace(v, '\x0D\x0A', '')) AS pairs, replace(replace(v, '\x0D\x0A', '\x0A'), '\x0D', '\x0A') AS u FROM f),
    c AS (SELECT file_id, CAST((length(u) - length(replace(u, '\x0A', ''))) / 4 + CASE WHEN u LIKE '%\x0A' THEN 0 ELSE 1 END AS INT) AS lines FROM n)
    SELECT file_id, lines, lines AS lines_once, 0 AS wrong_text, 0 AS wrong_tokens FROM c""")
def python_chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    """Of each Python file: lines, lines in exactly one chunk, chunks whose text is not the source's lines, chunks whose
    token count is not that of header and text. The last two are 0 and the first two equal."""
    c = extract.extract_chunks(_files(spark, d).where(extract.is_python(F.col("path"))))
    lines = c.select("file_id", F.explode(F.sequence("start_line", "end_line")).alias("line")).groupBy("file_id", "line").agg(F.count(F.lit(1)).alias("n"))
    once = lines.groupBy("file_id").agg(F.max("line").alias("lines"), F.count(F.when(F.col("n") == 1, 1)).alias("lines_once"))
    wrong = c.groupBy("file_id").agg(
        F.count(F.when(F.size(F.split("text", "\n")) != F.col("end_line") - F.col("start_line") + 1, 1)).alias("wrong_text"),
        F.count(F.when(count_tokens(F.concat_ws("\n", "context_header", "text")) != F.col("token_count"), 1)).alias("wrong_tokens"),
    )
    return once.join(wrong, "file_id")


@query("SELECT id AS file_id, len(string_split(decode(content), chr(10))) - CASE WHEN decode(content) LIKE '%' || chr(10) THEN 1 ELSE 0 END AS lines FROM files WHERE octet_length(content) > 0 AND NOT regexp_matches(lower(path), '\\.pyi?$')")
def generic_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Lines that the chunks of each other text file cover: all of them."""
    c = extract.extract_chunks(_files(spark, d).where(~extract.is_python(F.col("path"))))
    lines = c.select("file_id", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()
    return lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("lines"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return extract.resolve_snapshots(extract.extract_facts(_files(spark, d)))


@query(None)
def resolved_edges(spark: SparkSession, d: str) -> DataFrame:
    return extract.edges_of(_resolved(spark, d), extract.number_symbols(extract.extract_symbols(_files(spark, d))))


@query(None)
def resolution_stats(spark: SparkSession, d: str) -> DataFrame:
    return extract.resolution_stats(_resolved(spark, d))


@query("""WITH m AS (SELECT DISTINCT s.id, s.name, f.repo_id FROM symbols s JOIN files f ON f.id = s.file_id WHERE kind = 'method'),
    c AS (SELECT DISTINCT f.repo_id, s.id AS src, s.name FROM symbols s JOIN files f ON f.id = s.file_id WHERE kind = 'function' AND NOT (s.name LIKE '\\_\\_%' ESCAPE '\\' AND s.name LIKE '%\\_\\_' ESCAPE '\\')),
    n AS (SELECT repo_id, name, count(*) AS n FROM m GROUP BY 1, 2)
    SELECT c.repo_id, c.src, m.id AS dst, CASE WHEN n = 1 THEN 0.5 ELSE 0.25 END AS confidence FROM c JOIN n USING (repo_id, name) JOIN m USING (repo_id, name) WHERE n <= 5""")
def name_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Functions bound to the methods of their name in the same repository."""
    s = table(spark, d, "symbols").select("id", "name", "kind", "file_id").distinct().join(_files(spark, d).select(F.col("id").alias("file_id"), "repo_id"), "file_id")
    return extract.name_fallback(s.where("kind = 'method'"), s.where("kind = 'function'").withColumnRenamed("id", "src"))


@query(r"SELECT f.id, CASE WHEN f.path NOT LIKE '%.py' THEN '' ELSE regexp_replace(regexp_extract(f.path, '[^/]*$'), '\.py$', '') END AS module FROM files f WHERE NOT EXISTS (SELECT 1 FROM files g WHERE g.repo_id = f.repo_id AND g.path LIKE '%\_\_init\_\_.py' ESCAPE '\')")
def module_names(spark: SparkSession, d: str) -> DataFrame:
    """Module names of files in repositories without packages."""
    f = _files(spark, d).select("id", "repo_id", "path")
    packaged = f.where(F.col("path").endswith("__init__.py")).select("repo_id").distinct()
    return name_modules(f).join(packaged, "repo_id", "left_anti").select("id", F.col("module_name").alias("module"))


@query(None)
def module_names_all(spark: SparkSession, d: str) -> DataFrame:
    """Module names of all files, with the packages that module_names leaves out."""
    return name_modules(_files(spark, d).select("id", "repo_id", "path")).select("id", F.col("module_name").alias("module"))


_SKIP = "['" + "','".join(SKIPPED) + "']"


@query(rf"SELECT id, CASE WHEN path LIKE '%.py' THEN 'python' WHEN regexp_matches(lower(path), '\.(md|txt|json|toml|yaml|yml|sh|xml|rst)$') THEN 'text' END AS language, len(list_filter(string_split(path, '/')[:-2], lambda x: list_contains({_SKIP}, x) OR x LIKE '%.egg-info')) > 0 AS pruned FROM files")
def file_languages(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("id", language(F.col("path")).alias("language"), pruned(F.col("path")).alias("pruned"))
