"""Point lookups, hydration of ids, edge filters, and scoped scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is asked for; unknown ids are silently absent."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def of_repo(rows: DataFrame, files: DataFrame, repo_id: int | None = None) -> DataFrame:
    """Rows with a ``file_id``, joined to their repository, of one repository or all."""
    scope = files.select(F.col("id").alias("file_id"), "repo_id")
    if repo_id is not None:
        scope = scope.where(F.col("repo_id") == repo_id)
    return rows.join(scope, "file_id")


def find_by_name(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """All symbols of each bare name in ``names(query_id, name)``."""
    return names.select("query_id", F.col("name").alias("__n")).join(symbols, F.col("__n") == F.col("name")).drop("__n")


def find_by_qualified_name(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """The one symbol of each qualified name: the lowest (file, line, id)."""
    hits = names.select("query_id", F.col("name").alias("__n")).join(symbols, F.col("__n") == F.col("qualified_name")).drop("__n")
    w = Window.partitionBy("query_id").orderBy("file_id", "start_line", "id")
    return hits.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def find_definition(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """All symbols with the qualified name, or else all with the bare name; ``match`` says which."""
    n = names.select("query_id", F.col("name").alias("__n")).distinct()
    exact = n.join(symbols, F.col("__n") == F.col("qualified_name")).withColumn("match", F.lit("qualified"))
    bare = n.join(symbols, F.col("__n") == F.col("name")).withColumn("match", F.lit("bare"))
    bare = bare.join(exact.select("query_id").distinct(), "query_id", "left_anti").select(*exact.columns)
    return exact.unionByName(bare).drop("__n").distinct()


def describe_candidates(found: DataFrame, limit: int = 10) -> DataFrame:
    """``(query_id, candidates, outcome, shown)``: how a name resolved, with at most ``limit`` names to choose from."""
    w = Window.partitionBy("query_id").orderBy("file_id", "start_line", "id")
    ranked = found.withColumn("__r", F.row_number().over(w))
    shown = F.array_sort(F.collect_list(F.when(F.col("__r") <= limit, F.struct(F.col("__r").alias("place"), "id", "qualified_name"))))
    out = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"), shown.alias("shown"))
    return out.withColumn("outcome", F.when(F.col("candidates") == 1, "resolved").otherwise("ambiguous"))


def edge_filter(edges: DataFrame, kinds: Sequence[str] = (), min_confidence: float = 0.0) -> DataFrame:
    """Edges of the given kinds (none given: all) with at least this confidence. Null confidence counts as 0."""
    out = edges.where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    return out.where(F.col("kind").isin(*kinds)) if kinds else out


def callers_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges into the asked symbols, of any kind."""
    return edges.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")


def callees_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges out of the asked symbols, of any kind."""
    return edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")


def bound(name: str, value: int, default: int, most: int) -> tuple[int, str | None]:
    """A parameter in its limits and a note if it was cut: negative fails, 0 is the default."""
    if value < 0:
        raise ValueError(f"{name} must not be negative")
    if value == 0:
        return default, None
    return (most, f"{name} capped at {most}") if value > most else (value, None)


def hydrate_hits(hits: DataFrame, chunks: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Hits with their chunk's place, symbol and path. A hit without chunk is dropped; symbol and file may be missing."""
    c = chunks.select(F.col("id").alias("chunk_id"), "symbol_id", "file_id", "start_line", "end_line")
    s = symbols.select(F.col("id").alias("symbol_id"), "qualified_name").distinct()
    f = files.select(F.col("id").alias("file_id"), "path")
    return hits.join(c, "chunk_id").join(s, "symbol_id", "left").join(f, "file_id", "left")


def refs_by_id(ids: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every asked id with its name and kind where known."""
    return ids.select("id").distinct().join(symbols.select("id", "name", "kind", "qualified_name").distinct(), "id", "left")


def graph_projection(symbols: DataFrame, edges: DataFrame, kind: str | None = None, max_nodes: int = 2500, max_edges: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Bounded picture of a graph for display: the first nodes by id and the first edges with both ends among them."""
    nodes = symbols.where(F.col("kind") == kind) if kind else symbols
    nodes = nodes.select("id", "kind", "qualified_name").distinct().orderBy("id").limit(max_nodes)
    kept = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes, kept.orderBy("id").limit(max_edges)


def closed_set(column: Column, allowed: Sequence[str], what: str) -> Column:
    """``column`` itself; a value outside the closed set stops the query."""
    return F.when(column.isin(*allowed) | column.isNull(), column).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), column)))
