"""Traversals of a confidence-scored edge list ``edges(id, src, dst, kind, confidence)``.

A traversal is a loop on the driver over frontiers that stay distributed: join the frontier with the edges, keep one way
to each new (start, node), leave out what was reached before. Each level is written to the shared checkpoint folder, so
lineage stays short and a lost executor costs one level. The driver only learns whether a frontier is empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corbel.operators.lookup import edge_filter
from corbel.session import cut

OVERRIDES = "implements"


def adjacency(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """``(node, next, id, kind, confidence)``; every one of several parallel edges is kept, edges without an end are not."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(F.col(a).alias("node"), F.col(b).alias("next"), "id", "kind", "confidence")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, kind), with the highest confidence and the lowest id."""
    return edges.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"), F.min("id").alias("id"))


def traverse(edges: DataFrame, starts: DataFrame, max_depth: int, reverse: bool = False, kinds: Sequence[str] = (), min_confidence: float = 0.0, also: Sequence[str] = ()) -> DataFrame:
    """``(start, node, depth, nodes, edge_ids, confidence)``: one shortest path from each start to each node it reaches.

    ``starts(id)``; a start never reaches itself. Kinds in ``also`` are followed whatever ``kinds`` says. Among equally
    short ways the one whose last edge has the highest confidence, then the lowest id, is kept. ``max_depth`` below 1
    gives no rows; cycles, self-loops and parallel edges are harmless. ``confidence`` is that of the last edge.
    """
    spark = edges.sparkSession
    kept = edge_filter(edges, [*kinds, *also] if kinds else (), min_confidence)
    # Parallel edges never differ in where they lead: the best one stands for them.
    ways = adjacency(kept, reverse).groupBy("node", "next").agg(F.min(F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), "id")).alias("e"))
    ways = ways.where(F.col("node") != F.col("next")).select("node", "next", F.col("e.id").alias("edge"), (-F.col("e.c")).alias("confidence"))
    schema = "start bigint, node bigint, depth int, nodes array<bigint>, edge_ids array<bigint>, confidence double"
    if max_depth < 1:
        return spark.createDataFrame([], schema)
    ways = cut(ways)
    first = starts.where(F.col("id").isNotNull()).select(F.col("id").cast("bigint").alias("start")).distinct()
    frontier = first.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.array("start").alias("nodes"), F.expr("cast(array() as array<bigint>)").alias("edge_ids"), F.lit(1.0).alias("confidence"))
    reached = cut(frontier)
    frontier = reached
    for depth in range(1, max_depth + 1):
        step = frontier.select("start", "node", "nodes", "edge_ids").join(ways, "node")
        best = F.min_by(F.struct("nodes", "edge_ids", "edge", "confidence"), F.struct((-F.col("confidence")).alias("c"), "edge", "node")).alias("w")
        fresh = step.join(reached.select("start", F.col("node").alias("next")), ["start", "next"], "left_anti").groupBy("start", "next").agg(best)
        fresh = fresh.select("start", F.col("next").alias("node"), F.lit(depth).alias("depth"), F.concat("w.nodes", F.array("next")).alias("nodes"), F.concat("w.edge_ids", F.array("w.edge")).alias("edge_ids"), F.col("w.confidence").alias("confidence"))
        frontier = cut(fresh)
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached.where("depth > 0")


def callees(edges: DataFrame, starts: DataFrame, max_depth: int, kinds: Sequence[str] = (), min_confidence: float = 0.0) -> DataFrame:
    return traverse(edges, starts, max_depth, False, kinds, min_confidence)


def callers(edges: DataFrame, starts: DataFrame, max_depth: int, kinds: Sequence[str] = (), min_confidence: float = 0.0) -> DataFrame:
    """Who reaches the starts; overriding methods are always followed, so callers through an interface are found."""
    return traverse(edges, starts, max_depth, True, kinds, min_confidence, (OVERRIDES,))


def blast_radius(edges: DataFrame, starts: DataFrame, max_depth: int, kinds: Sequence[str] = ("imports", "calls"), min_confidence: float = 0.0) -> DataFrame:
    """Everything that depends on the starts."""
    return traverse(edges, starts, max_depth, True, kinds, min_confidence)


def affected(paths: DataFrame) -> DataFrame:
    """``(node, depth, start)`` of several starts together: each node at its least depth, ties to the lower start.

    A start is affected only through another start.
    """
    return paths.groupBy("node").agg(F.min(F.struct("depth", "start")).alias("b")).select("node", F.col("b.depth").alias("depth"), F.col("b.start").alias("start"))


def by_file(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(file_id, affected, names)``: reached symbols counted for each file."""
    where = symbols.select(F.col("id").alias("node"), "file_id", "qualified_name").distinct()
    return nodes.join(where, "node").groupBy("file_id").agg(F.countDistinct("node").alias("affected"), F.array_sort(F.collect_set("qualified_name")).alias("names"))


def depth_histogram(paths: DataFrame) -> DataFrame:
    """``(start, depth, reached)``, counted before any limit."""
    return paths.groupBy("start", "depth").agg(F.count(F.lit(1)).alias("reached"))


def shape(paths: DataFrame, limit: int) -> DataFrame:
    """The nearest ``limit`` nodes of each start by (depth, last confidence descending, id), with parent, edge and totals."""
    w = Window.partitionBy("start")
    placed = paths.withColumn("place", F.row_number().over(w.orderBy("depth", F.col("confidence").desc(), "node")))
    totals = paths.groupBy("start").agg(F.count(F.lit(1)).alias("total"))
    out = placed.where(F.col("place") <= limit).join(totals, "start")
    return out.select("start", "place", "node", "depth", F.element_at("nodes", -2).alias("parent"), F.element_at("edge_ids", -1).alias("edge_id"), "confidence", "total", (F.col("total") > limit).alias("truncated"))


def find_references(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return callers(edges, starts, 1)


def dependencies(edges: DataFrame, starts: DataFrame, depth: int = 1, kinds: Sequence[str] = ()) -> DataFrame:
    """Callees over all kinds, one to three steps deep."""
    return callees(edges, starts, min(max(depth, 1), 3), kinds)


def call_graph(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """Calls only, towards callers, callees or both; ``direction`` is a column of the result."""
    if direction not in ("callers", "callees", "both"):
        raise ValueError("direction must be callers, callees or both")
    parts = []
    if direction in ("callers", "both"):
        parts.append(callers(edges, starts, depth, ("calls",)).withColumn("direction", F.lit("callers")))
    if direction in ("callees", "both"):
        parts.append(callees(edges, starts, depth, ("calls",)).withColumn("direction", F.lit("callees")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def relationships_of(evidence: DataFrame, edges: DataFrame, limit: int = 32) -> DataFrame:
    """Edges with either end among ``evidence(id)``, one step, the first ``limit`` by edge id."""
    ids = evidence.select("id").distinct()
    a = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(*edges.columns)
    b = edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)
    return a.unionByName(b).distinct().orderBy("id").limit(limit)
