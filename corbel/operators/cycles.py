"""Strongly connected components and shortest cycles, as loops of joins over checkpointed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.operators.lookup import edge_filter
from corbel.session import cut


def _links(edges: DataFrame, kinds: Sequence[str], min_confidence: float) -> DataFrame:
    kept = edge_filter(edges, kinds, min_confidence)
    return kept.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).distinct()


def _spread(colors: DataFrame, links: DataFrame) -> DataFrame:
    """Largest color that reaches each node, to the fixed point; all nodes that changed go on."""
    changed = colors
    while True:
        offers = changed.join(links, changed.node == links.src).groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("offer"))
        both = colors.join(offers, "node", "left")
        # `moved` travels with the table, so one write serves the next colors and the next frontier.
        after = cut(both.select("node", F.greatest("color", F.coalesce("offer", "color")).alias("color"), (F.coalesce("offer", "color") > F.col("color")).alias("moved")))
        changed = after.where("moved").select("node", "color")
        colors = after.select("node", "color")
        if changed.isEmpty():
            return colors


def components(edges: DataFrame, kinds: Sequence[str] = (), min_confidence: float = 0.0) -> DataFrame:
    """``(node, component)`` for nodes on cycles; a component's number is its largest node. Self-loops count as cycles.

    Forward colors, then backward from each color's root: the nodes of a color that reach its root are one component.
    Nodes without an edge in or out of the rest are dropped between rounds, as they lie on no cycle.
    """
    all_links = cut(_links(edges, kinds, min_confidence))
    loops = all_links.where("src = dst").select(F.col("src").alias("node")).distinct()
    links = all_links.where("src <> dst")
    done = None
    while True:
        # Trim a few layers that no cycle passes; the colors take care of what is left.
        for _ in range(2):
            links = links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            links = links.join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        links = cut(links)
        if links.isEmpty():
            break
        nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
        colors = cut(_spread(cut(nodes.select("node", F.col("node").alias("color"))), links))
        one = links.join(colors.select(F.col("node").alias("src"), F.col("color").alias("sc")), "src").join(colors.select(F.col("node").alias("dst"), F.col("color").alias("dc")), "dst").where("sc = dc").select("src", "dst", F.col("sc").alias("color"))
        one = cut(one)
        members = cut(colors.where("node = color"))
        front = members
        while True:
            back = front.join(one.select(F.col("dst").alias("node"), "src", "color"), ["node", "color"]).select(F.col("src").alias("node"), "color").distinct()
            front = cut(back.join(members, ["node", "color"], "left_anti"))
            if front.isEmpty():
                break
            members = members.unionByName(front)
        found = cut(members.select("node", F.col("color").alias("component")))
        big = found.join(found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component"), "component", "left_semi")
        done = big if done is None else done.unionByName(big)
        links = links.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    alone = loops.select("node", F.col("node").alias("component"))
    if done is None:
        return alone
    done = done.select("node", "component")
    return done.unionByName(alone.join(done.select("node"), "node", "left_anti"))


def shortest_cycles(edges: DataFrame, parts: DataFrame, kinds: Sequence[str] = (), min_confidence: float = 0.0) -> DataFrame:
    """``(component, length, cycle)``: a shortest closed walk of each component, first node repeated at the end.

    Among the shortest ones the lexicographically smallest walk is taken; a self-loop is [n, n]. All nodes of a component
    start walks at once; the component is out as soon as one of its walks closes.
    """
    links = _links(edges, kinds, min_confidence)
    inner = links.join(parts.select(F.col("node").alias("src"), F.col("component").alias("component")), "src").join(parts.select(F.col("node").alias("dst"), F.col("component").alias("c2")), "dst").where("component = c2").select("component", "src", "dst")
    inner = cut(inner)
    walks = cut(inner.select("component", F.col("src").alias("start"), F.col("dst").alias("node"), F.array("src", "dst").alias("walk")))
    seen = walks.select("component", "start", "node")
    out = None
    while not walks.isEmpty():
        closed = walks.where("start = node").groupBy("component").agg(F.min("walk").alias("cycle"))
        closed = cut(closed)
        out = closed if out is None else out.unionByName(closed)
        going = walks.join(closed.select("component"), "component", "left_anti")
        step = going.join(inner.select("component", F.col("src").alias("node"), F.col("dst").alias("next")), ["component", "node"])
        # One walk to a place is enough: the smallest of that length.
        best = step.groupBy("component", "start", "next").agg(F.min(F.concat("walk", F.array("next"))).alias("walk")).withColumnRenamed("next", "node")
        walks = cut(best.join(seen, ["component", "start", "node"], "left_anti").select("component", "start", "node", "walk"))
        seen = seen.unionByName(walks.select("component", "start", "node"))
    if out is None:
        return edges.sparkSession.createDataFrame([], "component bigint, length int, cycle array<bigint>")
    return out.select("component", (F.size("cycle") - 1).alias("length"), "cycle")


def cycle_report(parts: DataFrame, cycles: DataFrame, limit: int = 20, members: int = 20) -> DataFrame:
    """Components by size descending, then smallest member: first ``members`` ids, how many are left out, shortest cycle.

    Only the members shown are gathered.
    """
    from pyspark.sql import Window

    placed = parts.withColumn("__r", F.row_number().over(Window.partitionBy("component").orderBy("node")))
    shown = placed.where(F.col("__r") <= members).groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"))
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first"))
    top = sizes.orderBy(F.col("size").desc(), "first").limit(limit)
    return top.join(shown, "component").join(cycles.select("component", "cycle"), "component", "left").select("first", "size", "members", F.greatest(F.col("size") - members, F.lit(0)).alias("members_omitted"), "cycle")
