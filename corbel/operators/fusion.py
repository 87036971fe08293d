"""Reciprocal-rank fusion, graph-adjacency boost, and hybrid search as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corbel.operators.ranking import competition_ranks
from corbel.session import cut

RRF_K = 60
BOOST = 0.002


def assign_ranks(lists: DataFrame, ascending: tuple[str, ...] = ("vector",)) -> DataFrame:
    """``(query_id, retriever, weight, rank, chunk_id, score)`` with ranks filled in: a list without ranks gets them from its scores.

    Ties share the lower (better) rank. Lists may be any length: ranks come from counts, not from one task for a list.
    """
    rows = lists.select("query_id", "retriever", "weight", "rank", "chunk_id", "score").distinct()
    cost = F.when(F.col("retriever").isin(*ascending), F.col("score")).otherwise(-F.col("score"))
    given = rows.where(F.col("rank").isNotNull())
    missing = rows.where(F.col("rank").isNull()).withColumn("__cost", cost)
    placed = competition_ranks(missing, ["query_id", "retriever"], "__cost", "__mid", "__size")
    # Mid-ranks become the first rank of the tied group.
    tied = placed.groupBy("query_id", "retriever", "__mid").agg(F.count(F.lit(1)).alias("__ties"))
    placed = placed.join(tied, ["query_id", "retriever", "__mid"]).withColumn("rank", (F.col("__mid") - (F.col("__ties") - 1) / 2).cast("int"))
    return given.unionByName(placed.select(*given.columns))


def rrf(lists: DataFrame, k: int = RRF_K, digits: int = 9) -> DataFrame:
    """``(query_id, chunk_id, score, sources)`` of ``lists(query_id, retriever, weight, rank, chunk_id, score)``.

    Score = sum of weight / (k + rank) over the lists that hold the item; a null or zero weight is 1 and a k below 1 is
    60. ``sources`` lists (retriever, rank, native score) by retriever. An item of one list counts once there, at its
    best rank.
    """
    k = k if k > 0 else RRF_K
    weight = F.when((F.col("weight") == 0) | F.col("weight").isNull() | F.isnan("weight"), 1.0).otherwise(F.col("weight"))
    once = lists.where(F.col("rank").isNotNull()).withColumn("weight", weight).groupBy("query_id", "retriever", "chunk_id").agg(F.min("rank").alias("rank"), F.max("weight").alias("weight"), F.max("score").alias("score"))
    fused = once.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), digits).alias("score"), F.array_sort(F.collect_list(F.struct("retriever", "rank", "score"))).alias("sources"))
    return fused.select("query_id", "chunk_id", "score", "sources")


def top_k(hits: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The best ``k`` rows of each query by score, then chunk id, with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col("chunk_id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def graph_boost(hits: DataFrame, chunks: DataFrame, edges: DataFrame, weight: float = BOOST, seed_limit: int = 1, digits: int = 9) -> DataFrame:
    """Hits with ``weight`` * (1 for a file shared with a seed + 2 for a symbol next to a seed's symbol) added per seed.

    Seeds are the ``seed_limit`` best hits of each query, which also boost themselves. ``chunks(id, symbol_id, file_id)``,
    ``edges(src, dst)`` in any kind and either direction. A weight below 0 or a query with fewer than two hits changes
    nothing.
    """
    if weight < 0:
        return hits
    home = chunks.select(F.col("id").alias("chunk_id"), "symbol_id", "file_id")
    located = hits.join(home, "chunk_id", "left")
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("__hits"))
    seeds = top_k(hits.select("query_id", "chunk_id", "score"), seed_limit).join(home, "chunk_id", "left").select("query_id", F.col("rank").alias("__seed"), F.col("symbol_id").alias("__symbol"), F.col("file_id").alias("__file"))
    same = located.join(seeds, "query_id").where(F.col("file_id") == F.col("__file")).select("query_id", "chunk_id", "__seed", F.lit(1).alias("__b"))
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    next_to = seeds.where(F.col("__symbol").isNotNull()).join(pairs, F.col("__symbol") == F.col("a")).select("query_id", "__seed", F.col("b").alias("symbol_id")).distinct()
    linked = located.join(next_to, ["query_id", "symbol_id"]).select("query_id", "chunk_id", "__seed", F.lit(2).alias("__b"))
    bonus = same.unionByName(linked).groupBy("query_id", "chunk_id").agg(F.sum("__b").alias("__bonus"))
    boosted = hits.join(bonus, ["query_id", "chunk_id"], "left").join(counts, "query_id")
    score = F.when(F.col("__hits") < 2, F.col("score")).otherwise(F.round(F.col("score") + weight * F.coalesce("__bonus", F.lit(0)), digits))
    return boosted.withColumn("score", score).select(*hits.columns)


def hybrid_search(retrievers: dict[str, Callable[[], DataFrame]], limit: int, weights: dict[str, float] | None = None, k: int = RRF_K, boost: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, list[str]]:
    """``(hits, failed)``: each retriever's best ``limit``, fused, boosted, then cut to ``limit``.

    A retriever is a function giving ``(query_id, rank, chunk_id, score)``. Each list is computed here, once, into the
    checkpoint folder (at most ``limit`` rows a query), so one that fails as it is planned or as it runs, like an embedder
    that does not answer, is named in ``failed`` and the others go on; only if all fail, the error is raised.
    """
    lists, failed, last = [], [], None
    for name, make in retrievers.items():
        try:
            rows = cut(make().where(F.col("rank") <= limit))
        except Exception as e:  # noqa: BLE001
            failed.append(name)
            last = e
            continue
        lists.append(rows.select("query_id", F.lit(name).alias("retriever"), F.lit(float((weights or {}).get(name, 1.0))).alias("weight"), F.col("rank").cast("int").alias("rank"), "chunk_id", F.col("score").cast("double").alias("score")))
    if not lists:
        raise last or ValueError("no retrievers")
    union = lists[0]
    for x in lists[1:]:
        union = union.unionByName(x)
    hits = rrf(union, k)
    return top_k(boost(hits) if boost else hits, limit), failed
