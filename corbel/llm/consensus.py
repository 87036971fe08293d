"""Problem 6: one ranking from several differently-scaled lists, by robust rank aggregation.

Only positions count, never the size of scores. An item's ranks over the lists, as shares of all items of the query, are
sorted; the k-th smallest of n uniform ranks follows a beta distribution, whose tail says how surprising it is that the
item stands that high in k lists. The smallest tail probability, corrected for the number of lists, is the item's
significance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.operators.ranking import competition_ranks
from corbel.session import cut


def _log_gamma(v: np.ndarray) -> np.ndarray:
    values, at = np.unique(v, return_inverse=True)  # a few sums of weights
    return np.array([math.lgamma(x) for x in values])[at]


def beta_tail(x: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """P(the k-th smallest of n uniform numbers <= x), 0 < x and 0 < k <= n, for real k and n: the regularised incomplete
    beta function with k and n - k + 1, by its continued fraction. Every element stops by itself, so equal arguments give
    equal results in any company."""
    p, q = k.astype(float), n - k + 1.0
    swap = x > (p + 1) / (p + q + 2)  # where the fraction converges faster from the other side
    a, b, y = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore"):
        lead = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(y) + b * np.log1p(-y)) / a
    safe = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c, d = np.ones_like(y), 1 / safe(1 - (a + b) * y / (a + 1))
    value, moving, m = d.copy(), np.ones(len(y), bool), 0
    while moving.any():
        m += 1
        even = m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))
        factor = np.ones_like(y)
        for step in (even, odd):
            d, c = 1 / safe(1 + step * d), safe(1 + step / c)
            factor = factor * d * c
        value = np.where(moving, value * factor, value)
        moving &= np.abs(factor - 1) > 1e-13
    tail = np.where(swap, 1 - lead * value, lead * value)
    return np.where(x >= 1, 1.0, np.clip(tail, 0.0, 1.0))


def list_keys(ranked: DataFrame, ascending: tuple[str, ...] = ("vector",)) -> DataFrame:
    """``(query_id, retriever, chunk_id, weight, key)``: each list's items once, with what orders them.

    A list's ranks are used where it has them, else its scores (small is good for the retrievers in ``ascending``).
    """
    clean = ranked.where(F.col("query_id").isNotNull() & F.col("retriever").isNotNull() & F.col("chunk_id").isNotNull())
    score = F.when(~F.isnan("score"), F.col("score"))
    key = F.when(F.col("rank") >= 1, F.col("rank").cast("double"))
    items = clean.groupBy("query_id", "retriever", "chunk_id").agg(F.min(key).alias("rank"), F.min(F.when(F.col("retriever").isin(*ascending), score).otherwise(-score)).alias("cost"), F.max(F.when(~F.isnan("weight") & (F.col("weight") > 0), F.col("weight"))).alias("weight"))
    lists = items.groupBy("query_id", "retriever").agg((F.count("rank") > 0).alias("has_ranks"), F.coalesce(F.max("weight"), F.lit(1.0)).alias("w"))
    order = F.when(F.col("has_ranks"), F.col("rank")).otherwise(F.col("cost"))
    return items.drop("weight").join(lists, ["query_id", "retriever"]).select("query_id", "retriever", "chunk_id", F.col("w").alias("weight"), order.alias("key"))


def robust_rank_aggregation(ranked: DataFrame, ascending: tuple[str, ...] = ("vector",)) -> DataFrame:
    """``(query_id, chunk_id, significance, best_position, n_lists)`` for each item of each query; small is good.

    Only weights in proportion to each other matter: the lightest list of a query is one vote, a list of any positive
    weight w counts as w / lightest such lists with the same ranks; null, 0, negative or NaN weights are 1. An item's normalised rank in a list is its position there divided by the number of different items in all lists
    of the query, so that the second place of a short list is worth that of a long one; an item absent from a list has
    rank 1 there. Positions tie where ranks or scores tie. A list with some ranks uses them alone, its items without one
    stand last, together. Rows without query, retriever or chunk are left out, copies count once, an empty table gives
    an empty result.

    Positions come from counts of distinct values in order-preserving cells, so a query or list that holds a third of
    all rows is not gathered in a task; an item's ranks are one for each retriever.
    """
    keys = cut(list_keys(ranked, ascending))  # ranked, counted and joined from one stored table
    votes = keys.groupBy("query_id", "retriever").agg(F.max("weight").alias("w")).groupBy("query_id").agg((F.sum("w") / F.min("w")).alias("votes"), F.min("w").alias("unit"), F.count(F.lit(1)).cast("int").alias("n_lists"))
    items = keys.select("query_id", "chunk_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_items"))
    positions = competition_ranks(keys, ["query_id", "retriever"], "key", "position", "size")
    places = positions.groupBy("query_id", "chunk_id").agg(F.collect_list(F.struct("position", "weight")).alias("places"))
    rows = places.join(votes.join(items, "query_id"), "query_id")

    def run(batches):
        for b in batches:
            lists, col = b.column("places"), lambda c: b.column(c).to_numpy(zero_copy_only=False)  # noqa: B023
            flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            starts = offsets[:-1] - offsets[0]
            if not len(starts):
                continue
            owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
            place, weight = flat.field("position").to_numpy(), flat.field("weight").to_numpy() / col("unit")[owner]
            order = np.lexsort((weight, place, owner))
            place, weight = place[order], weight[order]
            held = np.cumsum(weight)
            held -= (held - weight)[starts][owner]  # votes that rank the item at least that high
            n = col("votes")[owner]
            tails = beta_tail(place / col("n_items")[owner], np.minimum(held, n), n)
            best = np.minimum(1.0, np.minimum.reduceat(tails, starts) * col("n_lists"))
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("chunk_id"), pa.array(best), pa.array(np.minimum.reduceat(place, starts)), b.column("n_lists")], names=["query_id", "chunk_id", "significance", "best_position", "n_lists"])

    return rows.select("query_id", "chunk_id", "places", "votes", "unit", "n_lists", "n_items").mapInArrow(run, "query_id string, chunk_id bigint, significance double, best_position double, n_lists int")


def first_of_each(scored: DataFrame) -> DataFrame:
    """``(query_id, chunk_id)``: the most significant item of each query; ties go to the better best position, then the smaller id."""
    best = F.min_by("chunk_id", F.struct("significance", "best_position", "chunk_id")).alias("chunk_id")
    return scored.groupBy("query_id").agg(best)
