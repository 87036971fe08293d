"""Exact nearest neighbours of a stated query set, in blocks of matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "inner_product")


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances in double; small is near."""
    dots = q @ x.T
    if metric == "inner_product":
        return -dots
    if metric == "l2":
        # May lose a few last digits; the distances of those that are kept are taken again from differences.
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * dots, 0))
    scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(scale == 0, 1.0, 1 - dots / scale)


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", dim: int = 64, digits: int = 6, query_block: int = 4096, base_block: int = 50_000) -> DataFrame:
    """``(query_id, rank, chunk_id, distance)``: the ``k`` nearest ``vectors(scope, chunk_id, embedding)`` of each of
    ``queries(scope, query_id, embedding)`` in its scope (a model, a repository, or both).

    Distances are rounded before they are compared; ties go by id. Null embeddings and widths other than ``dim`` take no
    part on either side (use :func:`corbel.functions.vectors.checked` to fail on them instead). A zero vector has cosine
    distance 1 to everything.

    Both sides are cut into blocks and each pair of blocks is one matrix product in a task, so neither side is broadcast
    and no row pairs are shuffled: a block of vectors is sent once for each block of queries, and k rows return for each
    query and block.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    fits = F.col("embedding").isNotNull() & (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    q = queries.where(fits).select("scope", "query_id", F.col("embedding").cast("array<float>")).distinct()
    x = vectors.where(fits).select("scope", "chunk_id", F.col("embedding").cast("array<float>")).distinct()
    nq = max(1, -(-q.count() // query_block))
    nx = max(1, -(-x.count() // base_block), min(16, queries.sparkSession.sparkContext.defaultParallelism))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    qb = q.withColumn("qb", block("query_id", nq)).withColumn("xb", every(nx))
    xb = x.withColumn("xb", block("chunk_id", nx)).withColumn("qb", every(nq))

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            a = np.stack([np.asarray(v, np.float64) for v in left["embedding"].to_pylist()])
            b = np.stack([np.asarray(v, np.float64) for v in right["embedding"].to_pylist()])
            qid, cid = left["query_id"], right["chunk_id"].to_numpy()
            ls, rs = np.array(left["scope"].to_pylist()), np.array(right["scope"].to_pylist())
            for s in set(ls.tolist()) & set(rs.tolist()):
                qi, xi = np.nonzero(ls == s)[0], np.nonzero(rs == s)[0]
                for lo in range(0, len(qi), 256):
                    rows = qi[lo : lo + 256]
                    d = _distances(a[rows], b[xi], metric)
                    keep = min(k, len(xi))
                    # Everything up to the k-th distance and what rounding may move there, so that ties are settled by id.
                    edge = np.partition(d, keep - 1, axis=1)[:, keep - 1]
                    r, c = np.nonzero(d <= edge[:, None] + 10.0**-digits)
                    exact = np.linalg.norm(a[rows[r]] - b[xi[c]], axis=1) if metric == "l2" else d[r, c]
                    exact = np.round(exact, digits) + 0.0
                    order = np.lexsort((cid[xi[c]], exact, r))
                    r, c, exact = r[order], c[order], exact[order]
                    place = np.arange(len(r)) - np.searchsorted(r, r)
                    r, c, exact = r[place < keep], c[place < keep], exact[place < keep]
                    out[0] += qid.take(pa.array(rows[r])).to_pylist()
                    out[1] += [s] * len(r)
                    out[2] += cid[xi[c]].tolist()
                    out[3] += exact.tolist()
        return pa.table({"query_id": pa.array(out[0], left.schema.field("query_id").type), "scope": pa.array(out[1], pa.string()), "chunk_id": pa.array(out[2], pa.int64()), "distance": pa.array(out[3], pa.float64())})

    kind = queries.schema["query_id"].dataType.simpleString()
    found = qb.groupBy("qb", "xb").cogroup(xb.groupBy("qb", "xb")).applyInArrow(near, f"query_id {kind}, scope string, chunk_id bigint, distance double")
    w = Window.partitionBy("scope", "query_id").orderBy("distance", "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "scope", "rank", "chunk_id", "distance")
