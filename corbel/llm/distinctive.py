"""Problem 1: how characteristic a term is of a record, by a parsimonious language model.

A record's terms are taken as a mixture of the record's own model and the collection's background model. Expectation-
maximisation shifts the mass of terms the background explains to the background; what stays is the record's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rest(freq: np.ndarray, background: np.ndarray, offsets: np.ndarray, weight: float) -> np.ndarray:
    """Where the iteration comes to rest, for many records at once.

    At rest each term that keeps mass has p = f / m - c * q with c = (1 - weight) / weight: it explains its occurrences
    in the same proportion as all others. Terms keep mass in order of f / q, down to the last one for which p is
    positive when m is fixed by the terms kept, m = sum f / (1 + c * sum q).
    """
    sizes = np.diff(offsets)
    owner, c = np.repeat(np.arange(len(sizes)), sizes), (1 - weight) / weight
    ratio = freq / background
    order = np.lexsort((-ratio, owner))
    before = offsets[:-1]
    running = lambda v: np.cumsum(v[order]) - np.repeat(np.concatenate([[0.0], np.cumsum(v[order])])[before], sizes)
    mass, cover = running(freq), running(background)
    keeps = ratio[order] > c * mass / (1 + c * cover)
    last = np.maximum.reduceat(np.where(keeps, np.arange(len(freq)), -1), before)  # the first term always keeps mass
    kept = np.arange(len(freq)) <= last[owner]
    f, q = np.where(kept, freq[order], 0.0), np.where(kept, background[order], 0.0)
    m = np.add.reduceat(f, before) / (1 + c * np.add.reduceat(q, before))
    p = np.empty(len(freq))
    p[order] = np.where(kept, np.maximum(f / m[owner] - c * q, 0.0), 0.0)
    return p / np.repeat(np.add.reduceat(p, before), sizes)


def em_step(p: np.ndarray, freq: np.ndarray, background: np.ndarray, offsets: np.ndarray, weight: float) -> np.ndarray:
    """E: the part of a term's occurrences that the record's own model explains. M: those parts, normalised."""
    part = freq * (weight * p / (weight * p + (1 - weight) * background))
    return part / np.repeat(np.add.reduceat(part, offsets[:-1]), np.diff(offsets))


def em(freq: np.ndarray, background: np.ndarray, offsets: np.ndarray, weight: float, rounds: int = 20, close: float = 1e-9) -> np.ndarray:
    """Converged term probabilities of many records at once; ``offsets`` delimit the (non-empty) records.

    ``rounds`` steps of expectation-maximisation, then a jump to the point where the steps come to rest, which terms at
    the edge of keeping mass would approach only like one over the number of steps. A last step shows that it is one:
    a record that this step still moves by more than ``close`` goes on step by step until it doesn't. So every record
    is at rest, and its result does not depend on the others of the batch.
    """
    sizes = np.diff(offsets)
    p = freq / np.repeat(np.add.reduceat(freq, offsets[:-1]), sizes)
    for _ in range(rounds):
        p = em_step(p, freq, background, offsets, weight)
    rest = _rest(freq, background, offsets, weight)
    after = em_step(rest, freq, background, offsets, weight)
    moving = np.maximum.reduceat(np.abs(after - rest), offsets[:-1]) > close
    if not moving.any():
        return rest
    p = np.where(np.repeat(moving, sizes), p, rest)
    while moving.any():
        new = em_step(p, freq, background, offsets, weight)
        moving &= np.maximum.reduceat(np.abs(new - p), offsets[:-1]) > close
        p = np.where(np.repeat(moving, sizes), new, p)
    return p


def term_distinctiveness(postings: DataFrame, docs: DataFrame | None = None, only: DataFrame | None = None, weight: float = 0.001, hot_share: float = 1e-4) -> DataFrame:
    """``(chunk_id, term, freq, df, prob, score, rank)`` for each term of each chunk.

    ``prob`` is the term's converged probability in the chunk's own model, ``score`` = prob * ln(prob / background)
    (0 where prob is 0), ``rank`` orders the chunk's terms by prob, then freq/background, then the term. The background
    is the share of a term's chunks in all (term, chunk) pairs. ``weight`` is the own model's share in the mixture; the
    small default leaves a record only terms that the background explains badly.

    ``postings(term, chunk_id, freq)``: copies count once; a null, zero or negative freq is taken from ``docs``'
    ``term_freq`` map, else as 1; rows without term or chunk are left out; empty terms are terms. ``only(chunk_id)``
    restricts the records that are scored, not the background. An empty table gives an empty result.

    Shuffles: (term, chunk) once for the document frequencies, combined by term before the second exchange, so frequent
    terms do not gather. Terms above ``hot_share`` of all pairs number at most 1 / hot_share, so their frequencies are
    broadcast; only the rest is joined by shuffle. A record's terms are gathered in one row, as its text is.
    """
    p = postings.select("term", "chunk_id", "freq").where(F.col("term").isNotNull() & F.col("chunk_id").isNotNull())
    spread = p.select("term", "chunk_id").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if only is not None:
        p = p.join(only.select("chunk_id").distinct(), "chunk_id", "left_semi")
    one = p.groupBy("term", "chunk_id").agg(F.max(F.when(F.col("freq") > 0, F.col("freq"))).alias("freq"))
    if docs is not None:
        lost = one.where(F.col("freq").isNull())
        maps = docs.select("chunk_id", "term_freq").where(F.col("term_freq").isNotNull()).join(lost.select("chunk_id").distinct(), "chunk_id", "left_semi")
        again = maps.select("chunk_id", F.explode("term_freq").alias("term", "again")).groupBy("term", "chunk_id").agg(F.max("again").alias("again"))
        found = lost.select("term", "chunk_id").join(again, ["term", "chunk_id"], "left").select("term", "chunk_id", F.col("again").alias("freq"))
        one = one.where(F.col("freq").isNotNull()).unionByName(found)
    one = one.select("term", "chunk_id", F.coalesce(F.when(F.col("freq") > 0, F.col("freq")), F.lit(1)).cast("int").alias("freq"))
    rated = spread.select("term", "df", (F.col("df") / spread.agg(F.sum("df")).scalar()).alias("q"))
    hot = rated.where(F.col("q") > hot_share).withColumnsRenamed({"df": "hot_df", "q": "hot_q"})
    split = one.join(F.broadcast(hot), "term", "left")
    frequent = split.where(F.col("hot_df").isNotNull()).select("term", "chunk_id", "freq", F.col("hot_df").alias("df"), F.col("hot_q").alias("q"))
    rare = split.where(F.col("hot_df").isNull()).select("term", "chunk_id", "freq").join(rated.where(F.col("q") <= hot_share), "term")
    records = frequent.unionByName(rare).groupBy("chunk_id").agg(F.collect_list(F.struct("term", "freq", "df", "q")).alias("terms"))

    def run(batches):
        for b in batches:
            lists = b.column(1)
            flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            if not len(flat):
                continue
            offsets -= offsets[0]
            freq, q = flat.field("freq").to_numpy().astype(np.float64), flat.field("q").to_numpy()
            prob = em(freq, q, offsets, weight)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(prob > 0, prob * np.log(prob / q), 0.0)
            owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
            t = pa.table({"o": owner, "p": prob, "r": freq / q, "term": flat.field("term")})
            order = pc.sort_indices(t, [("o", "ascending"), ("p", "descending"), ("r", "descending"), ("term", "ascending")]).to_numpy()
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order)) - np.repeat(offsets[:-1], np.diff(offsets)) + 1
            out = [b.column(0).take(pa.array(owner)), flat.field("term"), flat.field("freq"), flat.field("df"), pa.array(prob), pa.array(score), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(out, names=["chunk_id", "term", "freq", "df", "prob", "score", "rank"])

    return records.mapInArrow(run, "chunk_id bigint, term string, freq int, df bigint, prob double, score double, rank int")
