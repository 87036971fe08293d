"""Embedding as a column operation: contract, deterministic stand-in, cache, provenance."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corbel.session import cut

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def stand_in(texts: Sequence[str], dim: int = 64) -> np.ndarray:
    """Reproducible unit vectors: a 64-bit counter generator seeded by each text's hash, uniform in [-1, 1), normalised.

    Numbers are rounded to single precision before they are divided by the norm.
    """
    # Increment and multipliers of the public splitmix64 generator.
    gamma, m1, m2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
    state = np.array([int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big") for t in texts], np.uint64)
    out, total = np.empty((len(texts), dim), np.float32), np.zeros(len(texts))
    for i in range(dim):
        z = state + gamma
        z = (z ^ (z >> np.uint64(30))) * m1
        z = (z ^ (z >> np.uint64(27))) * m2
        state = z ^ (z >> np.uint64(31))  # the output is the next state
        f = (state >> np.uint64(11)).astype(np.float64) / 2.0**53 * 2 - 1
        out[:, i] = f
        total += f * f
    norm = np.sqrt(total).astype(np.float32)
    return out / np.where(norm > 0, norm, np.float32(1))[:, None]


class Retrying:
    """An embedder that repeats calls that failed for a passing reason: waits grow from ``first`` to ``most`` seconds, each
    drawn up to ``jitter`` off; after ``retries`` repetitions the error is raised."""

    def __init__(self, embedder: Embedder, retries: int = 5, first: float = 0.5, most: float = 30.0, jitter: float = 0.2, passing: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), sleep: Callable[[float], None] = time.sleep) -> None:
        self.embedder, self.retries, self.first, self.most, self.jitter, self.passing, self.sleep = embedder, retries, first, most, jitter, passing, sleep

    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[float]]:
        for turn in range(self.retries + 1):
            try:
                return self.embedder(texts)
            except self.passing:
                if turn == self.retries:
                    raise
                wait = min(self.most, self.first * 2**turn)
                self.sleep(wait * (1 + self.jitter * (2 * random.random() - 1)))
        raise AssertionError("unreachable")


def embed(rows: DataFrame, id_col: str, text_col: str, embedder: Embedder | None = None, dim: int = 64, batch: int = 128, unit: bool = False) -> DataFrame:
    """``(id_col, embedding array<float>)`` for every row with a text; null texts have a null vector.

    ``embedder`` maps a batch of texts to vectors in the same order; a wrong count, width, or a number that isn't finite
    stops the query. ``unit`` divides each vector by its norm; a zero vector then stops the query, too. For retries wrap
    the embedder in :class:`Retrying`; transport is its own.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    call = embedder or (lambda texts: stand_in(texts, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            out: list = [None] * len(texts)
            at = [i for i, t in enumerate(texts) if t is not None]
            for lo in range(0, len(at), batch):
                part = at[lo : lo + batch]
                got = np.asarray(call([texts[i] for i in part]), np.float32)
                if got.shape != (len(part), dim):
                    raise ValueError(f"embedder returned {got.shape} for {len(part)} texts of {dim} dimensions")
                if not np.isfinite(got).all():
                    raise ValueError("embedder returned a number that isn't finite")
                if unit:
                    norms = np.linalg.norm(got.astype(np.float64), axis=1, keepdims=True)
                    if (norms == 0).any():
                        raise ValueError("embedder returned a zero vector")
                    got = (got / norms).astype(np.float32)
                for i, v in zip(part, got, strict=True):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=[id_col, "embedding"])

    return rows.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, embedding array<float>")


def content_key(model: str, dim: int, text: Column) -> Column:
    """Cache key of a text's vector: model, width and text, kept apart by zero bytes."""
    return F.sha2(F.concat_ws("\x00", F.lit(model), F.lit(str(dim)), text), 256)


def embed_cached(rows: DataFrame, cache: DataFrame, id_col: str, text_col: str, model: str, embedder: Embedder | None = None, dim: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(vectors, cache additions)``: vectors from ``cache(key, embedding)`` where valid, the others computed once for each text.

    Null vectors and other widths in the cache are misses.
    """
    keyed = rows.select(id_col, F.col(text_col).alias("__t"), content_key(model, dim, F.col(text_col)).alias("key")).where(F.col("__t").isNotNull())
    good = cache.where(F.size("embedding") == dim).groupBy("key").agg(F.min("embedding").alias("embedding"))
    misses = keyed.select("key", "__t").distinct().join(good.select("key"), "key", "left_anti")
    fresh = cut(embed(misses, "key", "__t", embedder, dim))  # read twice, by the vectors and the cache, but asked for once
    vectors = keyed.join(good.unionByName(fresh), "key").select(id_col, "embedding")
    return vectors, fresh


def check_space(repos: pd.DataFrame | DataFrame, repo_id: int, provider: str, model: str) -> None:
    """Queries must be embedded as the snapshot was: fails unless provider and model equal the snapshot's."""
    row = repos.where(F.col("id") == repo_id).select("embedding_provider", "embedding_model").first()
    if row is None:
        raise ValueError(f"no snapshot {repo_id}")
    have = (row[0] or "unknown", row[1] or "unknown")
    if have != (provider or "unknown", model or "unknown"):
        raise ValueError(f"snapshot was embedded by {have}, not by {(provider, model)}")
