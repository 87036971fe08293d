"""Bounded state kept in tables: latest rows, eviction, expiry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENTS_PER_SESSION, CACHE_ENTRIES = 64, 256


def keep_latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``; the rest is dropped. Partial results are cut before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def keep_latest(rows: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of all."""
    return rows.orderBy(*order).limit(n)


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the largest by ``order``; combined before the shuffle, so a hot key is no hot task."""
    packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*order)).alias("__row"))
    return packed.select("__row.*")


def alive(rows: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    return rows.where(F.col(expires) > now)


def cache_get(cache: DataFrame, keys: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """``(hits, cache after)``: unexpired entries of the asked ``keys(cache_key)``, and the cache with their access time set."""
    asked = keys.select("cache_key").distinct()
    hits = alive(cache, now).join(asked, "cache_key", "left_semi")
    touched = cache.join(hits.select("cache_key", F.lit(True).alias("__hit")), "cache_key", "left")
    after = touched.withColumn("last_accessed_at", F.when(F.col("__hit"), now).otherwise(F.col("last_accessed_at"))).drop("__hit")
    return hits, after.select(*cache.columns)


def cache_put(cache: DataFrame, entries: DataFrame, limit: int = CACHE_ENTRIES) -> DataFrame:
    """Entries replace those of the same key; then the ``limit`` last accessed stay, ties by key."""
    merged = cache.join(entries.select("cache_key"), "cache_key", "left_anti").select(*cache.columns).unionByName(entries.select(*cache.columns))
    return keep_latest(merged, [F.col("last_accessed_at").desc(), F.col("cache_key")], limit)


def cleanup(sessions: DataFrame, events: DataFrame, cache: DataFrame, now: Column, max_sessions: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Expired cache entries and sessions go, then all but the newest ``max_sessions`` sessions, then events of none."""
    kept = keep_latest(alive(sessions, now), [F.col("updated_at").desc(), F.col("id")], max_sessions)
    return kept, events.join(kept.select(F.col("id").alias("session_id")), "session_id", "left_semi"), alive(cache, now)


def note(payload: Column, limit: int = 2000) -> Column:
    """A session note within its size; a longer one stops the query."""
    return F.when(F.octet_length(payload) > limit, F.raise_error(F.lit(f"note is larger than {limit} bytes"))).otherwise(payload)


def cache_key(*parts: Column) -> Column:
    """Hash of all that determines a cached result, parts kept apart by a zero byte."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
