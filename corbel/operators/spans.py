"""Joins on line spans: equality on the file (or path), then overlap, containment, or tightest cover.

Spark has no interval join, and equality on the file alone would compare everything in a large file with everything.
Spans are therefore placed in buckets of lines, at the coarsest level that a span fits into two buckets of; each side
meets only the levels and buckets of its file that its spans touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LEVELS = [64, 512, 4096, 32768, 1 << 31]


def _level(start: Column, end: Column) -> Column:
    """The first bucket width that is not smaller than the span."""
    out = F.lit(len(_LEVELS) - 1)
    for i in range(len(_LEVELS) - 2, -1, -1):
        out = F.when(end - start < _LEVELS[i], i).otherwise(out)
    return out


def _width(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w).cast("bigint") for w in _LEVELS]), level + 1)


def _own(df: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each of the at most two buckets of the span's own level."""
    d = df.withColumn("__lv", _level(F.col(start), F.col(end)))
    w = _width(F.col("__lv"))
    return d.withColumn("__bk", F.explode(F.sequence(F.floor(F.col(start) / w), F.floor(F.col(end) / w))))


def _all(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows for the buckets of all levels that the span touches; fine levels are given up for long spans' insides."""
    d = df.withColumn("__lv", F.explode(F.array(*[F.lit(i) for i in range(len(_LEVELS))])))
    w = _width(F.col("__lv"))
    return d.withColumn("__bk", F.explode(F.sequence(F.floor(F.col(start) / w), F.floor(F.col(end) / w))))


def _named(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{side}_{c}") for c in df.columns])


def overlap_join(left: DataFrame, right: DataFrame, key: str, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Pairs of rows (columns prefixed ``l_``, ``r_``) with equal keys whose inclusive spans share a line, each once.

    Rows with a null key or bound, or with swapped bounds, meet nothing.
    """
    fine = F.col(key).isNotNull() & (F.col(start) <= F.col(end))
    a = _all(_named(left.where(fine), "l"), f"l_{start}", f"l_{end}")
    b = _own(_named(right.where(fine), "r"), f"r_{start}", f"r_{end}").withColumnsRenamed({"__lv": "__rlv", "__bk": "__rbk"})
    on = (F.col(f"l_{key}") == F.col(f"r_{key}")) & (F.col("__lv") == F.col("__rlv")) & (F.col("__bk") == F.col("__rbk"))
    meet = (F.col(f"l_{start}") <= F.col(f"r_{end}")) & (F.col(f"r_{start}") <= F.col(f"l_{end}"))
    # A pair may meet in two buckets; it counts in the first common one.
    first = F.col("__bk") == F.floor(F.greatest(F.col(f"l_{start}"), F.col(f"r_{start}")) / _width(F.col("__lv")))
    return a.join(b, on).where(meet & first).drop("__lv", "__bk", "__rlv", "__rbk")


def containment_join(outer: DataFrame, inner: DataFrame, key: str, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Pairs whose right span lies wholly in the left one."""
    pairs = overlap_join(outer, inner, key, start, end)
    return pairs.where((F.col(f"l_{start}") <= F.col(f"r_{start}")) & (F.col(f"r_{end}") <= F.col(f"l_{end}")))


def first_container(outer: DataFrame, inner: DataFrame, key: str, order: str, inner_id: str = "id", limit: int | None = None) -> DataFrame:
    """For each inner row the first outer row, by ``order``, that contains it."""
    pairs = containment_join(outer, inner, key)
    w = Window.partitionBy(f"r_{inner_id}").orderBy(f"l_{order}")
    first = pairs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return first.orderBy(f"l_{order}", f"r_{inner_id}").limit(limit) if limit else first


def tightest_cover(inner: DataFrame, outer: DataFrame, key: str, inner_id: str = "id", outer_id: str = "id", start: str = "start_line", end: str = "end_line") -> DataFrame:
    """For each inner row (``r_``) the outer row (``l_``) with the shortest span around it; ties go to the larger start, then the smaller id."""
    pairs = containment_join(outer, inner, key, start, end)
    w = Window.partitionBy(f"r_{inner_id}").orderBy(F.col(f"l_{end}") - F.col(f"l_{start}"), F.col(f"l_{start}").desc(), f"l_{outer_id}")
    return pairs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def partial_overlaps(left: DataFrame, right: DataFrame, key: str, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Pairs that overlap although neither contains the other."""
    p = overlap_join(left, right, key, start, end)
    ls, le, rs, re = (F.col(f"{s}_{c}") for s in "lr" for c in (start, end))
    return p.where(~((ls <= rs) & (re <= le)) & ~((rs <= ls) & (le <= re)))
