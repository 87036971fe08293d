"""Positions inside groups, without one task per group.

A plain ``row_number() over (partition by key order by value)`` sends a whole group to one task. Here each
group is divided into cells that are ordered among themselves; only cell *counts* are summed over the group
(a few rows per group), and rows are numbered inside their own cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def double_cell(value: Column) -> Column:
    """A coarse, order-preserving cell of a double: the leading bits of its exponent and mantissa.

    Cells follow the magnitude, so outliers do not squeeze the remaining values into one cell. Null stays null;
    NaN falls into the highest cell; -0.0 and 0.0 share a cell.
    """
    v = F.when(value == 0, F.lit(0.0)).otherwise(value.cast("double"))
    # |v| = m * 2^e with 1 <= m < 2; the cell counts 2^5 steps for each power of two.
    e = F.floor(F.log2(F.abs(v)))
    m = F.floor((F.abs(v) / F.pow(F.lit(2.0), e) - 1) * 32)
    size = ((e + 1100) * 32 + F.greatest(F.lit(0), F.least(F.lit(31), m))).cast("long")
    top = F.lit(1 << 20)
    cell = F.when(v == 0, F.lit(0)).when(F.isnan(v), top).when(F.abs(v) == float("inf"), top - 1).otherwise(size)
    return F.when(value.isNull(), None).when(v < 0, -cell).otherwise(cell)


def group_positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cell: Column, out: str = "position") -> DataFrame:
    """Number the rows of each group from 1 in ``order``; ``cell`` must not decrease along ``order``.

    Ties beyond ``order`` get an unspecified but complete numbering, so give a total order. Rows with null keys
    form groups of their own, as in GROUP BY.
    """
    t = df.withColumn("__cell", cell)
    sizes = t.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(F.col("__cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__cell").alias("__kc"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__cell").orderBy(*order)
    numbered = t.withColumn("__in", F.row_number().over(inside))
    cond = F.col("__cell").eqNullSafe(F.col("__kc"))
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return numbered.join(offsets, cond).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + F.col("__in")).cast("long").alias(out))


def competition_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank", size: str = "group_size") -> DataFrame:
    """Mid-rank of every row of its group by ascending ``value`` (ties share their mean rank) and the group's size.

    Works on distinct values: counts are combined before the shuffle, so a group of many equal values is one row.
    Null values rank last, tied with each other; NaN before them.
    """
    v = df.withColumn("__v", F.col(value).cast("double"))
    counts = v.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n")).withColumn("__cell", F.coalesce(double_cell(F.col("__v")), F.lit(1 << 21)))
    cells = counts.groupBy(*keys, "__cell").agg(F.sum("__n").alias("__cn"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, "__cell", F.coalesce(F.sum("__cn").over(before), F.lit(0)).alias("__cb"), F.sum("__cn").over(whole).alias(size))
    inner = Window.partitionBy(*keys, "__cell").orderBy(F.col("__v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__vb", F.coalesce(F.sum("__n").over(inner), F.lit(0)))
    c, d = counts.alias("c"), cells.alias("d")
    on = F.col("c.__cell") == F.col("d.__cell")
    for k in keys:
        on = on & F.col(f"c.{k}").eqNullSafe(F.col(f"d.{k}"))
    ranks = c.join(d, on).select(*[F.col(f"c.{k}").alias(f"__k{i}") for i, k in enumerate(keys)], F.col("c.__v").alias("__rv"), (F.col("__cb") + F.col("__vb") + (F.col("__n") + 1) / 2).alias(out), F.col(size))
    on = F.col("__v").eqNullSafe(F.col("__rv"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return v.join(ranks, on).select(*[F.col(f"`{x}`") for x in df.columns], out, size)
