"""Snapshots of files: differences, upserts, cascading deletes, ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_diff(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """``(keys, status, old_id, new_id)``: added, changed, deleted or unchanged by ``content_hash``. Null hashes equal each other."""
    o = old.select(*keys, F.col("id").alias("old_id"), F.col("content_hash").alias("__o"))
    n = new.select(*keys, F.col("id").alias("new_id"), F.col("content_hash").alias("__n"))
    status = F.when(F.col("old_id").isNull(), "added").when(F.col("new_id").isNull(), "deleted").when(F.col("__o").eqNullSafe(F.col("__n")), "unchanged").otherwise("changed")
    return o.join(n, list(keys), "full_outer").select(*keys, status.alias("status"), "old_id", "new_id")


def unchunked(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files that have no chunk yet."""
    return files.join(chunks.select(F.col("file_id").alias("id")).distinct(), "id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ("id",)) -> DataFrame:
    """Old rows with new ones over them: by ``keys``, a new row's columns win, but a known row keeps its ``keep`` columns.

    Keys must be unique on either side (see :func:`corbel.operators.state.latest_per_key`); null keys match nothing.
    """
    o = old.select(*[F.col(c).alias(f"__o_{c}") if c not in keys else F.col(c) for c in old.columns], F.lit(True).alias("__old"))
    n = new.select(*old.columns, F.lit(True).alias("__new"))
    j = n.join(o, list(keys), "full_outer")

    def pick(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c in keep:
            return F.when(F.col("__old"), F.col(f"__o_{c}")).otherwise(F.col(c)).alias(c)
        return F.when(F.col("__new"), F.col(c)).otherwise(F.col(f"__o_{c}")).alias(c)

    return j.select(*[pick(c) for c in old.columns])


def cascade_delete(tables: dict[str, DataFrame], file_ids: DataFrame, keep_file: bool = False) -> dict[str, DataFrame]:
    """What is left of files, symbols, chunks, edges, unresolved_refs, postings and vectors without the given ``file_ids(id)``.

    Symbols and chunks go with their file, edges with either end, references with their source, postings and vectors
    with their chunk. ``keep_file`` deletes contents only.
    """
    gone = file_ids.select(F.col("id").alias("file_id")).distinct()
    out = dict(tables)
    if "files" in out and not keep_file:
        out["files"] = out["files"].join(gone.select(F.col("file_id").alias("id")), "id", "left_anti")
    for t in ("symbols", "chunks"):
        if t in out:
            out[t] = out[t].join(gone, "file_id", "left_anti")
    if "symbols" in tables:
        lost = tables["symbols"].join(gone, "file_id", "left_semi").select("id").distinct()
        if "edges" in out:
            for end in ("src", "dst"):
                out["edges"] = out["edges"].join(lost.select(F.col("id").alias(end)), end, "left_anti")
        if "unresolved_refs" in out:
            out["unresolved_refs"] = out["unresolved_refs"].join(lost.select(F.col("id").alias("src")), "src", "left_anti")
    if "chunks" in tables:
        lost = tables["chunks"].join(gone, "file_id", "left_semi").select(F.col("id").alias("chunk_id")).distinct()
        for t in ("postings", "vectors"):
            if t in out:
                out[t] = out[t].join(lost, "chunk_id", "left_anti")
    return {t: df.select(*tables[t].columns) for t, df in out.items()}


def delete_for_repo(rows: DataFrame, symbols: DataFrame, files: DataFrame, repo_id: int, end: str = "src") -> DataFrame:
    """Edges or references whose source symbol lies outside the repository."""
    own = files.where(F.col("repo_id") == repo_id).select(F.col("id").alias("file_id"))
    mine = symbols.join(own, "file_id", "left_semi").select(F.col("id").alias(end)).distinct()
    return rows.join(mine, end, "left_anti")


def global_ids(rows: DataFrame, order: Sequence[str], partitions: int | None = None, first: int = 1, out: str = "id") -> DataFrame:
    """Dense ids by a total order, without sorting everything in one task: ranges of the order are numbered in parallel.

    The same rows always get the same ids. ``order`` must be unique.
    """
    from corbel.session import cut

    spark = rows.sparkSession
    n = partitions or spark.sparkContext.defaultParallelism
    ranged = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    inner = Window.partitionBy("__p").orderBy(*order)
    return ranged.withColumn("__i", F.row_number().over(inner)).join(F.broadcast(starts), "__p").select(*rows.columns, (F.col("__before") + F.col("__i") + first - 1).alias(out))


def remap_parents(rows: DataFrame, scope: str = "file_id", temp: str = "temp_id", parent: str = "temp_parent", id_col: str = "id") -> DataFrame:
    """``parent_id`` from parents named by their temporary id in the same scope; a parent that does not exist stops the query."""
    p = rows.select(F.col(scope).alias("__s"), F.col(temp).alias("__t"), F.col(id_col).alias("__pid"))
    j = rows.join(p, (F.col(scope) == F.col("__s")) & (F.col(parent) == F.col("__t")), "left")
    orphan = F.col(parent).isNotNull() & F.col("__pid").isNull()
    return j.withColumn("parent_id", F.when(orphan, F.raise_error(F.lit("symbol without parent"))).otherwise(F.col("__pid"))).drop("__s", "__t", "__pid")


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that should be unique but are not, with their counts."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
