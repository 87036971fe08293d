"""Retrieval metrics at a cutoff, against labelled line spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTOFF = 5


def label_matches(items: DataFrame, labels: DataFrame) -> DataFrame:
    """``(system, query_id, rank, label)``: items whose span overlaps a label's span in the same path of the same query.

    ``items(system, query_id, rank, path, start_line, end_line)``, ``labels(query_id, label, path, start_line, end_line)``.
    """
    i, j = items.alias("i"), labels.alias("l")
    on = (F.col("i.query_id") == F.col("l.query_id")) & (F.col("i.path") == F.col("l.path")) & (F.col("i.start_line") <= F.col("l.end_line")) & (F.col("l.start_line") <= F.col("i.end_line"))
    return i.join(j, on).select("i.system", "i.query_id", "i.rank", "l.label")


def query_metrics(items: DataFrame, labels: DataFrame, queries: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """``(system, query_id, precision, recall, reciprocal_rank)`` of every system and query with items.

    Only the first ``cutoff`` items count. Precision is relevant items / cutoff, however few there are; recall is distinct
    labels found / labels (0 without labels); the reciprocal rank is 0 if nothing relevant stands in the cutoff.
    """
    top = items.where(F.col("rank") <= cutoff)
    found = label_matches(top, labels).groupBy("system", "query_id").agg(F.countDistinct("rank").alias("hits"), F.countDistinct("label").alias("found"), F.min("rank").alias("first"))
    wanted = labels.groupBy("query_id").agg(F.countDistinct("label").alias("labels"))
    known = items.select("system", "query_id").distinct().join(queries.select("query_id").distinct(), "query_id", "left_semi")
    out = known.join(found, ["system", "query_id"], "left").join(wanted, "query_id", "left")
    recall = F.when(F.coalesce("labels", F.lit(0)) > 0, F.coalesce("found", F.lit(0)) / F.col("labels")).otherwise(F.lit(0.0))
    return out.select("system", "query_id", (F.coalesce("hits", F.lit(0)) / cutoff).alias("precision"), recall.alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def averages(metrics: DataFrame, queries: DataFrame, digits: int = 6) -> DataFrame:
    """``(system, query_type, queries, precision, recall, mrr)``: means by system, and by system and type (null: all types)."""
    typed = metrics.join(queries.select("query_id", F.coalesce("query_type", F.lit("")).alias("query_type")).distinct(), "query_id")
    mean = lambda c: F.round(F.avg(c), digits)
    return typed.groupingSets([["system"], ["system", "query_type"]], "system", "query_type").agg(F.count(F.lit(1)).alias("queries"), mean("precision").alias("precision"), mean("recall").alias("recall"), mean("reciprocal_rank").alias("mrr"))


def provenance(labels: DataFrame, column: str = "verification") -> DataFrame:
    """How many labels come from which source."""
    return labels.groupBy(column).agg(F.count(F.lit(1)).alias("labels"))


def verify_spans(labels: DataFrame, sources: DataFrame) -> DataFrame:
    """Labels with ``ok``: the path exists, the span lies in its lines, and not all of them are blank."""
    s = sources.select("path", F.split("text", "\n").alias("__lines"))
    j = labels.join(s, "path", "left")
    count = F.size("__lines")
    inside = (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")) & (F.col("end_line") <= count)
    lines = F.slice("__lines", F.greatest(F.col("start_line"), F.lit(1)), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)))
    return j.withColumn("ok", F.coalesce(inside & F.exists(lines, lambda x: F.trim(x) != ""), F.lit(False))).drop("__lines")


def best_items(lists: DataFrame, k: int = CUTOFF) -> DataFrame:
    """The first ``k`` items of each system and query, ranked anew by score, then id."""
    w = Window.partitionBy("system", "query_id").orderBy(F.col("score").desc(), "id")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
