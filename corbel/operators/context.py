"""Context packs: ranked evidence under a byte budget, with its symbols and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corbel.functions.text import truncate_bytes
from corbel.operators.spans import first_container

ELLIPSIS = "…"


def fill_budget(hits: DataFrame, budget: int = 16_384, limit: int = 20, least: int = 32) -> DataFrame:
    """``(query_id, evidence, omitted)`` from ``hits(query_id, rank, chunk_id, path, symbol, start_line, end_line, text, sources)``.

    Evidence is taken in rank order while bytes remain; a text that does not fit is cut at a character and ends in an
    ellipsis, or skipped if fewer than ``least`` bytes remain. Each item has an id ``e1, e2, ...``, its place, the hash of
    the whole text, and whether it was cut. At most ``limit`` hits of a query are gathered, so a query is one small row.
    """
    cols = ["rank", "chunk_id", "path", "symbol", "start_line", "end_line", "text", "sources"]
    rows = hits.where((F.col("rank") <= limit) & (F.coalesce(F.col("text"), F.lit("")) != "")).dropDuplicates(["query_id", "chunk_id"])
    packed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("hits"))
    item = "struct<id:string,path:string,symbol:string,start_line:int,end_line:int,snippet:string,sha256:string,truncated:boolean,sources:array<string>>"
    start = F.struct(F.lit(budget).alias("left"), F.expr(f"cast(array() as array<{item}>)").alias("out"))

    def step(s: Column, h: Column) -> Column:
        size = F.octet_length(h["text"])
        fits = size <= s["left"]
        shown = F.when(fits, h["text"]).when(s["left"] >= least, F.concat(truncate_bytes(h["text"], s["left"] - 3), F.lit(ELLIPSIS)))
        row = F.struct(
            F.concat(F.lit("e"), (F.size(s["out"]) + 1).cast("string")).alias("id"),
            h["path"].alias("path"),
            h["symbol"].alias("symbol"),
            h["start_line"].alias("start_line"),
            h["end_line"].alias("end_line"),
            shown.alias("snippet"),
            F.sha2(h["text"], 256).alias("sha256"),
            (~fits).alias("truncated"),
            h["sources"].alias("sources"),
        )
        return F.when(shown.isNull() | (s["left"] <= 0), s).otherwise(F.struct((s["left"] - F.octet_length(shown)).alias("left"), F.concat(s["out"], F.array(row)).alias("out")))

    filled = packed.withColumn("__s", F.aggregate("hits", start, step))
    return filled.select("query_id", F.col("__s.out").alias("evidence"), (F.size("hits") - F.size("__s.out")).alias("omitted"))


def source_labels(sources: Column) -> Column:
    """``retriever#rank`` of each list a hit came from."""
    return F.transform(sources, lambda s: F.concat(s["retriever"], F.lit("#"), s["rank"].cast("string")))


def evidence_symbols(evidence: DataFrame, symbols: DataFrame, limit: int = 64) -> DataFrame:
    """Symbols that lie wholly in a citation's span of the same file: ``evidence(place, file_id, start_line, end_line)``; the first citation wins."""
    return first_container(evidence, symbols.select("id", "file_id", "start_line", "end_line").distinct(), "file_id", "place", "id", limit)
