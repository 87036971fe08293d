"""Snapshots on disk: Parquet tables partitioned by repository, replaced a repository at a time; JSON forms of indexes and reports."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corbel.operators.extract import FACTS
from corbel.operators.lookup import closed_set

SYMBOL_KINDS = ["module", "class", "function", "method", "variable"]
EDGE_KINDS = ["imports", "calls", "inherits", "implements"]

SCHEMAS = {
    "repos": "id bigint, root string, commit_sha string, indexed_at timestamp, embedding_provider string, embedding_model string",
    "files": "id bigint, repo_id bigint, path string, language string, content binary, content_hash string, module_name string",
    "symbols": "id bigint, repo_id bigint, file_id bigint, kind string, name string, qualified_name string, parent_id bigint, start_line int, end_line int, signature string, docstring string, temp_id int",
    "facts": FACTS,
    "edges": "id bigint, repo_id bigint, src bigint, dst bigint, kind string, confidence double",
    "unresolved_refs": "repo_id bigint, src bigint, name string, kind string, external boolean",
    "chunks": "id bigint, repo_id bigint, symbol_id bigint, file_id bigint, start_line int, end_line int, text string, context_header string, token_count int",
    "postings": "repo_id bigint, chunk_id bigint, term string, freq int",
    "doc_stats": "repo_id bigint, chunk_id bigint, length int",
    "vectors": "repo_id bigint, chunk_id bigint, model string, embedding array<float>",
}


def validated(name: str, df: DataFrame) -> DataFrame:
    """Closed sets and ranges, checked as the rows are written: a row outside stops the write."""
    if name == "symbols":
        return df.withColumn("kind", closed_set(F.col("kind"), SYMBOL_KINDS, "symbol kind"))
    if name in ("edges", "unresolved_refs"):
        df = df.withColumn("kind", closed_set(F.col("kind"), EDGE_KINDS, "edge kind"))
    if name == "edges":
        c = F.col("confidence")
        df = df.withColumn("confidence", F.when((c >= 0) & (c <= 1), c).otherwise(F.raise_error(F.lit("confidence out of range"))))
    return df


class Store:
    """Tables below one folder. ``replace`` swaps the partitions of the repositories in the rows, all or nothing each."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str, repo_id: int | None = None) -> DataFrame:
        """A table, or an empty one; a repository's rows come from its partition alone."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(name))
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return self.spark.createDataFrame([], SCHEMAS[name])
        df = self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))
        return df.where(F.col("repo_id") == repo_id) if repo_id is not None and "repo_id" in df.columns else df

    def replace(self, name: str, df: DataFrame) -> None:
        cols = StructType.fromDDL(SCHEMAS[name]).names
        w = validated(name, df).select(*cols).write.mode("overwrite")
        if "repo_id" in cols:
            w = w.partitionBy("repo_id").option("partitionOverwriteMode", "dynamic")
        w.parquet(self.path(name))

    def drop_repo(self, name: str, repo_id: int) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/repo_id={repo_id}")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(p):
            fs.delete(p, True)

    def next_id(self, name: str) -> int:
        return (self.read(name).agg(F.max("id")).first()[0] or 0) + 1


def save_index_json(maps: DataFrame, path: str, k1: float = 1.2, b: float = 0.75) -> None:
    """The lexical index in its document form, one JSON object for each chunk, parameters included."""
    maps.select(F.lit(k1).alias("k1"), F.lit(b).alias("b"), "chunk_id", "length", "term_freq").write.mode("overwrite").json(path)


def load_index_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(postings, doc_stats)`` rebuilt from the JSON form."""
    docs = spark.read.schema("k1 double, b double, chunk_id bigint, length int, term_freq map<string,int>").json(path)
    return docs.select("chunk_id", F.explode("term_freq").alias("term", "freq")), docs.select("chunk_id", "length")


def write_report(path: str, report: dict) -> None:
    """A small JSON report; its folder is made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, sort_keys=True, default=str)


Progress = Callable[[str, float], None]
