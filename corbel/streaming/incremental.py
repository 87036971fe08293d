"""Incremental indexing as a stream of file versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.operators.state import latest_per_key
from corbel.plans.indexing import Indexer
from corbel.session import cut
from corbel.sources.store import Store

COLUMNS = ["path", "language", "content", "content_hash", "module_name"]


def apply_versions(store: Store, versions: DataFrame, **options: object) -> None:
    """Bring every repository in ``versions(repo_id, path, ..., indexed_at)`` up to date: of each path the last version
    counts, a null content deletes it, paths not mentioned stay.

    A batch that is delivered twice changes nothing the second time, so the sink is idempotent.
    """
    last = cut(latest_per_key(versions.select("repo_id", *COLUMNS, "indexed_at"), ["repo_id", "path"], [F.col("indexed_at"), F.col("content_hash")]))
    for (repo_id,) in last.select("repo_id").distinct().collect():
        mine = last.where(F.col("repo_id") == repo_id)
        old = store.read("files", repo_id).select(*COLUMNS)
        merged = old.join(mine.select("path"), "path", "left_anti").select(*COLUMNS).unionByName(mine.where("content IS NOT NULL").select(*COLUMNS))
        Indexer(store, repo_id, **options).incremental(cut(merged))


def start(stream: DataFrame, store: Store, checkpoint: str, **options: object):
    """A streaming query that applies each batch of versions to the store."""
    return stream.writeStream.foreachBatch(lambda df, _: apply_versions(store, df, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
