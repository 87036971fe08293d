"""Indexing a snapshot: full, and incremental by content hash. Each phase is one write; progress is told at its end."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.functions.text import embedding_text, truncate_to_tokens
from corbel.operators import bm25, extract, ingest
from corbel.operators.embedding import Embedder, check_space, embed
from corbel.session import cut
from corbel.sources.store import Progress, Store

LARGEST = 8192


def _shift(df: DataFrame, columns: list[str], by: int) -> DataFrame:
    return df.withColumns({c: F.col(c) + by for c in columns}) if by else df


class Indexer:
    """Writes the tables of :class:`corbel.sources.store.Store` for one repository snapshot."""

    def __init__(self, store: Store, repo_id: int, provider: str = "stand-in", model: str = "stand-in", embedder: Embedder | None = None, dim: int = 64, progress: Progress | None = None) -> None:
        self.store, self.repo_id, self.provider, self.model = store, repo_id, provider, model
        self.embedder, self.dim, self.progress = embedder, dim, progress or (lambda phase, seconds: None)
        self.seconds: dict[str, float] = {}

    def _phase(self, name: str, df: DataFrame) -> None:
        began = time.time()
        self.store.replace(name, df.withColumn("repo_id", F.lit(self.repo_id).cast("bigint")))
        if df.isEmpty():  # nothing to write leaves the old partition in place
            self.store.drop_repo(name, self.repo_id)
        self.seconds[name] = time.time() - began
        self.progress(name, self.seconds[name])

    def _resolve(self, facts: DataFrame, symbols: DataFrame) -> None:
        """References are always resolved anew over all files: a change in one may bind names in any other."""
        resolved = extract.resolve_snapshots(facts)
        first = self.store.next_id("edges")
        self._phase("edges", _shift(extract.edges_of(resolved, symbols), ["id"], first - 1))
        self._phase("unresolved_refs", extract.unresolved_of(resolved, symbols))

    def _lexical(self, chunks: DataFrame) -> None:
        self._phase("postings", bm25.inverted_index(chunks))
        self._phase("doc_stats", bm25.doc_stats(chunks))

    def _vectors(self, chunks: DataFrame, python: DataFrame) -> DataFrame:
        """Vectors of chunks of Python files; other text is indexed lexically only."""
        own = chunks.join(python.select(F.col("id").alias("file_id")), "file_id", "left_semi")
        text = truncate_to_tokens(embedding_text(F.col("context_header"), F.col("text")), LARGEST)
        return embed(own.select(F.col("id").alias("chunk_id"), text.alias("t")), "chunk_id", "t", self.embedder, self.dim).withColumn("model", F.lit(self.model))

    def full(self, files: DataFrame) -> dict[str, float]:
        """Replace everything of the snapshot by ``files(path, language, content, content_hash, module_name)``."""
        s = self.store
        numbered = ingest.global_ids(files.select("path", "language", "content", "content_hash", "module_name"), ["path"], first=s.next_id("files"))
        self._phase("files", numbered)
        stored = s.read("files", self.repo_id)
        first = s.next_id("symbols")
        self._phase("symbols", cut(_shift(extract.number_symbols(extract.extract_symbols(stored)), ["id", "parent_id"], first - 1)))
        self._phase("facts", extract.extract_facts(stored).drop("repo_id"))
        symbols = s.read("symbols", self.repo_id)
        self._resolve(s.read("facts", self.repo_id), symbols)
        first = s.next_id("chunks")
        self._phase("chunks", cut(_shift(extract.number_chunks(extract.extract_chunks(stored), symbols), ["id"], first - 1)))
        chunks = s.read("chunks", self.repo_id)
        self._vectors_phase(self._vectors(chunks, stored.where("language = 'python'")))
        self._lexical(chunks)
        return self.seconds

    def _vectors_phase(self, vectors: DataFrame) -> None:
        self._phase("vectors", cut(vectors))

    def incremental(self, files: DataFrame, repos: DataFrame | None = None) -> dict[str, int]:
        """Bring the snapshot to ``files``: only added and changed ones are parsed, cut and embedded again.

        Unchanged files keep their rows and ids; a changed file keeps its own id. Returns how many files were added,
        changed, deleted and unchanged. With ``repos`` the embedding space is checked first.
        """
        s = self.store
        if repos is not None:
            check_space(repos, self.repo_id, self.provider, self.model)
        old = s.read("files", self.repo_id)
        new = cut(ingest.global_ids(files.select("path", "language", "content", "content_hash", "module_name"), ["path"], first=s.next_id("files")))
        diff = cut(ingest.file_diff(old, new))
        tally = {r[0]: r[1] for r in diff.groupBy("status").count().collect()}
        if not set(tally) - {"unchanged"}:
            return {k: tally.get(k, 0) for k in ("added", "changed", "deleted", "unchanged")}
        fresh_paths = diff.where(F.col("status").isin("added", "changed"))
        gone = cut(diff.where(F.col("status").isin("changed", "deleted")).select(F.col("old_id").alias("id")))
        tables = {t: s.read(t, self.repo_id) for t in ("files", "symbols", "chunks", "vectors")}
        left = ingest.cascade_delete(tables, gone)
        kept_files = cut(left["files"])
        named = new.join(fresh_paths.select("path", F.coalesce("old_id", "new_id").alias("__id")), "path").withColumn("id", F.col("__id")).drop("__id")
        fresh = cut(named.withColumn("repo_id", F.lit(self.repo_id).cast("bigint")).select(*kept_files.columns))
        kept = {t: cut(left[t]) for t in ("symbols", "chunks", "vectors")}
        facts = cut(s.read("facts", self.repo_id).join(gone.select(F.col("id").alias("file_id")), "file_id", "left_anti"))
        first_symbol, first_chunk = s.next_id("symbols"), s.next_id("chunks")
        more = cut(_shift(extract.number_symbols(extract.extract_symbols(fresh)), ["id", "parent_id"], first_symbol - 1))
        more_chunks = cut(_shift(extract.number_chunks(extract.extract_chunks(fresh), more), ["id"], first_chunk - 1))
        more_vectors = cut(self._vectors(more_chunks, fresh.where("language = 'python'")))
        more_facts = cut(extract.extract_facts(fresh))
        add = lambda a, b: cut(a.drop("repo_id").unionByName(b.drop("repo_id")))
        self._phase("files", add(kept_files, fresh))
        self._phase("symbols", add(kept["symbols"], more))
        self._phase("facts", add(facts, more_facts))
        self._resolve(s.read("facts", self.repo_id), s.read("symbols", self.repo_id))
        self._phase("chunks", add(kept["chunks"], more_chunks))
        self._phase("vectors", add(kept["vectors"], more_vectors))
        self._lexical(s.read("chunks", self.repo_id))
        return {k: tally.get(k, 0) for k in ("added", "changed", "deleted", "unchanged")}
