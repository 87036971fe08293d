"""One object over an indexed snapshot: definition, references, callers, blast radius, cycles, search, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.operators import bm25, context, cycles, embedding, fusion, graph, lookup, vector
from corbel.sources.store import Store

# Defaults and limits of parameters.
LIMITS = {"limit": (10, 50), "depth": (3, 10), "results": (50, 500), "cycles": (10, 50)}


class Session:
    """Queries on one repository snapshot of a store. Tables are scoped by partition, so other snapshots can't leak in."""

    def __init__(self, spark: SparkSession, store: Store, repo_id: int, embedder: embedding.Embedder | None = None, dim: int = 64) -> None:
        self.spark, self.repo_id, self.embedder, self.dim = spark, repo_id, embedder, dim
        read = lambda t: store.read(t, repo_id)
        self.files, self.symbols, self.edges, self.chunks = read("files"), read("symbols"), read("edges"), read("chunks")
        self.postings, self.doc_stats, self.vectors, self.unresolved = read("postings"), read("doc_stats"), read("vectors"), read("unresolved_refs")
        self.notes: list[str] = []

    def _bound(self, name: str, value: int) -> int:
        out, note = lookup.bound(name, value, *LIMITS[name])
        self.notes += [note] if note else []
        return out

    def find_definition(self, name: str) -> DataFrame:
        return lookup.find_definition(self.symbols, self.spark.createDataFrame([(name, name)], "query_id string, name string"))

    def resolve(self, name: str | int) -> int:
        """The one symbol meant by an id or a name; otherwise an error that lists up to ten candidates."""
        if isinstance(name, int):
            if self.symbols.where(F.col("id") == name).isEmpty():
                raise LookupError(f"no symbol {name}")
            return name
        found = [(r.id, r.qualified_name) for r in self.find_definition(name).orderBy("file_id", "start_line", "id").limit(11).collect()]
        if len(found) == 1:
            return found[0][0]
        if not found:
            last = name.rsplit(".", 1)[-1].lower()
            near = [r[0] for r in self.symbols.where(F.lower("name").contains(last)).select("qualified_name").distinct().orderBy("qualified_name").limit(10).collect()]
            raise LookupError(f"no symbol {name!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
        raise LookupError(f"{name!r} is ambiguous: " + ", ".join(f"{q} ({i})" for i, q in found[:10]))

    def _start(self, name: str | int) -> DataFrame:
        return self.spark.createDataFrame([(self.resolve(name),)], "id long")

    def _shaped(self, paths: DataFrame, limit: int) -> DataFrame:
        s = self.symbols.select(F.col("id").alias("node"), "kind", "qualified_name", "file_id")
        f = self.files.select(F.col("id").alias("file_id"), "path")
        return graph.shape(paths, self._bound("results", limit)).join(s, "node", "left").join(f, "file_id", "left")

    def references(self, name: str | int, limit: int = 0) -> DataFrame:
        return self._shaped(graph.find_references(self.edges, self._start(name)), limit)

    def callers(self, name: str | int, depth: int = 0, limit: int = 0) -> DataFrame:
        return self._shaped(graph.callers(self.edges, self._start(name), self._bound("depth", depth), ("calls",)), limit)

    def callees(self, name: str | int, depth: int = 0, limit: int = 0) -> DataFrame:
        return self._shaped(graph.callees(self.edges, self._start(name), self._bound("depth", depth), ("calls",)), limit)

    def dependencies(self, name: str | int, depth: int = 1, limit: int = 0) -> DataFrame:
        return self._shaped(graph.dependencies(self.edges, self._start(name), depth), limit)

    def blast_radius(self, name: str | int, depth: int = 0, limit: int = 0) -> tuple[DataFrame, DataFrame]:
        """The nearest dependents, and how many there are at each depth (before the limit)."""
        paths = graph.blast_radius(self.edges, self._start(name), self._bound("depth", depth))
        return self._shaped(paths, limit), graph.depth_histogram(paths)

    def blast_radius_of_file(self, path: str, depth: int = 0) -> DataFrame:
        """What depends on any symbol of a file, by file."""
        own = self.symbols.join(self.files.where(F.col("path") == path).select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id")
        return graph.by_file(graph.affected(graph.blast_radius(self.edges, own, self._bound("depth", depth))), self.symbols)

    def cycles(self, kinds: tuple[str, ...] = ("imports",), min_confidence: float = 0.0, limit: int = 0) -> DataFrame:
        parts = cycles.components(self.edges, kinds, min_confidence)
        return cycles.cycle_report(parts, cycles.shortest_cycles(self.edges, parts, kinds, min_confidence), self._bound("cycles", limit))

    def search(self, text: str, limit: int = 0, boost: float = fusion.BOOST) -> DataFrame:
        """Hybrid search: lexical and vector lists, fused, boosted by graph adjacency (off at 0 or below), with places."""
        n = self._bound("limit", limit)
        asked = self.spark.createDataFrame([("q", text)], "query_id string, query_text string")
        lexical = lambda: bm25.search(self.postings, self.doc_stats, bm25.query_terms(asked), n)

        def near() -> DataFrame:
            q = embedding.embed(asked, "query_id", "query_text", self.embedder, self.dim).withColumn("scope", F.lit("all"))
            v = self.vectors.select(F.lit("all").alias("scope"), "chunk_id", "embedding")
            # The vector list carries no score of its own.
            return vector.knn(q, v, n, dim=self.dim).select("query_id", "rank", "chunk_id", F.lit(0.0).alias("score"))

        more = (lambda h: fusion.graph_boost(h, self.chunks, self.edges, boost)) if boost > 0 else None
        hits, failed = fusion.hybrid_search({"bm25": lexical, "vector": near}, n, boost=more)
        self.notes += [f"{name} failed" for name in failed]
        return lookup.hydrate_hits(hits, self.chunks, self.symbols, self.files)

    def context(self, question: str, evidence: int = 0, budget: int = 16_384) -> DataFrame:
        """A context pack for a question: evidence under a byte budget, with citations."""
        if not question.strip():
            raise ValueError("question is required")
        hits = self.search(question, min(evidence or 8, 20)).join(self.chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id")
        return context.fill_budget(hits.withColumnRenamed("qualified_name", "symbol").withColumn("sources", context.source_labels(F.col("sources"))), budget)
