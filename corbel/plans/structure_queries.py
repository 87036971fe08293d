"""Queries on graphs, lookups, spans, and snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.operators import context, cycles, fusion, graph, ingest, lookup, spans, state
from corbel.plans.registry import query
from corbel.plans.source_queries import resolved_edges
from corbel.plans.text_queries import RANKS, _lists, symbol_edges
from corbel.session import cut, table

# The edge stream of `events`: users point to the number in `props`; the type is the edge's kind.
EDGES = "edges AS (SELECT event_id AS id, user_id AS src, CAST(props ->> '$.k' AS BIGINT) AS dst, event_type AS kind, (event_id % 4 + 1) / 4 AS confidence FROM events)"
KIND, SURE = ("purchase", "signup"), 1.0
KEPT = f"{EDGES}, kept AS (SELECT * FROM edges WHERE kind IN ('purchase', 'signup') AND confidence >= 1.0 AND src IS NOT NULL AND dst IS NOT NULL)"


def edges_of(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("src"), k.alias("dst"), F.col("event_type").alias("kind"), ((F.col("event_id") % 4 + 1) / 4).alias("confidence"))


def _first(spark: SparkSession, d: str, n: int = 1) -> DataFrame:
    """The ``n`` smallest sources: the traversals' arguments."""
    return edges_of(spark, d).select(F.col("src").alias("id")).distinct().orderBy("id").limit(n)


def _walk(a: str, b: str, depth: int, starts: int = 1, links: str = "kept") -> str:
    """Recursive closure in DuckDB: the least depth of each node that a start reaches."""
    return f"""first AS (SELECT DISTINCT src AS id FROM edges ORDER BY 1 LIMIT {starts}),
        walk AS (SELECT id AS start, id AS node, 0 AS depth FROM first UNION SELECT w.start, e.{b}, w.depth + 1 FROM walk w JOIN {links} e ON e.{a} = w.node WHERE w.depth < {depth}),
        least AS (SELECT start, node, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY 1, 2 HAVING min(depth) > 0)"""


@query(f"WITH {EDGES} SELECT * FROM edges")
def edges_build(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(spark, d)


@query(f"WITH {EDGES} SELECT src, dst, kind, max(confidence) AS confidence, min(id) AS id FROM edges GROUP BY 1, 2, 3")
def edge_dedup_max_conf(spark: SparkSession, d: str) -> DataFrame:
    return graph.dedup_edges(edges_of(spark, d))


@query(f"WITH {EDGES} SELECT * FROM edges WHERE kind IN ('purchase', 'signup') AND confidence >= 0.75")
def edge_filter(spark: SparkSession, d: str) -> DataFrame:
    return lookup.edge_filter(edges_of(spark, d), KIND, 0.75)


@query(f"WITH RECURSIVE {KEPT}, {_walk('src', 'dst', 4)} SELECT node, depth FROM least")
def callees(spark: SparkSession, d: str) -> DataFrame:
    return graph.callees(edges_of(spark, d), _first(spark, d), 4, KIND, SURE).select("node", "depth")


@query(f"WITH RECURSIVE {KEPT}, {_walk('dst', 'src', 1, 3)} SELECT start, node, depth FROM least")
def callers_depth1(spark: SparkSession, d: str) -> DataFrame:
    """References to three nodes."""
    return graph.traverse(edges_of(spark, d), _first(spark, d, 3), 1, True, KIND, SURE).select("start", "node", "depth")


@query(f"WITH RECURSIVE {EDGES}, kept AS (SELECT * FROM edges WHERE kind IN ('purchase', 'error') AND confidence >= 1.0 AND src IS NOT NULL AND dst IS NOT NULL), {_walk('dst', 'src', 3, 5)} SELECT start, node, depth FROM least")
def callers_with_override(spark: SparkSession, d: str) -> DataFrame:
    """The kind filter and always overriding methods; error events stand for the latter."""
    named = edges_of(spark, d).withColumn("kind", F.when(F.col("kind") == "error", graph.OVERRIDES).otherwise(F.col("kind")))
    return graph.callers(named, _first(spark, d, 5), 3, ("purchase",), SURE).select("start", "node", "depth")


@query(f"WITH RECURSIVE {KEPT}, {_walk('dst', 'src', 6)} SELECT node, depth FROM least")
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    return graph.blast_radius(edges_of(spark, d), _first(spark, d), 6, KIND, SURE).select("node", "depth")


@query(f"WITH RECURSIVE {KEPT}, {_walk('dst', 'src', 6)} SELECT start, depth, count(*) AS reached FROM least GROUP BY 1, 2")
def blast_radius_by_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.depth_histogram(graph.blast_radius(edges_of(spark, d), _first(spark, d), 6, KIND, SURE))


@query(f"WITH RECURSIVE {KEPT}, {_walk('dst', 'src', 3, 4)} SELECT node, min(depth) AS depth, arg_min(start, depth * 1000000 + start) AS start FROM least GROUP BY 1")
def blast_radius_multi(spark: SparkSession, d: str) -> DataFrame:
    return graph.affected(graph.blast_radius(edges_of(spark, d), _first(spark, d, 4), 3, KIND, SURE))


@query(f"""WITH RECURSIVE {KEPT}, {_walk('dst', 'src', 3, 2)},
    last AS (SELECT l.start, l.node, l.depth, max(e.confidence) AS confidence FROM least l JOIN kept e ON e.src = l.node JOIN (SELECT start, node, depth FROM least UNION ALL SELECT id, id, 0 FROM first) p ON p.start = l.start AND p.node = e.dst AND p.depth = l.depth - 1 GROUP BY 1, 2, 3),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY start ORDER BY depth, confidence DESC, node) AS INT) AS place, count(*) OVER (PARTITION BY start) AS total FROM last)
    SELECT start, place, node, depth, confidence, total, total > 10 AS truncated FROM r WHERE place <= 10""")
def traversal_shape(spark: SparkSession, d: str) -> DataFrame:
    s = graph.shape(graph.blast_radius(edges_of(spark, d), _first(spark, d, 2), 3, KIND, SURE), 10)
    return s.select("start", "place", "node", "depth", "confidence", "total", "truncated")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT parent_id AS src, id AS dst FROM symbols WHERE parent_id IS NOT NULL),
    walk AS (SELECT DISTINCT id AS start, id AS node, 0 AS depth FROM symbols WHERE kind = 'module' UNION SELECT w.start, e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.node WHERE w.depth < 5)
    SELECT start, node, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY 1, 2 HAVING min(depth) > 0""")
def module_members(spark: SparkSession, d: str) -> DataFrame:
    """What every module holds, directly or not: all modules are starts of one traversal."""
    s = table(spark, d, "symbols")
    e = symbol_edges(spark, d).select(F.col("dst").alias("id"), "src", "dst", F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"))
    return graph.callees(e, s.where("kind = 'module'").select("id"), 5).select("start", "node", "depth")


@query(f"WITH {EDGES}, ids AS (SELECT DISTINCT src AS id FROM edges ORDER BY 1 LIMIT 5) SELECT id, src, dst, kind, confidence FROM edges WHERE src IN (FROM ids) OR dst IN (FROM ids) ORDER BY id LIMIT 32")
def evidence_relationships(spark: SparkSession, d: str) -> DataFrame:
    return graph.relationships_of(_first(spark, d, 5), edges_of(spark, d)).select("id", "src", "dst", "kind", "confidence")


@query(f"WITH {EDGES}, s AS (SELECT DISTINCT src AS id FROM edges ORDER BY 1 LIMIT 20) SELECT e.id, e.src, e.dst FROM edges e WHERE src IN (FROM s) AND dst IN (FROM s) ORDER BY id LIMIT 10000")
def graph_projection(spark: SparkSession, d: str) -> DataFrame:
    nodes = edges_of(spark, d).select(F.col("src").alias("id"), F.lit("user").alias("kind"), F.col("src").cast("string").alias("qualified_name"))
    return lookup.graph_projection(nodes, edges_of(spark, d), None, 20)[1].select("id", "src", "dst")


@query(f"WITH {EDGES}, s AS (SELECT DISTINCT src AS id FROM edges ORDER BY 1 LIMIT 3) SELECT id, 'in' AS side FROM edges WHERE dst IN (FROM s) UNION ALL SELECT id, 'out' FROM edges WHERE src IN (FROM s)")
def edges_direct(spark: SparkSession, d: str) -> DataFrame:
    """Edges of any kind into and out of three nodes."""
    e, ids = edges_of(spark, d), _first(spark, d, 3)
    return lookup.callers_of(e, ids).select("id", F.lit("in").alias("side")).unionByName(lookup.callees_of(e, ids).select("id", F.lit("out").alias("side")))


@query(f"""WITH RECURSIVE {EDGES}, kept AS (SELECT * FROM edges WHERE kind = 'purchase' AND src IS NOT NULL AND dst IS NOT NULL), first AS (SELECT DISTINCT src AS id FROM edges ORDER BY 1 LIMIT 1),
    up AS (SELECT id AS node, 0 AS depth FROM first UNION SELECT e.src, depth + 1 FROM up JOIN kept e ON e.dst = node WHERE depth < 2), down AS (SELECT id AS node, 0 AS depth FROM first UNION SELECT e.dst, depth + 1 FROM down JOIN kept e ON e.src = node WHERE depth < 2)
    SELECT 'callers' AS direction, node, CAST(min(depth) AS INT) AS depth FROM up GROUP BY 2 HAVING min(depth) > 0 UNION ALL SELECT 'callees', node, CAST(min(depth) AS INT) FROM down GROUP BY 2 HAVING min(depth) > 0""")
def call_graph(spark: SparkSession, d: str) -> DataFrame:
    """Both directions over one kind of edge, which stands for calls."""
    e = edges_of(spark, d).withColumn("kind", F.when(F.col("kind") == "purchase", "calls").otherwise(F.col("kind")))
    return graph.call_graph(e, _first(spark, d), 2).select("direction", "node", "depth")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT parent_id AS src, id AS dst FROM symbols WHERE parent_id IS NOT NULL), m AS (SELECT DISTINCT id FROM symbols WHERE kind = 'module'),
    walk AS (SELECT id AS start, id AS node, 0 AS depth FROM m UNION SELECT w.start, e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.node WHERE w.depth < 5),
    hit AS (SELECT DISTINCT node FROM walk WHERE depth > 0) SELECT s.file_id, count(DISTINCT s.id) AS affected FROM hit JOIN symbols s ON s.id = hit.node GROUP BY 1""")
def affected_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Everything below any module, counted for each file."""
    s = table(spark, d, "symbols")
    e = symbol_edges(spark, d).select(F.col("dst").alias("id"), "src", "dst", F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"))
    reached = graph.affected(graph.callees(e, s.where("kind = 'module'").select("id"), 5))
    return graph.by_file(reached, s).select("file_id", "affected")


CLOSURE = f"""{KEPT}, n AS (SELECT DISTINCT src, dst FROM kept),
    reach AS (SELECT src, dst FROM n UNION SELECT r.src, n.dst FROM reach r JOIN n ON n.src = r.dst),
    scc AS (SELECT a.src AS node, max(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)"""


def _components(spark: SparkSession, d: str) -> DataFrame:
    return cycles.components(edges_of(spark, d), KIND, SURE)


@query(f"WITH RECURSIVE {CLOSURE} SELECT node, component FROM scc")
def scc_components(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d)


@query(f"""WITH RECURSIVE {CLOSURE}, walk AS (SELECT s.component, n.src AS start, n.dst AS node, 1 AS length FROM n JOIN scc s ON s.node = n.src UNION SELECT w.component, w.start, n.dst, w.length + 1 FROM walk w JOIN n ON n.src = w.node WHERE w.length < 6 AND w.node <> w.start)
    SELECT component, CAST(min(length) AS INT) AS length FROM walk WHERE start = node GROUP BY 1""")
def cycles_shortest(spark: SparkSession, d: str) -> DataFrame:
    return cycles.shortest_cycles(edges_of(spark, d), _components(spark, d), KIND, SURE).select("component", "length")


@query(f"""WITH RECURSIVE {CLOSURE} SELECT min(node) AS first, count(*) AS size, list_slice(list_sort(list(node)), 1, 20) AS members, greatest(count(*) - 20, 0) AS members_omitted FROM scc GROUP BY component ORDER BY size DESC, first LIMIT 20""")
def cycle_report(spark: SparkSession, d: str) -> DataFrame:
    parts = _components(spark, d)
    return cycles.cycle_report(parts, cycles.shortest_cycles(edges_of(spark, d), parts, KIND, SURE)).drop("cycle")


def _whole(suffix: str, edges: Callable[[SparkSession, str], DataFrame]) -> None:
    """The traversals and cycles above over every edge, of all kinds and any confidence.

    Their SQL takes a sparse part of the edges, as a recursive closure can't be had for all; these have none.
    """

    def first(e: DataFrame, n: int = 1) -> DataFrame:
        return e.select(F.col("src").alias("id")).where("id IS NOT NULL").distinct().orderBy("id").limit(n)

    def report(e: DataFrame) -> DataFrame:
        parts = cut(cycles.components(e))
        return cycles.cycle_report(parts, cycles.shortest_cycles(e, parts))

    makers = {
        "callees": lambda e: graph.callees(e, first(e), 4).select("node", "depth"),
        "callers_depth1": lambda e: graph.traverse(e, first(e, 3), 1, True).select("start", "node", "depth"),
        "callers_with_override": lambda e: graph.callers(e, first(e, 5), 3).select("start", "node", "depth"),
        "blast_radius": lambda e: graph.blast_radius(e, first(e), 6, ()).select("node", "depth"),
        "blast_radius_by_depth": lambda e: graph.depth_histogram(graph.blast_radius(e, first(e), 6, ())),
        "blast_radius_multi": lambda e: graph.affected(graph.blast_radius(e, first(e, 4), 3, ())),
        "traversal_shape": lambda e: graph.shape(graph.blast_radius(e, first(e, 2), 3, ()), 10).select("start", "place", "node", "depth", "confidence", "total", "truncated"),
        "scc_components": lambda e: cycles.components(e),
        "cycles_shortest": lambda e: cycles.shortest_cycles(e, cut(cycles.components(e))).select("component", "length"),
        "cycle_report": lambda e: report(e).drop("cycle"),
    }
    for name, make in makers.items():

        def run(spark: SparkSession, d: str, make=make) -> DataFrame:
            return make(cut(edges(spark, d)))

        run.__name__ = f"{name}_{suffix}"
        run.__doc__ = f"{name} over all edges."
        query(None)(run)


_whole("all", edges_of)
_whole("resolved", resolved_edges)


NAMES = r"names AS (SELECT DISTINCT query_id || ':' || w AS query_id, w AS name FROM (SELECT query_id, unnest(regexp_extract_all(query_text, '[\w.]*\w')) AS w FROM eval_queries))"
FOUND = f"""{NAMES}, sym AS (SELECT DISTINCT id, file_id, start_line, name, qualified_name FROM symbols),
    q AS (SELECT n.query_id, s.*, 'qualified' AS match FROM names n JOIN sym s ON s.qualified_name = n.name),
    b AS (SELECT n.query_id, s.*, 'bare' AS match FROM names n JOIN sym s ON s.name = n.name WHERE n.query_id NOT IN (SELECT query_id FROM q)),
    found AS (FROM q UNION ALL FROM b)"""


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Every word of every query as a name to look up."""
    w = table(spark, d, "eval_queries").select("query_id", F.explode(F.regexp_extract_all("query_text", F.lit(r"[\w.]*\w"), F.lit(0))).alias("name"))
    return w.select(F.concat("query_id", F.lit(":"), "name").alias("query_id"), "name").distinct()


def _found(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").select("id", "file_id", "start_line", "name", "qualified_name").distinct()
    return lookup.find_definition(s, _names(spark, d))


@query(f"WITH {FOUND} SELECT query_id, id, match FROM found")
def find_definition(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("query_id", "id", "match")


@query(f"WITH {FOUND} SELECT query_id, count(*) AS candidates, CASE WHEN count(*) = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, CAST(least(count(*), 10) AS INT) AS shown FROM found GROUP BY 1")
def resolve_symbol(spark: SparkSession, d: str) -> DataFrame:
    return lookup.describe_candidates(_found(spark, d)).select("query_id", "candidates", "outcome", F.size("shown").alias("shown"))


@query("""WITH n AS (SELECT DISTINCT qualified_name AS name FROM symbols WHERE kind = 'class'), s AS (SELECT DISTINCT id, file_id, start_line, qualified_name FROM symbols),
    r AS (SELECT n.name, s.id, row_number() OVER (PARTITION BY n.name ORDER BY file_id, start_line, id) AS r FROM n JOIN s ON s.qualified_name = n.name) SELECT name, id FROM r WHERE r = 1""")
def find_by_qualified_name(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").select("id", "file_id", "start_line", "qualified_name", "kind").distinct()
    asked = s.where("kind = 'class'").select(F.col("qualified_name").alias("query_id"), F.col("qualified_name").alias("name")).distinct()
    return lookup.find_by_qualified_name(s, asked).select(F.col("query_id").alias("name"), "id")


@query(f"""WITH {RANKS} SELECT p.query_id, p.retriever, p.rank, p.chunk_id, s.qualified_name, f.path FROM placed p JOIN chunks c ON c.id = p.chunk_id LEFT JOIN (SELECT DISTINCT id, qualified_name FROM symbols) s ON s.id = c.symbol_id LEFT JOIN files f ON f.id = c.file_id""")
def hydrate_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = _lists(spark, d).select("query_id", "retriever", "rank", "chunk_id")
    return lookup.hydrate_hits(hits, table(spark, d, "chunks"), table(spark, d, "symbols"), table(spark, d, "files")).select("query_id", "retriever", "rank", "chunk_id", "qualified_name", "path")


@query("SELECT i.id, s.name, s.kind FROM (SELECT DISTINCT symbol_id AS id FROM chunks WHERE symbol_id IS NOT NULL UNION SELECT DISTINCT -id FROM files) i LEFT JOIN (SELECT DISTINCT id, name, kind FROM symbols) s USING (id)")
def left_outer_refs(spark: SparkSession, d: str) -> DataFrame:
    """Ids with their symbols; ids nobody knows stay."""
    known = table(spark, d, "chunks").where("symbol_id IS NOT NULL").select(F.col("symbol_id").alias("id"))
    ids = known.unionByName(table(spark, d, "files").select((-F.col("id")).alias("id")))
    return lookup.refs_by_id(ids, table(spark, d, "symbols")).select("id", "name", "kind")


@query("SELECT DISTINCT s.id, f.repo_id FROM symbols s JOIN files f ON f.id = s.file_id")
def repo_scope(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol with its repository."""
    return lookup.of_repo(table(spark, d, "symbols"), table(spark, d, "files")).select("id", "repo_id").distinct()


SPAN = "span_c AS (SELECT id, file_id, least(start_line, end_line) AS s, greatest(start_line, end_line) AS e FROM chunks), span_s AS (SELECT DISTINCT id, file_id, start_line AS s, end_line AS e, kind FROM symbols WHERE start_line <= end_line)"


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "chunks").select("id", "file_id", F.least("start_line", "end_line").alias("start_line"), F.greatest("start_line", "end_line").alias("end_line"))
    return c, table(spark, d, "symbols").select("id", "file_id", "start_line", "end_line", "kind").distinct()


@query(f"WITH {SPAN} SELECT c.id AS chunk_id, s.id AS symbol_id FROM span_c c JOIN span_s s ON c.file_id = s.file_id AND c.s <= s.e AND s.s <= c.e")
def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    return spans.overlap_join(*_spans(spark, d), "file_id").select(F.col("l_id").alias("chunk_id"), F.col("r_id").alias("symbol_id"))


@query(f"WITH {SPAN} SELECT s.id AS symbol_id, min(c.id) AS chunk_id FROM span_c c JOIN span_s s ON c.file_id = s.file_id AND c.s <= s.s AND s.e <= c.e GROUP BY 1")
def containment_first_match(spark: SparkSession, d: str) -> DataFrame:
    return spans.first_container(*_spans(spark, d), "file_id", "id").select(F.col("r_id").alias("symbol_id"), F.col("l_id").alias("chunk_id"))


@query(f"WITH {SPAN}, r AS (SELECT c.id AS chunk_id, s.id AS symbol_id, row_number() OVER (PARTITION BY c.id ORDER BY s.e - s.s, s.s DESC, s.id) AS n FROM span_c c JOIN span_s s ON c.file_id = s.file_id AND s.s <= c.s AND c.e <= s.e) SELECT chunk_id, symbol_id FROM r WHERE n = 1")
def tightest_span(spark: SparkSession, d: str) -> DataFrame:
    c, s = _spans(spark, d)
    return spans.tightest_cover(c, s, "file_id").select(F.col("r_id").alias("chunk_id"), F.col("l_id").alias("symbol_id"))


@query(f"WITH {SPAN} SELECT c.id AS chunk_id, s.id AS symbol_id FROM span_c c JOIN span_s s ON c.file_id = s.file_id AND c.s <= s.e AND s.s <= c.e WHERE NOT (c.s <= s.s AND s.e <= c.e) AND NOT (s.s <= c.s AND c.e <= s.e)")
def partial_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return spans.partial_overlaps(*_spans(spark, d), "file_id").select(F.col("l_id").alias("chunk_id"), F.col("r_id").alias("symbol_id"))


# Snapshots: the older and the newer one of each root.
SNAPSHOTS = """pairs AS (SELECT root, arg_min(id, indexed_at) AS a, arg_max(id, indexed_at) AS b FROM repos GROUP BY 1 HAVING count(*) > 1),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY indexed_at DESC, id DESC) AS r FROM files) WHERE r = 1)"""


def _latest_files(spark: SparkSession, d: str) -> DataFrame:
    return state.latest_per_key(table(spark, d, "files").select("id", "repo_id", "path", "content_hash", "indexed_at"), ["repo_id", "path"], [F.col("indexed_at"), F.col("id")])


@query(f"""WITH {SNAPSHOTS}, o AS (SELECT p.root, f.* FROM pairs p JOIN one f ON f.repo_id = p.a), n AS (SELECT p.root, f.* FROM pairs p JOIN one f ON f.repo_id = p.b)
    SELECT coalesce(o.root, n.root) AS root, coalesce(o.path, n.path) AS path, o.id AS old_id, n.id AS new_id,
    CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'deleted' WHEN o.content_hash IS NOT DISTINCT FROM n.content_hash THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.root = n.root AND o.path = n.path""")
def file_diff(spark: SparkSession, d: str) -> DataFrame:
    """The older against the newer snapshot of every root."""
    r = table(spark, d, "repos").groupBy("root").agg(F.min_by("id", "indexed_at").alias("a"), F.max_by("id", "indexed_at").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    f = _latest_files(spark, d)
    side = lambda c: f.join(r.select(F.col(c).alias("repo_id"), "root"), "repo_id")
    return ingest.file_diff(side("a"), side("b"), ["root", "path"]).select("root", "path", "old_id", "new_id", "status")


@query("SELECT id, repo_id FROM files WHERE id NOT IN (SELECT file_id FROM chunks WHERE file_id IS NOT NULL)")
def backfill_missing_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ingest.unchunked(table(spark, d, "files"), table(spark, d, "chunks")).select("id", "repo_id")


@query("""WITH r AS (SELECT id, repo_id, path, content_hash, indexed_at, row_number() OVER (PARTITION BY repo_id, path ORDER BY indexed_at, id) AS up, row_number() OVER (PARTITION BY repo_id, path ORDER BY indexed_at DESC, id DESC) AS down FROM files)
    SELECT a.id, a.repo_id, a.path, b.content_hash FROM r a JOIN r b ON a.repo_id = b.repo_id AND a.path = b.path WHERE a.up = 1 AND b.down = 1""")
def upsert_files(spark: SparkSession, d: str) -> DataFrame:
    """The last of all versions over the first one: the id stays, the content is new."""
    f = table(spark, d, "files").select("id", "repo_id", "path", "content_hash", "indexed_at")
    first = f.groupBy("repo_id", "path").agg(F.min_by(F.struct("id", "content_hash", "indexed_at"), F.struct("indexed_at", "id")).alias("x")).select("x.id", "repo_id", "path", "x.content_hash", "x.indexed_at")
    return ingest.upsert(first, _latest_files(spark, d).select(*first.columns), ["repo_id", "path"]).select("id", "repo_id", "path", "content_hash")


@query("""WITH gone AS (SELECT id FROM files WHERE repo_id = 1), lost AS (SELECT id FROM chunks WHERE file_id IN (FROM gone))
    SELECT 'files' AS t, count(*) AS n FROM files WHERE id NOT IN (FROM gone) UNION ALL SELECT 'symbols', count(*) FROM symbols WHERE file_id NOT IN (FROM gone)
    UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE file_id NOT IN (FROM gone) UNION ALL SELECT 'postings', count(*) FROM postings WHERE chunk_id NOT IN (FROM lost) UNION ALL SELECT 'vectors', count(*) FROM vectors WHERE chunk_id NOT IN (FROM lost)""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Row counts after all files of one repository are deleted."""
    tables = {t: table(spark, d, t) for t in ("files", "symbols", "chunks", "postings", "vectors")}
    left = ingest.cascade_delete(tables, tables["files"].where("repo_id = 1").select("id"))
    out = None
    for t, df in left.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT repo_id, path, count(*) AS rows FROM files GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return ingest.duplicates(table(spark, d, "files"), ["repo_id", "path"])


@query("SELECT id, CAST(row_number() OVER (ORDER BY file_id, start_line, id) AS BIGINT) AS new_id FROM (SELECT DISTINCT id, file_id, start_line FROM symbols)")
def global_ids(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").select("id", "file_id", "start_line").distinct()
    return ingest.global_ids(s, ["file_id", "start_line", "id"], out="new_id").select("id", "new_id")


@query("""WITH s AS (SELECT DISTINCT id, file_id, start_line, parent_id FROM symbols), n AS (SELECT id, file_id, parent_id, CAST(row_number() OVER (ORDER BY file_id, start_line, id) AS BIGINT) AS new_id FROM s)
    SELECT n.new_id AS id, p.new_id AS parent_id FROM n LEFT JOIN n p ON p.id = n.parent_id AND p.file_id = n.file_id""")
def remap_parents(spark: SparkSession, d: str) -> DataFrame:
    """Symbols under new ids, their parents under theirs."""
    s = table(spark, d, "symbols").select(F.col("id").alias("temp_id"), "file_id", "start_line", F.col("parent_id").alias("temp_parent")).distinct()
    return ingest.remap_parents(ingest.global_ids(s, ["file_id", "start_line", "temp_id"])).select("id", "parent_id")


@query("""WITH c AS (SELECT DISTINCT chunk_id, term, freq FROM postings WHERE repo_id = 1) SELECT DISTINCT chunk_id, term, freq FROM postings WHERE repo_id <> 1 AND chunk_id NOT IN (SELECT chunk_id FROM c) UNION SELECT chunk_id, term, 2 * freq FROM c""")
def reindex_postings(spark: SparkSession, d: str) -> DataFrame:
    """Postings of one repository replaced by later ones."""
    from corbel.operators import bm25

    p = table(spark, d, "postings").select("repo_id", "chunk_id", "term", "freq").distinct()
    later = p.where("repo_id = 1").select("chunk_id", "term", (2 * F.col("freq")).alias("freq"))
    return bm25.reindex(p.drop("repo_id"), later)


@query("SELECT DISTINCT chunk_id, model FROM vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0")
def usable_vectors(spark: SparkSession, d: str) -> DataFrame:
    from corbel.functions import vectors

    return table(spark, d, "vectors").where(vectors.usable(F.col("embedding"), 64)).select("chunk_id", "model").distinct()


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 64")
def session_keep_latest(spark: SparkSession, d: str) -> DataFrame:
    return state.keep_latest_per_key(table(spark, d, "events"), ["user_id"], [F.col("event_id").desc()], state.EVENTS_PER_SESSION).select("event_id", "user_id")


CACHE = "cache AS (SELECT sha256(query_text) AS cache_key, max(asked_at) AS last_accessed_at FROM eval_queries WHERE query_text IS NOT NULL GROUP BY 1)"


@query(f"WITH {CACHE} SELECT cache_key, last_accessed_at FROM cache ORDER BY last_accessed_at DESC, cache_key LIMIT 256")
def cache_evict_lru(spark: SparkSession, d: str) -> DataFrame:
    """All queries put into a cache of 256 entries."""
    e = table(spark, d, "eval_queries").where("query_text IS NOT NULL").groupBy(F.sha2("query_text", 256).alias("cache_key")).agg(F.max("asked_at").alias("last_accessed_at"))
    return state.cache_put(e.limit(0), e)


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type FROM events GROUP BY 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return state.latest_per_key(table(spark, d, "events").select("user_id", "ts", "event_type"), ["user_id"], [F.col("ts")])


@query("""WITH s AS (SELECT user_id AS id, max(ts) + INTERVAL 7 DAY AS expires_at, max(ts) AS updated_at FROM events GROUP BY 1), now AS (SELECT max(ts) + INTERVAL 6 DAY AS t FROM events),
    k AS (SELECT id FROM s, now WHERE expires_at > t ORDER BY updated_at DESC, id LIMIT 50) SELECT event_id, user_id AS session_id FROM events WHERE user_id IN (FROM k)""")
def cleanup_expired(spark: SparkSession, d: str) -> DataFrame:
    """Events left after expired sessions and all but the newest 50 are gone."""
    e = table(spark, d, "events")
    sessions = e.groupBy(F.col("user_id").alias("id")).agg((F.max("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"), F.max("ts").alias("updated_at"))
    now = e.agg(F.max("ts") + F.expr("INTERVAL 6 DAYS")).scalar()
    cache = sessions.select(F.col("id").cast("string").alias("cache_key"), "expires_at")
    return state.cleanup(sessions, e.select("event_id", F.col("user_id").alias("session_id")), cache, now, 50)[1].select("event_id", "session_id")


@query(f"""WITH {RANKS}, fused AS (SELECT query_id, chunk_id, round(sum((CASE WHEN weight IS NULL OR weight = 0 OR isnan(weight) THEN 1.0 ELSE weight END) / (60 + rank)), 9) AS score FROM placed GROUP BY 1, 2),
    t AS (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused f),
    h AS (SELECT t.query_id, t.rank, c.text FROM t JOIN chunks c ON c.id = t.chunk_id JOIN files f ON f.id = c.file_id WHERE rank <= 10 AND coalesce(c.text, '') <> '')
    SELECT query_id, count(*) AS evidence, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM h GROUP BY 1""")
def context_pack_whole(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of every query under a budget that holds all of it."""
    p = _packs(spark, d, 1 << 24)
    total = F.aggregate("evidence", F.lit(0).cast("bigint"), lambda a, e: a + F.octet_length(e["snippet"]))
    return p.select("query_id", F.size("evidence").cast("bigint").alias("evidence"), total.alias("bytes"))


def _packs(spark: SparkSession, d: str, budget: int) -> DataFrame:
    top = fusion.top_k(fusion.rrf(_lists(spark, d)), 10)
    c = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "file_id", "symbol_id", "start_line", "end_line", "text")
    s = table(spark, d, "symbols").select(F.col("id").alias("symbol_id"), F.col("qualified_name").alias("symbol")).distinct()
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), "path")
    hits = top.join(c, "chunk_id").join(f, "file_id").join(s, "symbol_id", "left").withColumn("sources", context.source_labels(F.col("sources")))
    return context.fill_budget(hits, budget)


@query(None)
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of every query under the default budget."""
    return _packs(spark, d, 16_384)


@query("SELECT id, CASE WHEN trim(embedding_provider) = '' OR embedding_provider IS NULL THEN 'unknown' ELSE trim(embedding_provider) END AS provider, CASE WHEN trim(embedding_model) = '' OR embedding_model IS NULL THEN 'unknown' ELSE trim(embedding_model) END AS model, left(sha256(root), 40) AS snapshot FROM repos")
def repo_provenance(spark: SparkSession, d: str) -> DataFrame:
    from corbel.functions.names import or_unknown, snapshot_id

    return table(spark, d, "repos").select("id", or_unknown(F.col("embedding_provider")).alias("provider"), or_unknown(F.col("embedding_model")).alias("model"), snapshot_id(F.col("root")).alias("snapshot"))


@query(r"SELECT id, replace(regexp_replace(regexp_replace(path, '\.py$', ''), '(^|/)__init__$', ''), '/', '.') AS module, lower(sha256(content)) AS hash, lower(sha256(content)) = content_hash AS same FROM files")
def file_scan_hash(spark: SparkSession, d: str) -> DataFrame:
    from corbel.functions.names import module_from_path

    h = F.sha2("content", 256)
    return table(spark, d, "files").select("id", module_from_path(F.col("path")).alias("module"), h.alias("hash"), (h == F.col("content_hash")).alias("same"))
