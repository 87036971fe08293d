"""Queries pN_... of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.llm import bpe, consensus, distinctive, documented, neighbours, packing, shared_spans, splitting, syntax
from corbel.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The most characteristic term of each probe chunk."""
    scored = distinctive.term_distinctiveness(table(spark, d, "postings"), table(spark, d, "bm25_docs"), table(spark, d, "term_probes"))
    return scored.where(F.col("rank") == 1).select("chunk_id", "term")


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all terms of all chunks, to eight places."""
    scored = distinctive.term_distinctiveness(table(spark, d, "postings"), table(spark, d, "bm25_docs"))
    return scored.withColumns({"prob": F.round("prob", 8), "score": F.round("score", 8)})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks that are close and among each other's ten most similar."""
    return neighbours.mutual_pairs(neighbours.nearest(table(spark, d, "vectors")))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar chunks of every usable vector."""
    return neighbours.nearest(table(spark, d, "vectors"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that are not valid for their extension."""
    return syntax.flag_files(table(spark, d, "files")).where("invalid").select("file_id").distinct()


def p3_flags(spark: SparkSession, d: str) -> DataFrame:
    """The verdict on every file."""
    return syntax.flag_files(table(spark, d, "files"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of invalid files of each repository and language."""
    return syntax.invalid_rates(table(spark, d, "files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that had to be split."""
    return splitting.split_oversized(table(spark, d, "chunks")).where(F.col("n_parts") > 1).where(F.col("part") == 1).select("chunk_id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all oversized chunks."""
    return splitting.split_oversized(table(spark, d, "chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods whose documentation tells something."""
    return documented.documented_functions(table(spark, d, "symbols"), table(spark, d, "files"), code=False).select("symbol_id").distinct()


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code and documentation of all functions and methods with telling documentation."""
    return documented.documented_functions(table(spark, d, "symbols"), table(spark, d, "files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The first chunk of each query's united list."""
    return consensus.first_of_each(consensus.robust_rank_aggregation(table(spark, d, "ranked")))


def p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Significance of every item of every query, as its decimal logarithm to six places."""
    scored = consensus.robust_rank_aggregation(table(spark, d, "ranked"))
    return scored.select("query_id", "chunk_id", (F.round(F.log10("significance"), 6) + 0.0).alias("log_significance"), "best_position", "n_lists")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_corpus(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document or piece of one."""
    return packing.pack_documents(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that share at least 200 consecutive characters."""
    return shared_spans.SharedSpans(table(spark, d, "documents")).pairs()


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """Each document's shared spans, as ``start-end`` in their order, and the share of its text they cover."""
    found = shared_spans.SharedSpans(table(spark, d, "documents")).spans()
    written = F.array_join(F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return found.select("doc_id", written.alias("spans"), "shared_chars", F.round("share", 8).alias("share"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of text that documents share, with the number of documents, instead of pairs."""
    return shared_spans.SharedSpans(table(spark, d, "documents")).span_classes()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_scores, p2_found, p2_neighbours, p3_found, p3_flags, p3_rates, p4_found, p4_pieces, p5_found, p5_pairs, p6_found, p6_ranking, p7_ids, p8_containers, p9_found, p9_spans, p9_classes)}


def oracle_sql() -> dict[str, str]:
    return {
        # The fixed point of the EM in closed form: terms above a threshold of freq / background keep mass.
        "p1_found": """
            WITH pairs AS (SELECT term, chunk_id, max(CASE WHEN freq > 0 THEN freq END) AS f FROM postings WHERE term IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2),
            spread AS (SELECT term, count(*) AS df FROM pairs GROUP BY 1),
            bg AS (SELECT term, df / (SELECT sum(df) FROM spread) AS q FROM spread),
            maps AS (SELECT DISTINCT chunk_id, term_freq FROM bm25_docs WHERE term_freq IS NOT NULL),
            t AS (SELECT p.chunk_id, p.term, coalesce(f, nullif(m.term_freq[p.term], 0), 1) AS f, q FROM pairs p JOIN bg USING (term)
                  LEFT JOIN maps m ON m.chunk_id = p.chunk_id WHERE p.chunk_id IN (SELECT chunk_id FROM term_probes)),
            c AS (SELECT *, f / q AS r, sum(f) OVER w AS fs, sum(q) OVER w AS qs FROM t
                  WINDOW w AS (PARTITION BY chunk_id ORDER BY f / q DESC ROWS UNBOUNDED PRECEDING)),
            k AS (SELECT chunk_id, arg_max(fs / (1 + 999 * qs), fs) AS mu FROM c WHERE r > 999 * fs / (1 + 999 * qs) GROUP BY 1),
            s AS (SELECT c.chunk_id, term, row_number() OVER (PARTITION BY c.chunk_id ORDER BY greatest(0, f / mu - 999 * q) DESC, r DESC, term) AS n FROM c JOIN k USING (chunk_id))
            SELECT chunk_id, term FROM s WHERE n = 1""",
        # The same fixed point for every term of every chunk.
        "p1_scores": """
            WITH pairs AS (SELECT term, chunk_id, max(CASE WHEN freq > 0 THEN freq END) AS f FROM postings WHERE term IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2),
            spread AS (SELECT term, count(*) AS df FROM pairs GROUP BY 1),
            bg AS (SELECT term, df, df / (SELECT sum(df) FROM spread) AS q FROM spread),
            entries AS (SELECT chunk_id, unnest(map_entries(term_freq)) AS e FROM bm25_docs WHERE term_freq IS NOT NULL AND chunk_id IN (SELECT chunk_id FROM pairs WHERE f IS NULL)),
            maps AS (SELECT chunk_id, e.key AS term, max(e.value) AS g FROM entries GROUP BY 1, 2),
            t AS (SELECT p.chunk_id, p.term, CAST(coalesce(f, CASE WHEN g > 0 THEN g END, 1) AS INT) AS f, df, q FROM pairs p JOIN bg USING (term) LEFT JOIN maps m ON m.chunk_id = p.chunk_id AND m.term = p.term),
            c AS (SELECT *, f / q AS r, sum(f) OVER w AS fs, sum(q) OVER w AS qs FROM t
                  WINDOW w AS (PARTITION BY chunk_id ORDER BY f / q DESC ROWS UNBOUNDED PRECEDING)),
            k AS (SELECT chunk_id, arg_max(fs / (1 + 999 * qs), fs) AS mu, max(fs) AS kept FROM c WHERE r > 999 * fs / (1 + 999 * qs) GROUP BY 1),
            s AS (SELECT c.*, CASE WHEN fs <= kept THEN greatest(0, f / mu - 999 * q) ELSE 0.0 END AS p FROM c JOIN k USING (chunk_id))
            SELECT chunk_id, term, f AS freq, df, round(p, 8) AS prob, round(CASE WHEN p > 0 THEN p * ln(p / q) ELSE 0 END, 8) AS score,
                   CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY p DESC, r DESC, term) AS INT) AS rank FROM s""",
        # Brute force over all pairs of usable vectors of a model.
        "p2_found": """
            WITH v AS (SELECT DISTINCT model, chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM vectors WHERE chunk_id IS NOT NULL AND model IS NOT NULL AND len(embedding) = 64
                       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            n AS (SELECT a.model, a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.model = b.model AND a.chunk_id <> b.chunk_id),
            t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, a ORDER BY c DESC, b) AS r FROM n) WHERE r <= 10 AND c >= 0.92)
            SELECT DISTINCT x.a AS chunk_id_a, x.b AS chunk_id_b FROM t x JOIN t y ON x.model = y.model AND x.a = y.b AND x.b = y.a WHERE x.a < x.b""",
        # Robust rank aggregation; the beta tail as its power series.
        **{name: f"""
            WITH i AS (SELECT query_id, retriever, chunk_id, min(CASE WHEN rank >= 1 THEN rank END) AS rank, min(CASE WHEN NOT isnan(score) THEN CASE WHEN retriever = 'vector' THEN score ELSE -score END END) AS cost, max(CASE WHEN NOT isnan(weight) AND weight > 0 THEN weight END) AS weight
                       FROM ranked WHERE query_id IS NOT NULL AND retriever IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2, 3),
            l AS (SELECT query_id, retriever, count(rank) > 0 AS has_ranks, coalesce(max(weight), 1.0) AS v FROM i GROUP BY 1, 2),
            k AS (SELECT i.query_id, i.retriever, chunk_id, v, CASE WHEN has_ranks THEN rank ELSE cost END AS key FROM i JOIN l USING (query_id, retriever)),
            p AS (SELECT *, rank() OVER (PARTITION BY query_id, retriever ORDER BY key NULLS LAST) + (count(*) OVER (PARTITION BY query_id, retriever, key) - 1) / 2 AS pos FROM k),
            h AS (SELECT query_id, sum(v) / min(v) AS n, min(v) AS unit, count(*) AS lists FROM l GROUP BY 1),
            u AS (SELECT query_id, count(DISTINCT chunk_id) AS items FROM k GROUP BY 1),
            c AS (SELECT p.query_id, chunk_id, pos, pos / items AS x, sum(v) OVER (PARTITION BY p.query_id, chunk_id ORDER BY pos, v ROWS UNBOUNDED PRECEDING) / unit AS a, n, lists FROM p JOIN h USING (query_id) JOIN u USING (query_id)),
            b AS (SELECT *, CASE WHEN x >= 1 THEN 1.0 ELSE least(1.0, exp(lgamma(n + 1) - lgamma(a + 1) - lgamma(n - a + 1) + a * ln(x) + (n - a + 1) * ln(1 - x))
                  * list_sum(list_transform(range(0, 3000), lambda j: exp(lgamma(n + 1 + j) - lgamma(n + 1) - lgamma(a + 1 + j) + lgamma(a + 1) + j * ln(x))))) END AS tail FROM c {only}),
            s AS (SELECT query_id, chunk_id, least(1.0, min(tail) * max(lists)) AS rho, min(pos) AS best, CAST(max(lists) AS INT) AS n_lists FROM b GROUP BY 1, 2)
            {last}""" for name, only, last in (
            # Only the heads of lists can win; the series takes long for all.
            ("p6_found", "WHERE x < 0.5", "SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ln(rho), 9), best, chunk_id) AS place FROM s) WHERE place = 1"),
            ("p6_ranking", "", "SELECT query_id, chunk_id, round(log10(rho), 6) + 0.0 AS log_significance, best AS best_position, n_lists FROM s"),
        )},
        # Every 200-character substring of every document.
        "p9_found": """
            WITH g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, CAST(length(text) - 198 AS BIGINT)), lambda i: substr(text, i, 200)))) AS gram FROM documents WHERE length(text) >= 200),
            m AS (SELECT gram, list_distinct(list(doc_id)) AS ids FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
            x AS (SELECT DISTINCT list_sort(ids) AS ids FROM m),
            y AS (SELECT ids, unnest(ids) AS a FROM x)
            SELECT DISTINCT a AS doc_id_a, b AS doc_id_b FROM (SELECT a, unnest(ids) AS b FROM y) WHERE a < b""",
        # The same substrings, joined where they touch.
        "p9_spans": """
            WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL),
            p AS (SELECT doc_id, text, unnest(range(1, CAST(length(text) - 198 AS BIGINT))) AS i FROM d WHERE length(text) >= 200),
            g AS (SELECT doc_id, i - 1 AS i, substr(text, i, 200) AS gram FROM p),
            m AS (SELECT gram FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
            s AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM g SEMI JOIN m USING (gram)),
            k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM s),
            f AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY doc_id, island),
            t AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS spans, sum(b - a) AS n FROM f GROUP BY 1)
            SELECT d.doc_id, coalesce(spans, '') AS spans, CAST(coalesce(n, 0) AS INT) AS shared_chars, round(CASE WHEN length(text) > 0 THEN coalesce(n, 0) / length(text) ELSE 0 END, 8) AS share FROM d LEFT JOIN t USING (doc_id)""",
        "p4_found": "SELECT DISTINCT id AS chunk_id FROM chunks WHERE strlen(text) > 4096",
    }
