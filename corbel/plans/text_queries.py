"""Queries on tokens, the lexical index, vectors, fusion and evaluation."""

from __future__ import annotations

import codecs
import io
import tokenize

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.functions import text as T
from corbel.operators import bm25, embedding, evaluate, fusion, vector
from corbel.operators.grep import grep
from corbel.plans.registry import query
from corbel.session import table

K = 10

STOP = "['" + "','".join(T.STOPWORDS) + "']"
WORDS = r"list_filter(list_transform(regexp_extract_all(coalesce({t}, ''), '[_\p{{L}}\p{{Nd}}]+'), lambda w: regexp_replace(w, '^_+|_+$', '', 'g')), lambda w: w <> '')"
PARTS = r"regexp_split_to_array(regexp_replace(regexp_replace(w, '(\p{Ll})(\p{Lu})', '\1_\2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1_\2', 'g'), '_+')"


def sql_tokens(t: str) -> str:
    """The code tokenizer in DuckDB's dialect."""
    some = f"list_filter(list_transform({PARTS}, lambda p: lower(p)), lambda p: NOT list_contains({STOP}, p))"
    return f"flatten(list_transform({WORDS.format(t=t)}, lambda w: CASE WHEN len({PARTS}) > 1 THEN list_concat([lower(w)], {some}) ELSE list_filter([lower(w)], lambda p: NOT list_contains({STOP}, p)) END))"


CHUNK_TOKENS = f"chunk_tokens AS (SELECT id AS chunk_id, {sql_tokens("(coalesce(context_header, '') || ' ' || coalesce(text, ''))")} AS toks FROM chunks)"
BM25 = f"""{CHUNK_TOKENS},
    tf AS (SELECT chunk_id, term, count(*) AS f FROM (SELECT chunk_id, unnest(toks) AS term FROM chunk_tokens) GROUP BY 1, 2),
    sizes AS (SELECT chunk_id, len(toks) AS length FROM chunk_tokens),
    whole AS (SELECT count(*) AS n, avg(length) AS avgdl FROM sizes),
    dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    scored AS (SELECT query_id, tf.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / avgdl))), 6) AS score
               FROM terms JOIN tf USING (term) JOIN dfs USING (term) JOIN sizes ON sizes.chunk_id = tf.chunk_id, whole GROUP BY 1, 2),
    bm AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank, chunk_id, score FROM scored)"""
TERMS = f"terms AS (SELECT DISTINCT query_id, unnest({sql_tokens('query_text')}) AS term FROM eval_queries)"
LITERAL = "merge queue retry parseChunkHeader weight"
UNSET = "CASE WHEN weight IS NULL OR weight = 0 OR isnan(weight) THEN 1.0 ELSE weight END"


@query(f"SELECT doc_id, array_to_string({sql_tokens('text')}, ' ') AS tokens FROM documents")
def tokenize_code(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", wide=True).select("doc_id", F.array_join(T.tokenize_code(F.col("text")), " ").alias("tokens"))


@query(r"""SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '[_\p{L}\p{Nd}]+'), lambda w: CAST(ceil(length(w) / 4.0) AS BIGINT))), 0)
       + length(regexp_replace(regexp_replace(coalesce(text, ''), '[_\p{L}\p{Nd}\s\p{Z}]', '', 'g'), '[' || chr(11) || chr(133) || ']', '', 'g')) AS INT) AS tokens FROM documents""")
def token_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", wide=True).select("doc_id", T.count_tokens(F.col("text")).alias("tokens"))


@query(f"WITH {CHUNK_TOKENS} SELECT chunk_id, term, CAST(count(*) AS INT) AS freq FROM (SELECT chunk_id, unnest(toks) AS term FROM chunk_tokens) GROUP BY 1, 2")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return bm25.inverted_index(table(spark, d, "chunks", wide=True))


@query(f"WITH {CHUNK_TOKENS} SELECT chunk_id, CAST(len(toks) AS INT) AS length FROM chunk_tokens")
def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.doc_stats(table(spark, d, "chunks", wide=True))


@query(f"WITH {CHUNK_TOKENS} SELECT chunk_id, CAST(len(toks) AS INT) AS length, CAST(len(list_distinct(toks)) AS INT) AS terms, CAST(coalesce(list_max(list_transform(list_distinct(toks), lambda x: len(list_filter(toks, lambda y: y = x)))), 0) AS INT) AS top FROM chunk_tokens")
def term_maps(spark: SparkSession, d: str) -> DataFrame:
    m = bm25.term_maps(table(spark, d, "chunks", wide=True))
    top = F.coalesce(F.array_max(F.map_values("term_freq")), F.lit(0))
    return m.select("chunk_id", "length", F.size("term_freq").alias("terms"), top.alias("top"))


@query(f"WITH terms AS (SELECT DISTINCT 0 AS query_id, unnest({sql_tokens(repr(LITERAL))}) AS term), {BM25} SELECT rank, chunk_id, score FROM bm WHERE rank <= 20")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    one = spark.createDataFrame([(0, LITERAL)], "query_id int, query_text string")
    return bm25.search_chunks(table(spark, d, "chunks", wide=True), one, 20).drop("query_id")


@query(f"WITH {TERMS}, {BM25} SELECT query_id, rank, chunk_id, score FROM bm WHERE rank <= {K}")
def bm25_batch_search(spark: SparkSession, d: str) -> DataFrame:
    return bm25.search_chunks(table(spark, d, "chunks", wide=True), table(spark, d, "eval_queries"), K)


def _knn(metric: str, expr: str):
    sql = f"""WITH v AS (SELECT DISTINCT chunk_id, model, CAST(embedding AS DOUBLE[]) AS e FROM vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0),
        p AS (SELECT q.chunk_id AS query_id, q.model AS scope, b.chunk_id, round({expr}, 6) + 0.0 AS distance FROM v q JOIN v b ON q.model = b.model WHERE q.chunk_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY scope, query_id ORDER BY distance, chunk_id) AS INT) AS rank FROM p)
        SELECT query_id, scope, rank, chunk_id, distance FROM r WHERE rank <= {K}"""

    def run(spark: SparkSession, d: str) -> DataFrame:
        v = table(spark, d, "vectors").select(F.col("model").alias("scope"), "chunk_id", "embedding")
        asked = v.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
        return vector.knn(asked, v, K, metric)

    run.__name__ = f"knn_{metric}"
    run.__doc__ = "Every vector whose id is divisible by 50 against all of its model."
    query(sql)(run)


_knn("cosine", "CASE WHEN list_dot_product(q.e, q.e) = 0 OR list_dot_product(b.e, b.e) = 0 THEN 1.0 ELSE 1 - list_dot_product(q.e, b.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(b.e, b.e))) END")
_knn("l2", "list_distance(q.e, b.e)")
_knn("inner_product", "-list_dot_product(q.e, b.e)")

RANKS = """rows AS (SELECT DISTINCT query_id, retriever, weight, rank, chunk_id, score FROM ranked),
    placed AS (SELECT query_id, retriever, weight, chunk_id, score, CAST(coalesce(rank, rank() OVER (PARTITION BY query_id, retriever, rank IS NULL ORDER BY CASE WHEN retriever = 'vector' THEN score ELSE -score END)) AS INT) AS rank FROM rows)"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return fusion.assign_ranks(table(spark, d, "ranked"))


@query(f"WITH {RANKS} SELECT query_id, retriever, chunk_id, rank FROM placed")
def assign_ranks(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("query_id", "retriever", "chunk_id", "rank")


@query(f"""WITH {RANKS} SELECT query_id, chunk_id, round(sum({UNSET} / (60 + rank)), 9) AS score, string_agg(retriever || '#' || rank, ',' ORDER BY retriever) AS sources FROM placed GROUP BY 1, 2""")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    from corbel.operators.context import source_labels

    return fusion.rrf(_lists(spark, d)).select("query_id", "chunk_id", "score", F.array_join(source_labels(F.col("sources")), ",").alias("sources"))


HYBRID = f"""{TERMS}, {BM25}, {RANKS},
    lists AS (SELECT query_id, chunk_id, rank FROM bm WHERE rank <= {K} UNION ALL SELECT query_id, chunk_id, rank FROM placed WHERE retriever = 'vector' AND rank <= {K}),
    fused AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM lists GROUP BY 1, 2)"""


def _hybrid(spark: SparkSession, d: str, boost=None) -> DataFrame:
    near = lambda: _lists(spark, d).where("retriever = 'vector'")
    hits, _ = fusion.hybrid_search({"bm25": lambda: bm25_batch_search(spark, d), "vector": near}, K, boost=boost)
    return hits.select("query_id", "rank", "chunk_id", "score")


@query(f"WITH {HYBRID}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM fused) SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= {K}")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Lexical hits computed here and the vector retriever's logged hits, fused without boost."""
    return _hybrid(spark, d)


def symbol_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the symbol tree: parent to child."""
    s = table(spark, d, "symbols").where("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))
    return s.distinct()


@query(f"""WITH {HYBRID},
    home AS (SELECT f.*, c.symbol_id, c.file_id FROM fused f JOIN chunks c ON c.id = f.chunk_id),
    n AS (SELECT query_id, count(*) AS hits FROM fused GROUP BY 1),
    seed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM home) WHERE r = 1),
    links AS (SELECT DISTINCT parent_id AS a, id AS b FROM symbols WHERE parent_id IS NOT NULL UNION SELECT DISTINCT id, parent_id FROM symbols WHERE parent_id IS NOT NULL),
    b AS (SELECT h.query_id, h.chunk_id, CASE WHEN hits < 2 THEN h.score ELSE round(h.score + 0.002 * ((CASE WHEN h.file_id = s.file_id THEN 1 ELSE 0 END) + 2 * (CASE WHEN EXISTS (SELECT 1 FROM links l WHERE l.a = s.symbol_id AND l.b = h.symbol_id) THEN 1 ELSE 0 END)), 9) END AS score
          FROM home h JOIN seed s USING (query_id) JOIN n USING (query_id)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM b)
    SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= {K}""")
def hybrid_graph_boost(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, lambda h: fusion.graph_boost(h, table(spark, d, "chunks"), symbol_edges(spark, d)))


FILE_TEXT = "files WHERE lower(path) LIKE '%.py' AND text IS NOT NULL"


def _readable(batches):
    """Text of sources that are not UTF-8, lines as they are: by byte order mark or coding comment, wrong bytes replaced."""
    for b in batches:
        texts = []
        for content in b.column(2).to_pylist():
            encoding = "utf-16"
            if not content.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
                try:
                    encoding, _ = tokenize.detect_encoding(io.BytesIO(content).readline)
                except (SyntaxError, LookupError, UnicodeError, ValueError):
                    encoding = "utf-8"
            try:
                texts.append(content.decode(encoding, "replace"))
            except (LookupError, UnicodeError, ValueError):
                texts.append(content.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["scope", "path", "text"])


@query(None)
def grep_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation query against the Python files of its repository, in any encoding."""
    files = table(spark, d, "files", wide=True).where(F.lower("path").endswith(".py") & F.col("content").isNotNull())
    read = files.select(F.col("repo_id").alias("scope"), "path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"), "content")
    plain = read.where("text IS NOT NULL").drop("content")
    sources = plain.unionByName(read.where("text IS NULL").select("scope", "path", "content").mapInArrow(_readable, plain.schema))
    return grep(sources, table(spark, d, "eval_queries").select("query_id", F.col("repo_id").alias("scope"), "query_text"))


@query(f"""WITH terms AS (SELECT DISTINCT query_id, unnest({sql_tokens('query_text')}) AS term FROM eval_queries),
    lines AS (SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
    ws AS (SELECT DISTINCT doc_id, line, unnest(regexp_extract_all(lower(t), '[_\\p{{L}}\\p{{Nd}}]+')) AS term FROM lines),
    s AS (SELECT query_id, CAST(doc_id AS VARCHAR) AS path, CAST(line AS INT) AS line, CAST(count(DISTINCT term) AS INT) AS score FROM terms JOIN ws USING (term) WHERE length(term) >= 3 GROUP BY 1, 2, 3),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, line) AS INT) AS rank FROM s)
    SELECT query_id, rank, path, line, score FROM r WHERE rank <= 5""")
def grep_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation query against the lines of all documents."""
    docs = table(spark, d, "documents", wide=True).select(F.lit(None).cast("bigint").alias("scope"), F.col("doc_id").cast("string").alias("path"), "text")
    return grep(docs, table(spark, d, "eval_queries").select("query_id", F.lit(None).cast("bigint").alias("scope"), "query_text"))


# Labels: what the graph retriever put first; systems: the other retrievers' lists.
EVAL = f"""{RANKS},
    place AS (SELECT p.*, CAST(c.file_id AS VARCHAR) AS path, least(c.start_line, c.end_line) AS s, greatest(c.start_line, c.end_line) AS e FROM placed p JOIN chunks c ON c.id = p.chunk_id),
    labels AS (SELECT DISTINCT query_id, chunk_id AS label, path, s, e FROM place WHERE retriever = 'graph' AND rank <= 3),
    items AS (SELECT retriever AS system, query_id, rank, path, s, e FROM place WHERE retriever <> 'graph'),
    hits AS (SELECT i.system, i.query_id, count(DISTINCT i.rank) AS hits, count(DISTINCT l.label) AS found, min(i.rank) AS first FROM items i JOIN labels l ON i.query_id = l.query_id AND i.path = l.path AND i.s <= l.e AND l.s <= i.e WHERE i.rank <= 5 GROUP BY 1, 2),
    wanted AS (SELECT query_id, count(DISTINCT label) AS labels FROM labels GROUP BY 1),
    m AS (SELECT g.system, g.query_id, coalesce(hits, 0) / 5 AS precision, CASE WHEN coalesce(labels, 0) > 0 THEN coalesce(found, 0) / labels ELSE 0.0 END AS recall, coalesce(1 / first, 0.0) AS reciprocal_rank
          FROM (SELECT DISTINCT system, query_id FROM items) g JOIN eval_queries q ON q.query_id = g.query_id LEFT JOIN hits h ON h.system = g.system AND h.query_id = g.query_id LEFT JOIN wanted w ON w.query_id = g.query_id)"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), F.col("file_id").cast("string").alias("path"), F.least("start_line", "end_line").alias("start_line"), F.greatest("start_line", "end_line").alias("end_line"))
    placed = _lists(spark, d).join(c, "chunk_id")
    labels = placed.where("retriever = 'graph' AND rank <= 3").select("query_id", F.col("chunk_id").alias("label"), "path", "start_line", "end_line").distinct()
    items = placed.where("retriever <> 'graph'").select(F.col("retriever").alias("system"), "query_id", "rank", "path", "start_line", "end_line")
    return evaluate.query_metrics(items, labels, table(spark, d, "eval_queries"))


@query(f"WITH {EVAL} SELECT system, query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank FROM m")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d)
    return m.select("system", "query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank")])


@query(f"""WITH {EVAL}, t AS (SELECT m.*, coalesce(query_type, '') AS query_type FROM m JOIN (SELECT DISTINCT query_id, query_type FROM eval_queries) USING (query_id))
    SELECT system, query_type, count(*) AS queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS mrr FROM t GROUP BY GROUPING SETS ((system), (system, query_type))""")
def eval_by_type(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.averages(_metrics(spark, d), table(spark, d, "eval_queries"))


@query(None)
def fake_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic stand-in vectors of all chunks, on header and text."""
    c = table(spark, d, "chunks", wide=True).select("id", T.embedding_text(F.col("context_header"), F.col("text")).alias("t"))
    return embedding.embed(c, "id", "t")


@query("SELECT id, octet_length(encode(left(text, 40))) AS bytes, left(text, 40) AS head FROM chunks WHERE text IS NOT NULL AND octet_length(encode(left(text, 40))) = 40")
def truncate_ascii(spark: SparkSession, d: str) -> DataFrame:
    """Byte truncation of chunks whose first 40 characters are ASCII."""
    c = table(spark, d, "chunks").where("text IS NOT NULL").where(F.octet_length(F.substring("text", 1, 40)) == 40)
    cut = T.truncate_bytes(F.col("text"), 40)
    return c.select("id", F.octet_length(cut).cast("bigint").alias("bytes"), cut.alias("head"))


@query(None)
def truncate_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Byte truncation of every chunk; truncate_ascii is the part that SQL can check."""
    cut = T.truncate_bytes(F.col("text"), 40)
    return table(spark, d, "chunks").select("id", F.octet_length(cut).cast("bigint").alias("bytes"), cut.alias("head"))


@query("SELECT id, array_to_string(list_slice(string_split(text, chr(10)), 1, 5), chr(10)) AS head FROM chunks")
def snippet_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", T.truncate_lines(F.col("text"), 5).alias("head"))
