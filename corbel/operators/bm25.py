"""Lexical index and Okapi BM25 for batches of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corbel.functions.text import index_text, tokenize_code
from corbel.session import cut

K1, B = 1.2, 0.75


def inverted_index(chunks: DataFrame, id_col: str = "id", header_col: str = "context_header", text_col: str = "text") -> DataFrame:
    """``(chunk_id, term, freq)`` over header and text."""
    tokens = chunks.select(F.col(id_col).alias("chunk_id"), F.explode(tokenize_code(index_text(F.col(header_col), F.col(text_col)))).alias("term"))
    return tokens.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).cast("int").alias("freq"))


def doc_stats(chunks: DataFrame, id_col: str = "id", header_col: str = "context_header", text_col: str = "text") -> DataFrame:
    """``(chunk_id, length)`` of every chunk; blank ones have length 0 and still count."""
    return chunks.select(F.col(id_col).alias("chunk_id"), F.size(tokenize_code(index_text(F.col(header_col), F.col(text_col)))).alias("length"))


def term_maps(chunks: DataFrame, id_col: str = "id", header_col: str = "context_header", text_col: str = "text") -> DataFrame:
    """``(chunk_id, length, term_freq map)``: the index's document form, without a shuffle: counts inside each row."""
    tokens = tokenize_code(index_text(F.col(header_col), F.col(text_col)))
    at = F.col("t")
    # Equal tokens stand together once sorted; a term's count is the distance between the places where runs begin.
    starts = F.filter(F.sequence(F.lit(0), F.size(at)), lambda i: (i == F.size(at)) | (i == 0) | (F.get(at, i) != F.get(at, i - 1)))
    begins = F.slice("s", F.lit(1), F.greatest(F.size("s") - 1, F.lit(0)))
    counts = F.map_from_arrays(F.transform(begins, lambda i: F.get(at, i)), F.transform(begins, lambda i, n: F.get("s", n + 1) - i))
    t = chunks.select(F.col(id_col).alias("chunk_id"), F.array_sort(tokens).alias("t")).withColumn("s", F.when(F.size("t") > 0, starts).otherwise(F.array(F.lit(0))))
    return t.select("chunk_id", F.size("t").alias("length"), counts.alias("term_freq"))


def reindex(postings: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings with those of the chunks in ``changed`` (a later inverted index) replaced."""
    kept = postings.join(changed.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return kept.select("chunk_id", "term", "freq").unionByName(changed.select("chunk_id", "term", "freq"))


def remove(postings: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings without the chunks in ``gone``."""
    return postings.join(gone.select("chunk_id").distinct(), "chunk_id", "left_anti")


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query_text") -> DataFrame:
    """``(query_id, term)``: distinct tokens of each query."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(tokenize_code(F.col(text_col)))).alias("term")).distinct()


def search(postings: DataFrame, stats: DataFrame, terms: DataFrame, k: int, k1: float = K1, b: float = B, digits: int = 6, query_block: int = 512, chunk_block: int = 16_384) -> DataFrame:
    """``(query_id, rank, chunk_id, score)``: the best ``k`` chunks of each query, by score, then id.

    Only postings of asked terms are read past the first join. Scores are rounded before they are compared, so the order
    does not depend on the order of summation. Postings without a frequency count for the document frequency alone. An
    index without chunks or terms gives no rows.

    A block of chunks meets a block of queries in one task, as a matrix of bounded size: postings are sent once for each
    block of queries, a frequent term costs its postings and not its pairs, and k rows return for each query and block.
    """
    asked = terms.select("term").distinct()
    hit = postings.join(asked, "term", "left_semi").groupBy("term", "chunk_id").agg(F.max("freq").alias("f"))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    sizes = stats.select("chunk_id", F.coalesce("length", F.lit(0)).alias("length")).groupBy("chunk_id").agg(F.max("length").alias("length"))
    whole = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avgdl"))
    n, avgdl = whole.select("n").scalar(), whole.select("avgdl").scalar()
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(df, "term").select("query_id", "term", idf.alias("idf"))
    # What a posting is worth does not depend on the query, so it is computed before postings meet queries.
    worth = F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("length") / avgdl))
    valued = hit.where("f IS NOT NULL").join(sizes, "chunk_id").select("term", "chunk_id", worth.alias("worth"))
    nq = max(1, -(-terms.select("query_id").distinct().count() // query_block))
    nx = max(1, -(-stats.select("chunk_id").distinct().count() // chunk_block), min(16, terms.sparkSession.sparkContext.defaultParallelism))
    block = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = weighted.withColumn("qb", block("query_id", nq)).withColumn("xb", every(nx)).groupBy("qb", "xb")
    right = valued.withColumn("xb", block("chunk_id", nx)).withColumn("qb", every(nq)).groupBy("qb", "xb")
    kind = terms.schema["query_id"].dataType.simpleString()
    scored = left.cogroup(right).applyInArrow(lambda q, c: _score_block(q, c, k, digits), f"query_id {kind}, chunk_id bigint, score double")
    scored = scored.withColumn("score", F.round("score", digits))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def _score_block(queries: pa.Table, postings: pa.Table, k: int, digits: int) -> pa.Table:
    """The best ``k`` chunks of a block of postings for each query of a block: term by term, the product of the queries'
    weights and the postings' worths is added to a matrix of both blocks."""
    kind = queries.schema.field("query_id").type
    empty = pa.table({"query_id": pa.array([], kind), "chunk_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not queries.num_rows or not postings.num_rows:
        return empty
    terms = pc.unique(queries["term"])
    of = lambda t: pc.index_in(t["term"], value_set=terms).to_numpy(zero_copy_only=False)
    qt, pt = of(queries), of(postings)
    names = queries["query_id"].combine_chunks().dictionary_encode()
    row, idf = names.indices.to_numpy(), queries["idf"].to_numpy()
    chunks, col = np.unique(postings["chunk_id"].to_numpy(), return_inverse=True)
    worth = postings["worth"].to_numpy()
    qo, po = np.argsort(qt, kind="stable"), np.argsort(pt, kind="stable")
    ends = np.arange(len(terms) + 1)
    qs, ps = np.searchsorted(qt[qo], ends), np.searchsorted(pt[po], ends)
    scores = np.zeros((len(names.dictionary), len(chunks)))
    for t in range(len(terms)):
        q, p = qo[qs[t] : qs[t + 1]], po[ps[t] : ps[t + 1]]
        if len(q) and len(p):
            scores[row[q][:, None], col[p]] += idf[q][:, None] * worth[p]
    scores = np.round(scores, digits)
    keep = min(k, len(chunks))
    edge = np.partition(scores, len(chunks) - keep, axis=1)[:, len(chunks) - keep]
    r, c = np.nonzero((scores >= edge[:, None]) & (scores > 0))
    order = np.lexsort((chunks[c], -scores[r, c], r))
    r, c = r[order], c[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < keep
    r, c = r[first], c[first]
    return pa.table({"query_id": names.dictionary.take(pa.array(r)), "chunk_id": chunks[c], "score": scores[r, c]})


def search_chunks(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Index and search: texts are tokenised once, into postings in the checkpoint folder; lengths follow from them."""
    post = cut(inverted_index(chunks))
    lengths = post.groupBy("chunk_id").agg(F.sum("freq").alias("length"))
    stats = chunks.select(F.col("id").alias("chunk_id")).distinct().join(lengths, "chunk_id", "left")
    return search(post, stats, query_terms(queries), k)
