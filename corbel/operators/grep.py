"""Line-level word search: a plain lexical baseline."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corbel.functions.text import tokenize_code
from corbel.session import cut

# Sizes of work, not of results: what a block holds at most (bytes of text and 64 for each line; sets of terms), and
# which share of the lines gives the bounds.
BLOCK_BYTES, BLOCK_SETS, SHARE = 64 << 20, 200_000, 16

HITS = pa.schema([("set", pa.int64()), ("score", pa.int32()), ("path", pa.string()), ("line", pa.int32())])


def _best(lines: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The best ``k`` lines of a block for each set of terms, without those behind the set's bound.

    ``lines(path, line, words)``, ``asked(set, terms, score, bound, bound_line)``. A bound is a line and its score; it is
    kept itself. Of ``m`` terms that stand in the block at all, a line with ``s`` of them has one of the ``m - s + 1``
    rarest: only lines of those are looked at, and dropped as soon as the terms left can't bring them to the bound.
    """
    if not lines.num_rows or not asked.num_rows:
        return HITS.empty_table()
    lines = lines.sort_by([("path", "ascending"), ("line", "ascending")])
    coded = lines["path"].combine_chunks().dictionary_encode()
    of_path, number = coded.indices.to_numpy(), lines["line"].to_numpy()
    new = np.concatenate([[True], (of_path[1:] != of_path[:-1]) | (number[1:] != number[:-1])])
    place = np.cumsum(new) - 1  # rows of the same path and line are one line
    paths, of_path, number = coded.dictionary.to_pylist(), of_path[new], number[new]
    n = len(number)
    starts = np.searchsorted(of_path, np.arange(len(paths) + 1))

    terms = asked["terms"].combine_chunks()
    ends = np.cumsum(pc.list_value_length(terms).to_numpy())
    coded = terms.flatten().dictionary_encode()
    of_set = coded.indices.to_numpy()
    words = pc.split_pattern(lines["words"].combine_chunks(), " ")
    found = pc.index_in(words.flatten(), coded.dictionary)
    there = found.is_valid()
    pairs = np.unique(found.filter(there).to_numpy().astype(np.int64) * n + place[pc.list_parent_indices(words).filter(there).to_numpy()])
    which, post = np.divmod(pairs, n)
    offsets = np.searchsorted(which, np.arange(len(coded.dictionary) + 1))
    df = np.diff(offsets)
    offsets = offsets.tolist()
    dense: dict[int, np.ndarray] = {}
    marks = np.zeros(n, bool)

    def has(t: int, at: np.ndarray) -> np.ndarray:
        own = post[offsets[t] : offsets[t + 1]]
        if len(own) > 16 * len(at) and 16 * len(own) < n:
            return own[np.minimum(np.searchsorted(own, at), len(own) - 1)] == at
        if 16 * len(own) < n:
            marks[own] = True
            there = marks[at]
            marks[own] = False
            return there
        if t not in dense:
            dense[t] = np.zeros(n, bool)
            dense[t][own] = True
        return dense[t][at]

    def up_to(path: str | None, line: int) -> int:
        """How many lines are not behind this one."""
        if path is None:
            return n
        i = bisect_left(paths, path)
        if i == len(paths) or paths[i] != path:
            return int(starts[i])
        return int(starts[i] + np.searchsorted(number[starts[i] : starts[i + 1]], line, "right"))

    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    begin = 0
    for i, (end, least, path, line) in enumerate(zip(ends.tolist(), asked["score"].to_pylist(), asked["bound"].to_pylist(), asked["bound_line"].to_pylist(), strict=True)):
        own, begin = of_set[begin:end], end
        own = own[df[own] > 0]
        least, m = least or 1, len(own)
        if m < least:
            continue
        own = own[np.argsort(df[own])].tolist()
        last, rare = up_to(path, line), m - least
        # With one of the rarest less, a line gets to the bound's score, not above it: then it has to come first.
        tie = post[offsets[own[rare]] : offsets[own[rare] + 1]]
        flat = np.concatenate([*(post[offsets[t] : offsets[t + 1]] for t in own[:rare]), tie if last == n else tie[: np.searchsorted(tie, last)]])
        if 8 * len(flat) > n:
            score = np.bincount(flat, minlength=n)
            at = np.flatnonzero(score)
            score = score[at]
        else:
            at, score = np.unique(flat, return_counts=True)
        for j in range(rare, m):
            if j > rare:
                score = score + has(own[j], at)
            elif last < n:
                score = score + (has(own[j], at) & (at >= last))
            may = score > least - m + j
            at, score = at[may], score[may]
            if not len(at):
                break
        if last < n:
            may = (score > least) | (at < last)
            at, score = at[may], score[may]
        if len(at) > k:
            kth = np.partition(score, len(at) - k)[len(at) - k]
            above = np.flatnonzero(score > kth)
            chosen = np.concatenate([above, np.flatnonzero(score == kth)[: k - len(above)]])
            at, score = at[chosen], score[chosen]
        if len(at):
            out.append((i, at, score))
    if not out:
        return HITS.empty_table()
    at = np.concatenate([x for _, x, _ in out])
    sets = asked["set"].to_numpy()[np.repeat([i for i, _, _ in out], [len(x) for _, x, _ in out])]
    columns = [pa.array(sets), pa.array(np.concatenate([s for *_, s in out]).astype(np.int32)), pa.array(paths, pa.string()).take(pa.array(of_path[at])), pa.array(number[at].astype(np.int32))]
    return pa.Table.from_arrays(columns, schema=HITS)


def _top(hits: DataFrame, k: int, *by: str | Column) -> DataFrame:
    w = Window.partitionBy(by[0]).orderBy(F.col("score").desc(), "path", "line", *by[1:])
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def grep(files: DataFrame, queries: DataFrame, k: int = 5, least: int = 3) -> DataFrame:
    """``(query_id, rank, path, line, score)``: lines by the number of distinct query tokens that stand in them as words.

    ``files(scope, path, text)``, ``queries(query_id, scope, query_text)``: a query searches its scope (null scopes meet
    null). Tokens shorter than ``least`` are left out, case does not matter. The best ``k`` by score, path, line.

    Queries of the same tokens are searched once. The lines of a scope are dealt into blocks, each of which meets all the
    scope's queries. A share of the lines is searched first: the ``k``-th of it is the bound that lines of the blocks have
    to reach, so that few are counted and a query gets some ``k`` times ``SHARE`` rows from all blocks together.
    """
    spark = files.sparkSession
    terms = queries.select("query_id", "scope", F.explode(tokenize_code(F.col("query_text"))).alias("term")).where(F.length("term") >= least)
    wanted = terms.groupBy("query_id", "scope").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    sets = cut(wanted.select("scope", "terms").distinct().withColumn("set", F.monotonically_increasing_id()))

    weight = F.octet_length("text") + 64 * F.size(F.split("text", "\n"))
    sizes = files.where("text IS NOT NULL").groupBy("scope").agg(F.sum(weight.cast("bigint")).alias("bytes"), F.lit(0).cast("bigint").alias("sets"))
    sizes = sizes.unionByName(sets.groupBy("scope").agg(F.lit(0).cast("bigint").alias("bytes"), F.count(F.lit(1)).alias("sets"))).groupBy("scope").agg(F.sum("bytes").alias("bytes"), F.sum("sets").alias("sets"))
    sizes = cut(sizes)
    cores = spark.sparkContext.defaultParallelism
    per = min(BLOCK_BYTES, (sizes.agg(F.sum("bytes")).first()[0] or 0) // (2 * cores) + 1)
    # Enough partitions that few tasks get several blocks.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * cores) + 1
    # Only scopes of several blocks are listed: about as many as there are blocks.
    large = sizes.select(F.col("scope").alias("__scope"), F.ceil(F.col("bytes") / per).alias("__blocks"), F.ceil(F.col("sets") / BLOCK_SETS).alias("__parts")).where("__blocks > 1 OR __parts > 1")

    # Null paths come first.
    path = F.when(F.col("path").isNull(), "").otherwise(F.concat(F.lit("="), F.col("path")))
    lines = files.select("scope", path.alias("path"), F.posexplode(F.split("text", "\n")).alias("__i", "__line")).select("scope", "path", (F.col("__i") + 1).alias("line"), "__line")
    scope = F.when(F.col("scope").isNull(), "").otherwise(F.concat(F.lit("="), F.col("scope").cast("string")))

    def search(lines: DataFrame, asked: DataFrame, share: int) -> DataFrame:
        def placed(df: DataFrame) -> DataFrame:
            both = df.join(F.broadcast(large), F.col("scope").eqNullSafe(F.col("__scope")), "left")
            count = lambda c: F.greatest(F.ceil(F.coalesce(c, F.lit(1)) / share), F.lit(1)).cast("int")
            return both.withColumns({"__blocks": count("__blocks"), "__parts": F.greatest(F.coalesce("__parts", F.lit(1)), F.lit(1)).cast("int")})

        one_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        key = F.concat_ws(":", scope, "__block", "__part").alias("block")
        words = F.regexp_replace(F.lower("__line"), r"[^_\p{L}\p{Nd}]+", " ").alias("words")
        a = placed(lines).withColumn("__block", F.pmod(F.hash("path", "line"), "__blocks")).select("scope", "path", "line", words, "__block", one_of("__parts").alias("__part"))
        b = placed(asked).withColumn("__part", F.pmod("set", "__parts")).withColumn("__block", one_of("__blocks"))
        a, b = a.select(key, "path", "line", "words").where("words NOT IN ('', ' ')"), b.select(key, "set", "terms", "score", "bound", "bound_line")
        a, b = (x.repartition(parts, "block").groupBy("block") for x in (a, b))
        return a.cogroup(b).applyInArrow(lambda x, y: _best(x, y, k), "set long, score int, path string, line int")

    free = sets.select("*", F.lit(None).cast("int").alias("score"), F.lit(None).cast("string").alias("bound"), F.lit(None).cast("int").alias("bound_line"))
    some = lines.where(F.pmod(F.xxhash64("path", "line"), F.lit(SHARE)) == 0)
    bounds = _top(search(some, free, SHARE), k, "set").where(F.col("rank") == k).select("set", "score", F.col("path").alias("bound"), F.col("line").alias("bound_line"))
    best = _top(search(lines, sets.join(bounds, "set", "left"), 1), k, "set").drop("rank")

    w, s = wanted.alias("w"), sets.alias("s")
    members = w.join(s, F.col("w.scope").eqNullSafe(F.col("s.scope")) & (F.col("w.terms") == F.col("s.terms"))).select("query_id", "w.scope", "set")
    ranked = _top(members.join(best, "set"), k, "query_id", "scope")
    return ranked.select("query_id", "rank", F.when(F.col("path") != "", F.expr("substring(path, 2)")).alias("path"), "line", "score")
