import math
from math import comb

import numpy as np
import pytest

from corbel.llm.consensus import beta_tail, first_of_each, robust_rank_aggregation
from corbel.llm.distinctive import em, em_step, term_distinctiveness


def _em_slow(f, q, w):
    p = [x / sum(f) for x in f]
    for _ in range(3000):
        e = [x * w * a / (w * a + (1 - w) * b) for x, a, b in zip(f, p, q, strict=True)]
        p = [x / sum(e) for x in e]
    return p


def test_em_equals_the_plain_loop():
    rng = np.random.default_rng(2)
    sizes = [1, 5, 30, 2]
    f, q = rng.integers(1, 9, sum(sizes)).astype(float), rng.random(sum(sizes)) / 50
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    got = em(f.copy(), q, offsets, 0.1)
    for a, b in zip(offsets, offsets[1:], strict=False):
        assert got[a:b] == pytest.approx(_em_slow(list(f[a:b]), list(q[a:b]), 0.1), abs=1e-6)


def test_every_record_is_at_rest():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 120, 400)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    f, q = rng.integers(1, 9, offsets[-1]).astype(float), 10 ** rng.uniform(-7, -2, offsets[-1])
    for w in (0.001, 0.1, 0.9):
        p = em(f, q, offsets, w)
        assert np.abs(em_step(p, f, q, offsets, w) - p).max() < 1e-9
        # A term without mass would lose what it were given.
        lost = np.repeat(np.add.reduceat(np.where(p > 0, f, 0), offsets[:-1]) / (1 + (1 - w) / w * np.add.reduceat(np.where(p > 0, q, 0), offsets[:-1])), sizes)
        assert (f[p == 0] / lost[p == 0] <= (1 - w) / w * q[p == 0] + 1e-12).all()


def _postings(spark):
    rows = [(c, "the", 5) for c in range(200)] + [(c, "index", 2) for c in range(0, 200, 2)] + [(7, "zebra", 3), (9, "zebra", 3), (8, "once", 1), (8, "", 1), (8, None, 4), (None, "the", 1)]
    rows += rows[:50] + [(11, "lost", None), (12, "gone", None)]
    return spark.createDataFrame([(1, t, c, f) for c, t, f in rows], "repo_id long, term string, chunk_id long, freq int")


def test_rare_terms_win_and_copies_count_once(spark):
    docs = spark.createDataFrame([(11, 9, {"lost": 4, "the": 1}), (12, 1, None)], "chunk_id long, length int, term_freq map<string,int>")
    rows = term_distinctiveness(_postings(spark), docs).collect()
    assert len(rows) == len({(r.chunk_id, r.term) for r in rows}) == 200 + 100 + 6
    first = {r.chunk_id: r for r in rows if r["rank"] == 1}
    assert first[7].term == "zebra" and first[9].df == 2 and first[11].term == "lost"
    assert next(r.freq for r in rows if r.term == "lost") == 4 and next(r.freq for r in rows if r.term == "gone") == 1
    for c in (7, 8, 100):
        assert math.isclose(sum(r.prob for r in rows if r.chunk_id == c), 1, abs_tol=1e-9)
    only = term_distinctiveness(_postings(spark), docs, spark.createDataFrame([(7,), (7,), (500,)], "chunk_id long")).collect()
    short = lambda r: (r.chunk_id, r.term, r.freq, r.df, round(r.prob, 9), r['rank'])
    assert sorted(map(short, only)) == sorted(short(r) for r in rows if r.chunk_id == 7)


def test_hot_terms_joined_by_broadcast_give_the_same(spark):
    a = term_distinctiveness(_postings(spark), hot_share=1.0).collect()
    b = term_distinctiveness(_postings(spark), hot_share=0.0).collect()
    assert sorted((r.chunk_id, r.term, round(r.prob, 9)) for r in a) == sorted((r.chunk_id, r.term, round(r.prob, 9)) for r in b)


def test_no_postings(spark):
    assert term_distinctiveness(_postings(spark).limit(0)).count() == 0


RANKED = "query_id string, retriever string, weight double, rank int, chunk_id long, score double, size int"


def _significance(lists, weights):
    """Direct robust rank aggregation for whole weights; lists: {item: position}."""
    votes = [w if w and w > 0 else 1 for w in weights]
    n, out, items = sum(votes), {}, set().union(*lists)
    for item in items:
        r = sorted(x for ranks, v in zip(lists, votes, strict=True) for x in [ranks[item] / len(items) if item in ranks else 1.0] * int(v))
        tails = [1.0 if x >= 1 else sum(comb(int(n), j) * x**j * (1 - x) ** (int(n) - j) for j in range(k, int(n) + 1)) for k, x in enumerate(r, 1)]
        out[item] = min(1.0, min(tails) * len(lists))
    return out


def test_tail_for_whole_and_broken_votes():
    x, k, n = (np.array(v, float).ravel() for v in np.meshgrid(np.linspace(0.01, 0.99, 25), [1, 2, 5, 9], [9]))
    want = [sum(comb(9, j) * p**j * (1 - p) ** (9 - j) for j in range(int(i), 10)) for p, i in zip(x, k, strict=True)]
    assert np.allclose(beta_tail(x, k, n), want, rtol=1e-10)
    # Between whole votes the tail lies between theirs, and falls as more of them rank an item high.
    fine = beta_tail(np.full(17, 0.2), np.linspace(1, 9, 17), np.full(17, 9.0))
    assert (np.diff(fine) < 0).all() and beta_tail(np.array([1.0]), np.array([2.0]), np.array([3.0]))[0] == 1.0


def test_weights_between_and_below_whole_ones_count(spark):
    def first(heavy, light):
        rows = [("q", "grep", heavy, i + 1, c, None, 0) for i, c in enumerate([1, 2, 3, 4])] + [("q", "bm25", light, i + 1, c, None, 0) for i, c in enumerate([5, 6, 7, 8])]
        return first_of_each(robust_rank_aggregation(spark.createDataFrame(rows, RANKED))).first().chunk_id

    assert first(0.2, 0.1) == 1 and first(0.1, 0.2) == 5 and first(0.75, 0.7) == 1 and first(1.1, 1.2) == 5


def test_support_of_all_lists_beats_the_head_of_a_heavy_one(spark):
    rows = [("q", "usage", 2.0, i + 1, c, None, 0) for i, c in enumerate([1, 2, *range(100, 134)])] + [("q", "bm25", 0.5, i + 1, c, None, 0) for i, c in enumerate([50, 2, *range(60, 70)])]
    rows += [("q", "grep", None, i + 1, c, None, 0) for i, c in enumerate([51, 2, *range(70, 80)])] + [("q", "vector", 1.0, i + 1, c, None, 0) for i, c in enumerate(range(80, 103))]
    assert first_of_each(robust_rank_aggregation(spark.createDataFrame(rows, RANKED))).first().chunk_id == 2


def test_equals_direct_aggregation(spark):
    rng = np.random.default_rng(4)
    lists, weights, rows = [], [2.0, None, 0.0, 1.0], []
    for name, w in zip(["bm25", "vector", "grep", "graph"], weights, strict=True):
        items = rng.permutation(40)[:15].tolist()
        lists.append({c: i + 1 for i, c in enumerate(items)})
        for i, c in enumerate(items):
            score = {"bm25": 900.0 / (i + 1), "vector": 0.01 * i, "grep": None, "graph": 1e-9 * (50 - i)}[name]
            rows.append(("q", name, w, None if name in ("bm25", "vector") else i + 1, int(c), score, 0))
    rows += rows[3:9]
    got = {r.chunk_id: r.significance for r in robust_rank_aggregation(spark.createDataFrame(rows, RANKED)).collect()}
    want = _significance(lists, weights)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[c], want[c], rel_tol=1e-9, abs_tol=1e-300) for c in want)


def test_head_of_lists_wins_over_large_numbers(spark):
    rows = [("q", "usage", 1.0, None, c, 10.0 ** (9 - c), 0) for c in range(1, 9)] + [("q", "bm25", 1.0, i + 1, c, None, 0) for i, c in enumerate([2, 5, 6, 7, 8])]
    rows += [("q", "vector", 1.0, i + 1, c, 0.0, 0) for i, c in enumerate([2, 9, 4, 3])]
    rows += [("p", "grep", None, 1, 77, float("nan"), 0), (None, "grep", 1.0, 1, 1, 1.0, 0), ("p", None, 1.0, 1, 1, 1.0, 0), ("p", "grep", 1.0, 1, None, 1.0, 0)]
    got = {r.query_id: r.chunk_id for r in first_of_each(robust_rank_aggregation(spark.createDataFrame(rows, RANKED))).collect()}
    assert got == {"q": 2, "p": 77}
    assert robust_rank_aggregation(spark.createDataFrame([], RANKED)).count() == 0
