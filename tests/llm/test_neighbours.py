import numpy as np
import pyarrow as pa
import pytest

from corbel.llm.neighbours import _best, hilbert, mutual_pairs, nearest


def test_hilbert_is_a_walk():
    for axes, bits in [(2, 3), (3, 2), (4, 1)]:
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        walk = grid[np.argsort(hilbert(grid, bits))]
        assert sorted(hilbert(grid, bits).tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_best_finds_the_largest():
    rng = np.random.default_rng(1)
    for width in (10, 320, 3200):
        sims = rng.normal(size=(20, width)).astype(np.float32)
        cols, values = _best(sims, 10)
        assert np.allclose(np.sort(values, axis=1), np.sort(sims, axis=1)[:, -10:])
        assert np.allclose(np.take_along_axis(sims, cols, 1), values)


def _brute(x, ids, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {i: [ids[j] for j in np.argsort(-s[r], kind="stable")[:k]] for r, i in enumerate(ids)}


SCHEMA = "chunk_id long, model string, embedding array<float>, key long"


def test_small_models_are_exact_and_odd_rows_are_left_out(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 64)) * rng.uniform(0.01, 1e6, (300, 1))
    rows = [(i, "a" if i < 200 else "b", x[i].tolist(), 0) for i in range(300)]
    bad = [None, [], [0.0] * 64, [float("nan")] * 64, [1.0] * 32, [None] * 64, [float("inf")] + [0.0] * 63]
    rows += [(1000 + i, "a", e, 0) for i, e in enumerate(bad)] + rows[:5] + [(None, "a", [1.0] * 64, 0), (5000, None, [1.0] * 64, 0), (6000, "lone", [1.0] * 64, 0)]
    got = {(r.model, r.chunk_id): r for r in nearest(spark.createDataFrame(rows, SCHEMA), curves=4).collect()}
    want = {("a", i): v for i, v in _brute(x[:200], list(range(200)), 10).items()} | {("b", i): v for i, v in _brute(x[200:], list(range(200, 300)), 10).items()} | {("lone", 6000): []}
    # The column holds floats: neighbours whose cosines agree to seven places may stand in either order.
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got.keys() == want.keys()
    for (model, i), r in got.items():
        assert set(r.neighbours) == set(want[model, i]) and len(r.neighbours) == len(want[model, i])
        assert all(a == b or abs(u[i] @ u[a] - u[i] @ u[b]) < 1e-7 for a, b in zip(r.neighbours, want[model, i], strict=True))
    assert all(list(r.cosines) == sorted(r.cosines, reverse=True) for r in got.values())


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    x[3000:3300] = x[:300] + rng.normal(size=(300, 64)) * 0.1
    df = spark.createDataFrame([(i, "a", v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    near = nearest(df)
    got = {r.chunk_id: r.neighbours for r in near.collect()}
    want = _brute(x, list(range(6000)), 10)
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / 60_000 >= 0.9
    assert {tuple(r) for r in mutual_pairs(near).collect()} == {(i, 3000 + i) for i in range(300)}


def test_identical_vectors_and_empty_table(spark):
    df = spark.createDataFrame([(i, "a", [1.0] * 64, 0) for i in range(2000)], SCHEMA)
    rows = nearest(df).collect()
    assert len(rows) == 2000 and all(len(set(r.neighbours) - {r.chunk_id}) == 10 for r in rows)
    assert nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("cosine", [0.999, 0.9])
def test_recall_with_a_third_of_the_rows_in_one_group(spark, cosine):
    rng = np.random.default_rng(9)
    n, hot = 36_000, 12_000
    x = rng.normal(size=(n, 64))
    # Members at this cosine of each other: a common direction and noise of their own.
    noise = rng.normal(size=(hot, 64))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    x[:hot] = np.sqrt(cosine) * x[0] / np.linalg.norm(x[0]) + np.sqrt(1 - cosine) * noise
    rows = pa.table({"chunk_id": np.arange(n), "model": ["a"] * n, "embedding": pa.array(list(x.astype(np.float32)))})
    got = {r.chunk_id: r.neighbours for r in nearest(spark.createDataFrame(rows)).where("chunk_id % 30 = 0").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for part in (range(0, hot, 30), range(hot, n, 30)):
        s = u[list(part)] @ u.T
        s[np.arange(len(part)), list(part)] = -2
        best = np.argpartition(-s, 10, axis=1)[:, :10]
        assert sum(len(set(got[i]) & set(best[r].tolist())) for r, i in enumerate(part)) / (10 * len(part)) >= 0.9


def test_equal_vectors_are_neighbours_by_id(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(3000, 64))
    x[1000:2500] = x[0]  # half of the rows
    x[2500:2503] = x[1]
    got = {r.chunk_id: r for r in nearest(spark.createDataFrame([(i, "a", v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)).collect()}
    same = [0, *range(1000, 2500)]
    assert len(got) == 3000 and all(len(r.neighbours) == len(r.cosines) == 10 for r in got.values())
    assert all(got[i].neighbours == [j for j in same[:11] if j != i][:10] for i in same)
    assert all(got[i].neighbours[:3] == [j for j in (1, 2500, 2501, 2502) if j != i] for i in (1, 2500, 2501, 2502))
