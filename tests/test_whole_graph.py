"""Traversals and cycles over all edges, by brute force on a small fixture with every kind and confidence."""

import json
import random

import pytest

from corbel.plans.queries import QUERIES

KINDS = ["purchase", "signup", "error", "click", "view"]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(60)] + [(50, 51), (51, 52), (52, 50), (60, 60)]
    rows = [(i, a, json.dumps({"k": b}), KINDS[i % 5]) for i, (a, b) in enumerate(pairs)] + [(900, None, json.dumps({"k": 1}), "view"), (901, 2, "{}", "view")]
    d = str(tmp_path_factory.mktemp("graph"))
    spark.createDataFrame(rows, "event_id long, user_id long, props string, event_type string").write.parquet(f"{d}/events.parquet")
    return d, pairs, sorted({r[1] for r in rows if r[1] is not None})


def _reach(pairs, start, depth=99, reverse=False):
    out, level = {start: 0}, {start}
    for n in range(1, depth + 1):
        level = {a if reverse else b for a, b in pairs if (b if reverse else a) in level} - out.keys()
        out |= dict.fromkeys(level, n)
    return {k: v for k, v in out.items() if v}


def _rows(spark, name, d):
    return QUERIES[name](spark, d).collect()


def test_traversals_take_every_edge(spark, events):
    d, pairs, ids = events
    assert {(r.node, r.depth) for r in _rows(spark, "callees_all", d)} == set(_reach(pairs, ids[0], 4).items())
    assert {(r.node, r.depth) for r in _rows(spark, "blast_radius_all", d)} == set(_reach(pairs, ids[0], 6, True).items())
    for name, n, depth in [("callers_depth1_all", 3, 1), ("callers_with_override_all", 5, 3)]:
        assert {(r.start, r.node, r.depth) for r in _rows(spark, name, d)} == {(s, *x) for s in ids[:n] for x in _reach(pairs, s, depth, True).items()}
    by = [(r.depth, r.reached) for r in _rows(spark, "blast_radius_by_depth_all", d)]
    depths = list(_reach(pairs, ids[0], 6, True).values())
    assert sorted(by) == sorted((x, depths.count(x)) for x in set(depths))
    near = {}
    for s in ids[:4]:
        for node, x in _reach(pairs, s, 3, True).items():
            near[node] = min(near.get(node, (99, 99)), (x, s))
    assert {(r.node, r.depth, r.start) for r in _rows(spark, "blast_radius_multi_all", d)} == {(n, *v) for n, v in near.items()}
    shape = _rows(spark, "traversal_shape_all", d)
    for s in ids[:2]:
        want = _reach(pairs, s, 3, True)
        mine = sorted((r.place, r.node, r.depth, r.total) for r in shape if r.start == s)
        assert [r[2] for r in mine] == sorted(want.values())[:10] and all(want[r[1]] == r[2] and r[3] == len(want) for r in mine)


def test_cycles_take_every_edge(spark, events):
    d, pairs, _ = events
    nodes = {x for p in pairs for x in p}
    ahead = {n: {b for a, b in pairs if a == n} for n in nodes}
    ahead = {n: set().union(*[{m} | _reach(pairs, m).keys() for m in ahead[n]]) if ahead[n] else set() for n in nodes}
    of = {n: max(m for m in ahead[n] if n in ahead[m]) for n in nodes if n in ahead[n]}
    assert {(r.node, r.component) for r in _rows(spark, "scc_components_all", d)} == set(of.items())
    # The shortest way from n back to itself, by the step after it.
    back = {n: min(1 + (0 if m == n else _reach(pairs, m)[n]) for a, m in pairs if a == n and (m == n or n in _reach(pairs, m))) for n in of}
    want = {c: min(back[n] for n in of if of[n] == c) for c in of.values()}
    assert {r.component: r.length for r in _rows(spark, "cycles_shortest_all", d)} == want
    got = {r["first"]: (r["size"], r.members_omitted) for r in _rows(spark, "cycle_report_all", d)}
    groups = [[n for n in of if of[n] == c] for c in set(of.values())]
    assert got == {min(g): (len(g), max(len(g) - 20, 0)) for g in groups}
