import random

import pytest

from corbel.operators import cycles, graph, lookup

E = "id long, src long, dst long, kind string, confidence double"


def _edges(spark, pairs, kind="calls", confidence=1.0):
    return spark.createDataFrame([(i + 1, a, b, kind, confidence) for i, (a, b) in enumerate(pairs)], E)


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def _closure(pairs, start, depth):
    level, seen, out = {start}, {start}, {}
    for d in range(1, depth + 1):
        level = {b for a, b in pairs if a in level} - seen
        seen |= level
        out |= dict.fromkeys(level, d)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_traversal_equals_the_naive_closure(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randint(2, 13)
    rows = [(i + 1, rnd.randrange(n), rnd.randrange(n), rnd.choice(["imports", "calls"]), rnd.choice([0.25, 0.5, 1.0])) for i in range(rnd.randint(1, 40))]
    df, depth = spark.createDataFrame(rows, E), rnd.randint(1, 6)
    starts = rnd.sample(range(n), min(3, n))
    kept = [(a, b) for _, a, b, k, c in rows if k == "calls" and c >= 0.5]
    paths = graph.traverse(df, _ids(spark, *starts), depth, False, ("calls",), 0.5).collect()
    for s in starts:
        mine = [p for p in paths if p.start == s]
        assert {p.node: p.depth for p in mine} == _closure(kept, s, depth)
        for p in mine:
            assert p.nodes[0] == s and p.nodes[-1] == p.node and len(p.edge_ids) == p.depth and len(set(p.nodes)) == len(p.nodes)
            for a, b, e in zip(p.nodes, p.nodes[1:], p.edge_ids, strict=False):
                assert (rows[e - 1][1], rows[e - 1][2]) == (a, b)


def test_traversal_edge_cases(spark):
    df = _edges(spark, [(1, 1), (1, 2), (1, 2), (2, 1), (5, 6)])
    assert graph.callees(df, _ids(spark, 1), 0).count() == 0
    assert [(p.node, p.depth) for p in graph.callees(df, _ids(spark, 1), 9).collect()] == [(2, 1)]
    assert graph.callees(df, _ids(spark, 99), 3).count() == 0 and graph.callees(df.limit(0), _ids(spark, 1), 3).count() == 0


def test_callers_follow_overrides(spark):
    df = spark.createDataFrame([(1, 12, 11, "implements", 1.0), (2, 21, 12, "calls", 1.0), (3, 30, 11, "calls", 1.0)], E)
    depths = lambda n: {p.node for p in graph.callers(df, _ids(spark, 11), n, ("calls",)).collect()}
    assert depths(2) == {12, 21, 30} and depths(1) == {12, 30}
    assert {p.node for p in graph.blast_radius(df, _ids(spark, 11), 5).collect()} == {30}


def test_several_starts_shape_and_histogram(spark):
    df = spark.createDataFrame([(1, 2, 1, "calls", 0.5), (2, 3, 1, "calls", 1.0), (3, 4, 2, "imports", 1.0), (4, 1, 4, "calls", 1.0)], E)
    paths = graph.blast_radius(df, _ids(spark, 1, 4), 5)
    got = {r.node: (r.depth, r.start) for r in graph.affected(paths).collect()}
    assert got == {2: (1, 1), 3: (1, 1), 1: (1, 4), 4: (2, 1)}
    one = graph.blast_radius(df, _ids(spark, 1), 5)
    shaped = graph.shape(one, 2).orderBy("place").collect()
    assert [(r.node, r.depth, r.parent, r.edge_id, r.total, r.truncated) for r in shaped] == [(3, 1, 1, 2, 3, True), (2, 1, 1, 1, 3, True)]
    assert {(r.depth, r.reached) for r in graph.depth_histogram(one).collect()} == {(1, 2), (2, 1)}
    files = spark.createDataFrame([(2, 7, "a"), (3, 7, "b"), (4, 8, "c")], "id long, file_id long, qualified_name string")
    assert {(r.file_id, r.affected) for r in graph.by_file(graph.affected(one), files).collect()} == {(7, 2), (8, 1)}
    both = graph.call_graph(df, _ids(spark, 1), 3)
    assert {(r.direction, r.node) for r in both.collect()} == {("callers", 2), ("callers", 3), ("callees", 4)}


def _tarjan(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: set(_closure(pairs, n, 99)) | ({n} if (n, n) in pairs or any((n, m) in pairs and n in _closure(pairs, m, 99) for m in nodes) else set()) for n in nodes}
    return {n: max(m for m in reach[n] if n in reach[m]) for n in nodes if n in reach[n]}


def test_known_components_and_cycles(spark):
    df = _edges(spark, [(1, 2), (2, 3), (3, 4), (4, 1), (2, 1), (7, 8), (8, 7), (5, 5), (9, 1)])
    parts = cycles.components(df)
    assert {r.node: r.component for r in parts.collect()} == {1: 4, 2: 4, 3: 4, 4: 4, 7: 8, 8: 8, 5: 5}
    found = cycles.shortest_cycles(df, parts)
    assert {tuple(r.cycle) for r in found.collect()} == {(1, 2, 1), (7, 8, 7), (5, 5)}
    report = cycles.cycle_report(parts, found, 2, 3).orderBy("size", ascending=False).collect()
    assert [(r.first, r.size, r.members, r.members_omitted, r.cycle) for r in report] == [(1, 4, [1, 2, 3], 1, [1, 2, 1]), (7, 2, [7, 8], 0, [7, 8, 7])]


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_mutual_reach(spark, seed):
    rnd = random.Random(seed)
    pairs = {(rnd.randrange(12), rnd.randrange(12)) for _ in range(rnd.randint(3, 22))}
    assert {r.node: r.component for r in cycles.components(_edges(spark, sorted(pairs))).collect()} == _tarjan(pairs)


def test_no_cycles(spark):
    for pairs in ([(1, 2), (2, 3)], [(i, i + 1) for i in range(9)]):
        parts = cycles.components(_edges(spark, pairs))
        assert parts.count() == 0 and cycles.shortest_cycles(_edges(spark, pairs), parts).count() == 0


def test_edges(spark):
    df = spark.createDataFrame([(1, 1, 2, "calls", 0.5), (2, 1, 2, "calls", 1.0), (3, 1, 2, "imports", None), (4, None, 2, "calls", 1.0)], E)
    assert {(r.src, r.kind, r.confidence, r.id) for r in graph.dedup_edges(df).collect()} == {(1, "calls", 1.0, 1), (1, "imports", None, 3), (None, "calls", 1.0, 4)}
    assert lookup.edge_filter(df, (), 0.0).count() == 4 and lookup.edge_filter(df, ("calls",), 0.75).count() == 2
    assert graph.adjacency(df, True).count() == 3
    assert {r.id for r in graph.relationships_of(_ids(spark, 1), df).collect()} == {1, 2, 3}
    assert {r.id for r in lookup.callers_of(df, _ids(spark, 2)).collect()} == {1, 2, 3, 4} and lookup.callees_of(df, _ids(spark, 1)).count() == 3


def test_lookups(spark):
    s = spark.createDataFrame([(1, 1, 5, "f", "m.f"), (2, 1, 9, "f", "m.C.f"), (3, 2, 1, "m.f", "x.m.f"), (4, 2, 1, "f", "m.f")], "id long, file_id long, start_line int, name string, qualified_name string")
    n = spark.createDataFrame([("a", "m.f"), ("b", "f"), ("c", "zzz")], "query_id string, name string")
    got = {(r.query_id, r.id, r.match) for r in lookup.find_definition(s, n).collect()}
    assert got == {("a", 1, "qualified"), ("a", 4, "qualified"), ("b", 1, "bare"), ("b", 2, "bare"), ("b", 4, "bare")}
    assert [(r.query_id, r.id) for r in lookup.find_by_qualified_name(s, n).collect()] == [("a", 1)]
    assert {r.query_id: (r.candidates, r.outcome) for r in lookup.describe_candidates(lookup.find_by_name(s, n)).collect()} == {"a": (1, "resolved"), "b": (3, "ambiguous")}
    assert lookup.by_ids(s, _ids(spark, 1, 1, 77)).count() == 1
    assert lookup.bound("n", 0, 5, 9) == (5, None) and lookup.bound("n", 99, 5, 9)[0] == 9
    with pytest.raises(ValueError, match="negative"):
        lookup.bound("n", -1, 5, 9)
    with pytest.raises(Exception, match="unknown kind"):
        s.select(lookup.closed_set(s["name"], ["f"], "kind")).collect()
