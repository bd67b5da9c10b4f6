import itertools
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.operators import graph, kernels
from keelson.operators.components import connected_components

EDGES = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=40)


def reach(pairs):
    r = {(a, b) for a, b in pairs}
    while True:
        more = r | {(a, d) for a, b in r for c, d in r if b == c}
        if more == r:
            return r
        r = more


def slow_scc(pairs):
    r = reach(pairs)
    nodes = {v for p in pairs for v in p}
    return {v: min([v, *(w for w in nodes if (v, w) in r and (w, v) in r)]) for v in nodes}


@settings(max_examples=100, deadline=None)
@given(EDGES)
def test_strong_components(pairs):
    assert dict(kernels.strong_components([a for a, _ in pairs], [b for _, b in pairs])) == slow_scc(pairs)


@settings(max_examples=100, deadline=None)
@given(EDGES)
def test_layers_descend(pairs):
    pairs = [(max(p), min(p)) for p in pairs if p[0] != p[1]]
    if pairs:
        layer = dict(kernels.longest_layers([a for a, _ in pairs], [b for _, b in pairs]))
        assert all(layer[a] > layer[b] for a, b in pairs)
        assert all(n == 1 or any(layer[b] == n - 1 for a, b in pairs if a == v) for v, n in layer.items())


def brute_cut(edges):
    nodes = sorted({v for e in edges for v in e[:2]})
    return min(sum(w for s, d, w in edges if p.index(s) > p.index(d)) for p in itertools.permutations(nodes))


def test_feedback_arcs_are_cheapest():
    rng = random.Random(1)
    for _ in range(40):
        price = {(rng.randrange(5), rng.randrange(5)): rng.randint(1, 9) for _ in range(12)}
        edges = [(a, b, float(w)) for (a, b), w in price.items() if a != b]
        if edges:
            cuts, exact = kernels.feedback_arcs(edges)
            assert exact and sum(w for *_, w in cuts) == brute_cut(edges)
            got, proven = kernels._branch({e[:2]: e[2] for e in edges}, kernels.heuristic_arcs({e[:2]: e[2] for e in edges}), float("inf"))
            assert proven and sum(price[e] for e in got) == brute_cut(edges)


def test_knots_and_prices():
    cuts, exact = kernels.feedback_arcs([(0, 1, 1.0), (1, 2, 0.25), (2, 0, 1.0)])
    assert (cuts, exact) == ([(1, 2, 0.25)], True)
    cuts, _ = kernels.feedback_arcs([(0, 1, None), (1, 0, None)])
    assert cuts == [(1, 0, 1.0)]
    ring = [(i, (i + 1) % 40, 1.0) for i in range(40)]
    cuts, exact = kernels.feedback_arcs(ring)
    assert len(cuts) == 1 and exact
    assert not kernels.feedback_arcs(ring, exact_vertices=0)[1]


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_condense_locally_and_by_colouring(spark, limit):
    rng = random.Random(3)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(60)]
    got = {r.node: r.scc for r in graph.condense(frame(spark, pairs), local_edges=limit).collect()}
    assert got == slow_scc(pairs)


def test_heuristic_takes_large_components():
    rng, n = random.Random(5), 30_000
    ring = list(range(n))
    rng.shuffle(ring)
    edges = [(a, b, 1.0) for a, b in zip(ring, ring[1:] + ring[:1])] + [(rng.randrange(n), rng.randrange(n), 1.0) for _ in range(n // 5)]
    start = time.process_time()
    cuts, exact = kernels.feedback_arcs(edges)
    assert time.process_time() - start < 60  # looking at every place of every vertex took many minutes
    left = {e[:2] for e in edges} - {e[:2] for e in cuts}
    rank = kernels.topological(n, sorted(e for e in left if e[0] != e[1]))
    assert not exact and sorted(rank) == list(range(n)) and len(cuts) < n // 10


def test_layers_closure_quotient(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (0, 4), (7, 7)]
    e = frame(spark, pairs)
    m = graph.condense(e)
    q = graph.quotient(e, m)
    assert {(r.src, r.dst, r.weight) for r in q.collect()} == {(0, 3, 1.0), (3, 4, 1.0), (0, 4, 1.0)}
    for limit in (1_000_000, 0):
        assert {(r.node, r.layer) for r in graph.layers(q, m.selectExpr("scc as node"), limit).collect()} == {(0, 3), (3, 2), (4, 1), (7, 1)}
    assert {tuple(r) for r in graph.closure(e).collect()} == reach(pairs)
    c = graph.cycle_counts(e, m).first()
    assert (c.cyclic_nodes, c.cyclic_edges) == (3, 3)


@pytest.mark.parametrize(("limit", "width"), [(1_000_000, 4), (1_000_000, 1024), (40, 4)])
def test_closure_in_slices(spark, monkeypatch, limit, width):
    monkeypatch.setattr(graph, "SLICE", width)
    rng = random.Random(6)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(100, 101), (101, 100), (200, 200), (300, 301)]
    pairs += [(1000 + i, 1000 + rng.randrange(25)) for i in range(25) for _ in range(2)]
    got = [tuple(r) for r in graph.closure(frame(spark, pairs), limit).collect()]
    assert len(got) == len(set(got)) and set(got) == reach(pairs)


def test_closure_of_many_pairs_is_not_shuffled(spark):
    out = graph.closure(frame(spark, [(i, i + 1) for i in range(50)]))
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.index("MapInArrow") < text.index("Exchange") and text.count("MapInArrow") == 1 and out.count() == 50 * 51 // 2


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    both = reach(pairs + [(b, a) for a, b in pairs])
    want = {a: min(b for x, b in both if x == a) for a, _ in both if any(x == a and b != a for x, b in both)}
    assert {r.vertex: r.component for r in connected_components(frame(spark, pairs)).collect()} == want


def test_re_export_chains(spark):
    ddl = "source long, target long"
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 5)], ddl)
    got = graph.flatten_re_exports(spark.createDataFrame([(1,), (5,), (9,)], "node long"), links)
    assert {tuple(r) for r in got.collect()} == {(1, 3, 2), (5, 5, 0), (9, 9, 0)}
    deep = spark.createDataFrame([(i, i + 1) for i in range(65)], ddl)
    with pytest.raises(graph.ReExportDepthExceeded):
        graph.flatten_re_exports(spark.createDataFrame([(0,)], "node long"), deep)


def test_shatter_rows(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (3, 4, 2.0), (4, 5, 0.5), (5, 3, 2.0)], "src long, dst long, weight double")
    got = {tuple(r) for r in graph.shatter(e, graph.condense(e)).collect()}
    assert got == {(0, 1, 0, 1.0, True), (3, 4, 5, 0.5, True)}
