import math
import random

import pytest

from keelson import schema
from keelson.operators import cluster, moves, partition, score, search


def files(*rows):
    return {r[0]: search.File(*r) for r in rows}


def layout(fs, edges, profile=schema.ANCHORED, caps=schema.CAPS):
    return search.Layout(fs, {p: f.folder for p, f in fs.items()}, edges, profile, caps)


def test_golden_objectives():
    ws = ("r/workspace", "r/workspace", "r", True)
    two = files(("alpha.py", 2, *ws, frozenset({"alpha"})), ("beta.py", 2, *ws, frozenset({"beta"})))
    both = {("alpha.py", "beta.py"): 1.0, ("beta.py", "alpha.py"): 1.0}
    assert search.score(layout(two, both)) == pytest.approx(-0.075)
    assert search.score(layout(two, both, schema.GREENFIELD)) == pytest.approx(0.125)
    leak = files(("service.py", 3, *ws, frozenset({"service"})), ("conftest.py", 0, *ws, frozenset({"conftest"}), False, True))
    zoned, edge = {("service.py", "conftest.py"): 0.0}, {("service.py", "conftest.py"): 1.0}
    for profile, want in ((schema.ANCHORED, 0.025), (schema.GREENFIELD, 0.225)):  # one empty file: imbalance 1
        x = search.Layout(leak, {p: f.folder for p, f in leak.items()}, zoned, profile, priced=edge)
        assert search.score(x) == pytest.approx(want)
    one = files(("lib.rs", 5, *ws, frozenset({"lib"})))
    assert search.score(layout(one, {}), inner_mass=5.0) == pytest.approx(-0.1375)
    assert search.score(layout(one, {}, schema.GREENFIELD), inner_mass=5.0) == pytest.approx(0.0625)


def test_search_moves_a_stray_file_only_when_it_pays():
    rows = [(f"a/f{i}.py", 10, "p/a", "p/a", "p", False, frozenset({"f"})) for i in range(3)] + [(f"b/g{i}.py", 10, "p/b", "p/b", "p", False, frozenset({"g"})) for i in range(3)]
    fs = files(*rows, ("b/stray.py", 10, "p/b", "p/b", "p", False, frozenset({"f"})))
    edges = {("b/stray.py", f"a/f{i}.py"): 5.0 for i in range(3)}
    free = schema.GREENFIELD | {"lambda": 0.0}
    got = search.search(layout(fs, edges, free))
    folder = got["candidates"][0][1].folder
    assert got["standing"] == "Outscored" and len({folder["b/stray.py"], *(folder[f"a/f{i}.py"] for i in range(3))}) == 1
    assert got["candidates"][0][0] < got["current"]
    assert search.search(layout(fs, edges, schema.ANCHORED | {"mu": 100.0}))["standing"] == "Optimal"


def test_guards():
    fs = files(("p/a/x.py", 1, "p/a", "p/a", "p"), ("p/b/x.py", 1, "p/b", "p/b", "p"), ("q/c/y.py", 1, "q/c", "q/c", "q"), ("p/t/z.py", 1, "p/t", "p/t", "p", False, frozenset(), False, True))
    x = layout(fs, {})
    assert not search.admissible(x, ["p/a/x.py"], "p/b")  # same base name
    assert not search.admissible(x, ["p/a/x.py"], "q/c") and search.admissible(x, ["p/a/x.py"], "q/c", cross_package=True)
    assert not search.admissible(x, ["p/a/x.py"], "p/t")  # test zone


def test_relief_splits_over_full_folders():
    fs = files(*[(f"a/m{i}.py", 5, "p/a", "p/a", "p") for i in range(24)])
    edges = {(f"a/m{i}.py", f"a/m{i + 1}.py"): 1.0 for i in range(7)}
    got = search.relieve(layout(fs, edges))
    assert sorted(p for p in fs if got.folder[p] == "p/a/m") == sorted(f"a/m{i}.py" for i in range(8))


def test_election():
    from collections import Counter

    assert search.elect(Counter({"core": 3, "util": 1}), "x") == "core"
    assert search.elect(Counter({"a/b": 2, "a/c": 2}), "x") == "a"
    assert search.elect(Counter({"one": 2, "two": 1, "six": 1}), "x") == "one-six"
    assert search.elect(Counter({"12": 1}), "x") == "12 (x)"


def test_clusters_keep_bounds():
    rng = random.Random(2)
    for _ in range(25):
        n, cap = rng.randint(2, 30), rng.randint(2, 6)
        edges = [(i, j, float(rng.randint(1, 5))) for i in range(n) for j in range(i) if rng.random() < 0.15]
        first = cluster.seed([1.0] * n, edges, cap)
        got = cluster.cluster_level([1.0] * n, edges, cap)
        assert max(got.count(c) for c in set(got)) <= cap
        assert cluster.acyclic(max(got) + 1, cluster.quotient(got, edges))
        assert cluster.cut_weight(cluster.refine(first, [1.0] * n, edges, cap), edges) <= cluster.cut_weight(first, edges)


def test_variation_of_information(spark):
    assert partition.vi([0, 0, 1], [5, 5, 7]) == 0.0
    assert partition.vi([0] * 6, range(6)) == pytest.approx(math.log(6))
    x = spark.createDataFrame([(i, 0) for i in range(6)], "vertex long, cluster long")
    y = spark.createDataFrame([(i, i) for i in range(6)], "vertex long, cluster long")
    assert partition.vi_distance(x, y).first().vi == pytest.approx(math.log(6))
    f = partition.pair_f1(x, y).first()
    assert (f.precision, f.recall, f.f1) == (1.0, 0.0, 0.0)


def test_diversify():
    c = [(1.0, [0, 0, 1, 1]), (1.01, [0, 0, 1, 1]), (1.02, [0, 1, 0, 1]), (2.0, [0, 1, 2, 3])]
    assert partition.diversify(c, k=3) == ([0, 2], True)
    assert partition.diversify([], 3) == ([], True)


def test_group_cohesion_matches_pairs(spark):
    rng = random.Random(4)
    rows = [(g, m, rng.sample("abcd", rng.randint(0, 3)), float(rng.randint(1, 5))) for g in range(4) for m in range(rng.randint(1, 9))]
    got = {r.grp: r.cohesion for r in score.group_cohesion(spark.createDataFrame(rows, "grp long, member long, tokens array<string>, mass double")).collect()}
    for g in got:
        sets = [set(t) for gg, _, t, _ in rows if gg == g]
        pairs = [len(a & b) / len(a | b) if a | b else 0.0 for i, a in enumerate(sets) for b in sets[:i]]
        assert got[g] == pytest.approx(sum(pairs) / len(pairs) if pairs else 0.0)


def test_mirrors_and_collisions(spark):
    f = spark.createDataFrame([("src/a/x.ts",), ("tests/a/x.test.ts",), ("src/b/y.ts",)], "path string")
    c = moves.mirror_candidates(f, "src/{dir}/{stem}.ts", "tests/{dir}/{stem}.test.ts")
    assert [tuple(r) for r in moves.test_pairs(c, f).collect()] == [("src/a/x.ts", "tests/a/x.test.ts")]
    p = spark.createDataFrame([("a.py", "b.py"), ("b.py", "b.py"), ("c.py", "c.py")], "file string, path string")
    assert {(r.file, r.keeps) for r in moves.collisions(p).collect()} == {("a.py", False), ("b.py", True)}
