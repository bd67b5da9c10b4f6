import pytest

from keelson.operators import advice, findings, moves, search, symbols, targets


def test_symbol_moves_to_its_only_user():
    s = {
        0: symbols.Symbol(0, "helper", "Symbol", "a.py", "p", 5), 1: symbols.Symbol(1, "stay", "Symbol", "a.py", "p", 5),
        2: symbols.Symbol(2, "user", "Symbol", "b.py", "p", 5), 3: symbols.Symbol(3, "deep", "Type", "b.py", "p", 5),
    }
    edges = [(2, 0, 1.0), (0, 3, 1.0)]
    cost = lambda now: sum(w for a, b, w in edges if now[a] != now[b])
    assert symbols.polish(s, edges, {"a.py": "p", "b.py": "p"}, cost) == {0: "b.py", 1: "a.py", 2: "b.py", 3: "b.py"}
    reach = {("a.py", "b.py"), ("b.py", "a.py")}
    ok = lambda **k: symbols.admissible(symbols.Symbol(**{**s[0].__dict__, **k}), "b.py", s, {i: x.file for i, x in s.items()}, edges, {"a.py": "p", "b.py": "p"}, reach)
    assert ok() and not ok(package="q") and not ok(name="user") and not ok(size=700) and not ok(pinned=True) and not ok(test=True) and not ok(kind="FileBody")


def test_nominations(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (1, 3, 0.5), (4, 1, 2.0), (5, 1, 9.0)], "source long, target long, weight double")
    n = spark.createDataFrame([(1, "Symbol", "a"), (2, "Symbol", "b"), (3, "Symbol", "c"), (4, "Symbol", "b"), (5, "Symbol", "t")], "id long, kind string, file string")
    zone = spark.createDataFrame([("t",)], "file string")
    got = [tuple(r) for r in symbols.nominations(e, n, zone).filter("id = 1").orderBy("rank").collect()]
    assert got == [(1, "b", 3.0, 1), (1, "c", 0.5, 2)]


def test_targets():
    before = {"a/x": "a", "a/y": "a", "b/z": "b"}
    after = {"a/x": "a", "a/y": "b", "b/z": "b"}
    assert targets.preserve_dir(before, before, "a") is None and targets.preserve_dir(before, after, "a")
    assert targets.keep_together(after, ["a/y", "b/z"]) is None and targets.keep_together(after, ["a/x", "a/y"])
    assert targets.separate(after, ["a/x"], ["b/z"]) is None and targets.separate(after, ["a/y"], ["b/z"])
    assert targets.size_band(after, 2) is None and targets.size_band(after, 1)
    assert targets.move_budget(before, after, 1) is None and targets.move_budget(before, after, 0)
    assert targets.no_synthetic_bucket(before, after) is None and targets.no_synthetic_bucket(before, {**after, "a/x": "p/workspace"})
    tokens = {f: frozenset({f[-1]}) for f in after}
    assert targets.name_alignment(after, tokens, {"a": frozenset("x"), "b": frozenset("yz")}, 1.0) is None
    assert targets.non_inversion(1.0, [0.5]) is None and targets.non_inversion(1.0, [1.5])
    assert targets.preserve_symbol_home({1: "a"}, {1: "a"}, [1]) is None and len(targets.KINDS) == 10


def test_roof_rebuild_groups_by_token():
    f = {n: search.File(n, 1, "r/workspace", "r/workspace", "r", True, frozenset(n.split(".")[0].split("_"))) for n in ("user_a.py", "user_b.py", "zed.py")}
    x = search.roof_rebuild(search.Layout(f, {p: v.folder for p, v in f.items()}, {}))
    assert x.folder == {"user_a.py": "r/user", "user_b.py": "r/user", "zed.py": "r/workspace"}
    assert search.roof_rebuild(search.Layout(f, {p: v.folder for p, v in f.items()}, {("user_a.py", "user_b.py"): 1.0})) is None


def test_move_groups_and_reasons(spark):
    rows = [("f1", 5, "a", "c"), ("f2", 3, "b", "c"), ("f3", 1, "a", "d"), ("f4", 1, "a", "a"), ("f5", 1, "e", "g")]
    g = moves.move_groups(spark.createDataFrame(rows, "file string, size long, origin string, destination string"))
    assert {(r.destination, r.files, r.kind, r.main_origin) for r in g.collect()} == {("c", 2, "Merge", "a"), ("d", 1, "Split", "a"), ("g", 1, "Move", "e")}
    one = lambda v, name: spark.createDataFrame([(v,)], f"{name} string")
    why = moves.move_reasons(g, one("e", "origin"), spark.createDataFrame([("d", "x")], "destination string, puller string"), one("c", "destination"))
    assert {(r.destination, r.reason) for r in why.collect()} == {("c", "NamingCohesion"), ("d", "PulledBy"), ("g", "RelievesOverCap")}


def test_visibility_ladder(spark):
    rungs = spark.createDataFrame([(1, 0, ["a"], "private", 2), (1, 1, ["a", "b"], "pub(super)", 2), (1, 2, ["a", "b", "c"], "pub", 2), (2, 0, ["a"], "private", 0)], "node long, rung int, files array<string>, spelling string, declared_rung int")
    used = spark.createDataFrame([(1, ["b"]), (2, ["a"])], "node long, files array<string>")
    assert [tuple(r) for r in findings.ladder_verdicts(rungs, used).collect()] == [(1, 1, "pub(super)")]


def test_consensus(spark):
    ddl = "subject long, destination long, profile string, qualified boolean, weighted double, structural double, margin double"
    rows = [(1, 9, "a", True, 0.9, 0.9, 0.5), (1, 9, "g", True, 0.9, 0.9, 0.5), (2, 9, "a", False, 0.1, 0.9, 0.5), (3, 8, "a", True, 0.9, 0.9, 0.5), (3, 7, "g", True, 0.8, 0.9, 0.5)]
    got = {r.subject: (r.recommended, r.reasons) for r in advice.consensus(spark.createDataFrame(rows, ddl), 2).collect()}
    assert got == {1: (True, []), 2: (False, ["PartialProfileSupport", "WeakEvidence", "NoMajoritySupport"]), 3: (False, ["ConflictingDestinations", "NoMajoritySupport"])}


def test_gate_and_order(spark):
    f = spark.createDataFrame([("Capacity", "Borderline", ["a"], "x"), ("Cycle", "Violation", ["b"], "y"), ("Cycle", "Violation", ["b"], "y")], "kind string, severity string, location array<string>, detail string")
    assert [r.kind for r in findings.ranked(f).collect()] == ["Cycle", "Capacity"]
    code = lambda *rules: findings.gate(f, rules).first().exit_code
    assert (code("cycle"), code("capacity"), code("cycle:borderline"), code("test-only"), code()) == (2, 0, 0, 0, 0)


def test_reach_counts_distance(spark):
    p = spark.createDataFrame([(1, 0, 9, ["r"]), (2, 0, 9, ["r", "s"]), (3, 0, 9, ["q"])], "subject long, source long, destination long, destination_segments array<string>")
    use = spark.createDataFrame([(i, f"f{k}", ["r", "s", str(k)]) for i in (1, 2, 3) for k in (1, 2)], "subject long, file string, folder array<string>")
    got = {r.subject: r.architectural_reach for r in advice.architectural_reach(p, use).collect()}
    assert got == {1: pytest.approx(0.5), 2: 1.0, 3: 0.0}
