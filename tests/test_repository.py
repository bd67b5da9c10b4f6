import json

import pytest

from keelson import cli, render
from keelson.errors import KeelsonError
from keelson.model import assemble, digest
from keelson.operators import search
from keelson.plans import analysis
from keelson.sources import brace_source, config, discovery, python_source, results


def write(root, **files):
    for name, text in files.items():
        p = root / name.replace("__", "/").replace("_dot_", ".")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


CYCLIC = {"alpha.py": "from beta import ping\n\n\ndef pong():\n    return ping()\n", "beta.py": "from alpha import pong\n\n\ndef ping():\n    return pong()\n"}


@pytest.fixture
def cyclic(tmp_path):
    for name, text in CYCLIC.items():
        (tmp_path / name).write_text(text)
    return tmp_path


def test_cyclic_repository_has_the_known_objective(spark, cyclic):
    cfg = config.defaults()
    cfg["analysis"]["profiles"] = ["anchored", "greenfield"]
    r = analysis.analyze(analysis.snapshot_from_path(spark, cyclic, cfg), cfg)
    assert (r["summary"]["files"], r["summary"]["nodes"], r["summary"]["edges"]) == (2, 2, 2)
    assert [round(p["current"]["score"], 4) for p in r["profiles"]] == [-0.075, 0.125]
    cycle = [f for f in r["sharedFindings"] if f["kind"] == "Cycle"]
    assert len(cycle) == 1 and cycle[0]["location"] == ["alpha.py", "beta.py"]
    assert "2 items" in render.summary(r) and "```" in render.markdown(r) and "alpha.py" in render.tree(r["profiles"][0]["current"]["tree"])


def test_polarity_and_test_only(spark, tmp_path):
    (tmp_path / "conftest.py").write_text("def sample_fixture():\n    return 1\n")
    (tmp_path / "service.py").write_text("from conftest import sample_fixture\n\n\ndef serve():\n    return sample_fixture()\n\n\ndef lonely():\n    return 2\n")
    (tmp_path / "test_service.py").write_text("from service import lonely\n\n\ndef test_it():\n    assert lonely() == 2\n")
    s = analysis.snapshot_from_path(spark, tmp_path)
    got = {(f.kind, tuple(f.location)) for f in analysis.structural(s, config.defaults(), "anchored").collect()}
    assert ("Polarity", ("service.py", "conftest.py")) in got and ("TestOnly", ("service.py",)) in got


def test_leaking_repository_has_the_known_objective(spark, tmp_path):
    (tmp_path / "conftest.py").write_text("def sample_fixture():\n    return 1\n")
    (tmp_path / "service.py").write_text("from conftest import sample_fixture\n\n\ndef serve():\n    return sample_fixture()\n")
    cfg = config.defaults()
    s = analysis.snapshot_from_path(spark, tmp_path, cfg)
    for profile, want in (("anchored", 0.025), ("greenfield", 0.225)):
        assert search.score(*analysis.layout_of(s, cfg, profile)) == pytest.approx(want)


def test_capacity_finding(spark, tmp_path):
    (tmp_path / "big.py").write_text("\n".join(f"A{i} = {i}" for i in range(300)) + "\n")
    cfg = config.from_document({"profiles": {"anchored": {"capacity": {"file": 250}}}})
    got = [f for f in analysis.structural(analysis.snapshot_from_path(spark, tmp_path, cfg), cfg, "anchored").collect() if f.kind == "Capacity"]
    assert [(f.severity, f.location) for f in got] == [("Violation", ["big.py"])]


def test_python_parser():
    rows = python_source.parse("pkg/mod.py", '"""Doc."""\nimport os.path as p\nfrom . import other\nfrom .sub import Base, helper as h\n__all__ = ["Child", "h"]\n\n\nclass Child(Base):\n    """Doc."""\n\n    def run(self, x: "Base"):\n        # note\n        h(x)\n        return other.thing + getattr(other, "late")\n')
    decl = {r[3]: (r[4], r[7]) for r in rows if r[2] == "declaration"}
    assert decl == {"Child": ("Type", 4)}
    uses = {(r[4], r[5], r[6]) for r in rows if r[2] == "use"}
    assert {("Base", "pkg.sub", "Base"), ("Call", "pkg.sub", "helper"), ("Annotation", "pkg.sub", "Base"), ("Ref", "pkg.other", "thing"), ("Dynamic", "pkg.other", "late")} <= uses
    assert {r[3] for r in rows if r[2] == "re_export"} == {"h"}
    with pytest.raises(KeelsonError, match="ADAPTER_PARSE_FAILURE.*line 1"):
        python_source.parse("bad.py", "def (:\n")


def test_python_binding_through_a_barrel(spark):
    files = spark.createDataFrame([("pkg/__init__.py", "from .inner import work\n"), ("pkg/inner.py", "def work():\n    return 1\n"), ("use.py", "from pkg import work\n\n\ndef go():\n    return work()\n")], "path string, contents string")
    got = python_source.bind(python_source.parse_files(files))
    names = {r.id: (r.path, r.name) for r in got["nodes"].collect()}
    edges = {(names[r.source], names[r.target], r.kind) for r in got["edges"].collect()}
    assert edges == {(("use.py", "go"), ("pkg/__init__.py", "work"), "Call"), (("pkg/__init__.py", "work"), ("pkg/inner.py", "work"), "ReExport")}


def test_typescript_and_rust_subset(spark):
    ts = "import { Base, help } from './base';\n// import { no } from './x'\nexport class Child extends Base {\n  run(o: Options) { return help('}'); }\n}\nexport interface Options { a: string }\n"
    base = "export class Base {}\nexport function help(s: string) { return s; }\n"
    rs = "use crate::util::{mix, Deep};\nfn main() { mix(1); odd_one(); }\n"
    util = "pub struct Deep;\npub fn mix(x: u8) -> u8 { x }\n"
    other = "pub fn odd_one() {}\n"
    files = spark.createDataFrame([("a/child.ts", ts), ("a/base.ts", base), ("src/main.rs", rs), ("src/util.rs", util), ("src/far.rs", other)], "path string, contents string")
    got = brace_source.bind(brace_source.parse_files(files))
    names = {r.id: r.name for r in got["nodes"].collect()}
    edges = {(names[r.source], names[r.target], r.kind, r.hardness, r.confidence) for r in got["edges"].collect()}
    assert {("Child", "Base", "Inheritance", "Hard", 1.0), ("Child", "help", "Call", "Hard", 1.0), ("Child", "Options", "TypeReference", "Soft", 1.0), ("main", "mix", "Call", "Hard", 1.0), ("main", "odd_one", "Call", "Soft", 0.6)} <= edges


def test_companions(spark):
    n = spark.createDataFrame([(1, "Symbol", "loadUser"), (2, "Type", "LoadUserOptions"), (3, "Type", "OtherOptions")], "id long, kind string, name string")
    assert [tuple(r) for r in brace_source.companions(n).collect()] == [(1, 2, "companion-owner")]


def test_discovery(tmp_path):
    write(tmp_path, a_dot_py="", node_modules__x_dot_ts="", out__y_dot_py="", pkg__Cargo_dot_toml="", pkg__src__l_dot_rs="", docs_dot_md="")
    (tmp_path / ".gitignore").write_text("out/\n")
    assert discovery.discover(tmp_path) == (["a.py", "pkg/src/l.rs"], ["pkg"])
    assert discovery.discover(tmp_path, exclude=["pkg/**"])[0] == ["a.py"]
    assert discovery.is_module_root("x/index.ts") and not discovery.is_module_root("x/indexes.ts")


def test_configuration(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text("[profiles.anchored.capacity]\nfile = 250\n")
    assert config.load_config(p)["profiles"]["anchored"]["capacity"]["file"] == 250
    for bad, key in (("[capacity]\nfile = 1\n", "capacity"), ("[analysis]\nmode = 'x'\n", "analysis.mode"), ("[profiles.anchored]\nodd = 1\n", "profiles.anchored.odd"), ("[profiles.greenfield.weights]\nsame-file-type = 0.5\n", "same-file-type"), ("x = ", "CONFIG_INVALID")):
        p.write_text(bad)
        with pytest.raises(KeelsonError, match=key):
            config.load_config(p)


def snapshot_tables(spark, **over):
    t = {
        "nodes": spark.createDataFrame([(0, "a", "Symbol", 0), (1, "b", "Symbol", 0)], "id long, name string, kind string, container long"),
        "edges": spark.createDataFrame([(0, 1, "Call", "Hard", 1.0)], "source long, target long, kind string, hardness string, confidence double"),
        "containers": spark.createDataFrame([(0, "f", "File", 1), (1, "d", "Folder", None)], "id long, name string, level string, parent long"),
    }
    return t | over


@pytest.mark.parametrize(
    ("name", "rows", "ddl", "defect"),
    [
        ("edges", [(0, 9, "Call", "Hard", 1.0)], "source long, target long, kind string, hardness string, confidence double", "dangling"),
        ("nodes", [(0, "a"), (0, "b"), (1, "c")], "id long, name string", "duplicate"),
        ("containers", [(0, "f", "File", None), (2, "d", "Folder", None)], "id long, name string, level string, parent long", "NonDenseIds"),
        ("containers", [(0, "f", "File", 7)], "id long, name string, level string, parent long", "MissingParent"),
        ("containers", [(0, "f", "File", 1), (1, "d", "File", None)], "id long, name string, level string, parent long", "LevelNotAscending"),
    ],
)
def test_defects(spark, name, rows, ddl, defect):
    with pytest.raises(KeelsonError, match=defect):
        assemble(spark, snapshot_tables(spark, **{name: spark.createDataFrame(rows, ddl)}))


def test_snapshot_hash_and_upgrade(spark):
    a = assemble(spark, snapshot_tables(spark))
    assert a.digest == digest(a.tables) == assemble(spark, snapshot_tables(spark, nodes=snapshot_tables(spark)["nodes"].orderBy("id", ascending=False))).digest
    link = spark.createDataFrame([(0, 1, "ReExport", "Soft", 1.0)], "source long, target long, kind string, hardness string, confidence double")
    old = assemble(spark, snapshot_tables(spark, edges=link), version=2)
    assert {r.id: r.re_export for r in old.nodes.collect()} == {0: True, 1: False}
    with pytest.raises(KeelsonError, match="version"):
        assemble(spark, snapshot_tables(spark), version=9)


def test_saved_results_and_commands(tmp_path, capsys, spark, cyclic):
    out = tmp_path / "r.json"
    assert cli.main(["analyze", str(cyclic), "--json", str(out)]) == 0
    r = results.read_result(out)
    assert cli.main(["report", str(out)]) == cli.main(["tree", str(out), "--depth", "2"]) == cli.main(["diff", str(out), "current", "current"]) == 0
    assert cli.main(["violations", str(cyclic), "--fail-on", "cycle"]) == 2 and cli.main(["violations", str(cyclic), "--fail-on", "cycle:borderline"]) == 0
    assert cli.main(["diff", str(out), "current", "anchored/9"]) == 1 and cli.main(["nothing"]) == 1
    out.write_text(json.dumps(r | {"schemaVersion": 10}))
    with pytest.raises(KeelsonError, match="10"):
        results.read_result(out)
    capsys.readouterr()


def test_moves_carry_evidence_and_pins_hold(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "y").mkdir()
    (tmp_path / "x" / "helper.py").write_text("def aid():\n    return 1\n\n\ndef more():\n    return 2\n")
    for k in range(3):
        (tmp_path / "x" / f"own{k}.py").write_text(f"def own{k}():\n    return {k}\n")
        (tmp_path / "y" / f"user{k}.py").write_text(f"from x.helper import aid, more\n\n\ndef user{k}():\n    return aid() + more()\n")
    cfg = config.from_document({"analysis": {"profiles": ["greenfield"]}, "tests": {"patterns": ["own2.py"]}})
    s = analysis.snapshot_from_path(spark, tmp_path, cfg)
    assert {r["name"]: r["polarity"] for r in s.nodes.collect()} == {"aid": "Production", "more": "Production", "own0": "Production", "own1": "Production", "own2": "TestSupport", **{f"user{k}": "Production" for k in range(3)}}
    r = analysis.analyze(s, cfg)
    best = r["profiles"][0]["candidates"][0]
    root = tmp_path.name
    assert best["moves"] == [{"file": "x/helper.py", "from": f"{root}/x", "to": f"{root}/y"}] and best["score"] < r["profiles"][0]["current"]["score"]
    assert {t["path"]: t["package"] for t in best["tree"]} == dict.fromkeys((t["path"] for t in best["tree"]), root)
    told = r["advice"][0]
    assert (told["subject"], told["destination"]) == ("x/helper.py", f"{root}/y") and told["recommended"] == (told["reasons"] == [])
    assert "x/helper.py" in render.summary(r)
    cfg = config.from_document({"analysis": {"profiles": ["greenfield"]}, "profiles": {"greenfield": {"relocation": {"forbid-files": ["x/helper.py"]}}}})
    held, mass = analysis.layout_of(s, cfg, "greenfield")
    assert held.files["x/helper.py"].pinned and all(c.folder["x/helper.py"] == f"{root}/x" for _, c in search.search(held, mass)["candidates"])


def test_settling_and_assembling():
    f = lambda p, folder, **k: search.File(p, 5, folder, folder, "r", **k)
    files = {p.path: p for p in (f("a/m.py", "r/a"), f("a/test_m.py", "r/a"), f("b/m.py", "r/b"), f("b/k.py", "r/b"), f("c/m.py", "r/c"))}
    home = {p: x.folder for p, x in files.items()}
    x = search.Layout(files, home, {("b/k.py", "c/m.py"): 2.0})
    taken = search.settle(x.moved(home | {"a/m.py": "r/b", "c/m.py": "r/b"}))
    assert taken.folder == home  # b/m.py stays, so both movers give way
    x.up["r/d"] = ("r/d", "r")
    led = search.settle(x.moved(home | {"a/m.py": "r/d"}), [("a/m.py", "a/test_m.py")])
    assert led.folder == home | {"a/m.py": "r/d", "a/test_m.py": "r/d"}
    pinned = files | {"a/test_m.py": f("a/test_m.py", "r/a", pinned=True)}
    assert search.settle(search.Layout(pinned, home | {"a/m.py": "r/d"}, {}, up=x.up), [("a/m.py", "a/test_m.py")]).folder == home
    up = search.assemble(x)
    assert set(up) == set(home.values()) and {p for _, p in up.values()} == {"r"}


def test_typescript_names_through_maps(spark):
    files = spark.createDataFrame([("app/a.ts", 'import { one } from "#lib/one";\nimport { two } from "@/two";\nimport { three } from "kit/three";\nexport function go() { one(); two(); three(); }\n'), ("app/lib/one.ts", "export function one() {}\n"), ("app/src/two.ts", "export function two() {}\n"), ("kit/three.ts", "export function three() {}\n")], "path string, contents string")
    found = [("app/package.json", '{"name": "app", "imports": {"#lib/*": "./lib/*"}}'), ("app/tsconfig.json", '// note\n{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}'), ("kit/package.json", '{"name": "kit"}'), ("x/package.json", "not json")]
    maps = spark.createDataFrame([r for m in found for r in brace_source.module_maps(*m)], "step int, scope string, key string, target string")
    got = brace_source.bind(brace_source.parse_files(files), maps)
    names = {r.id: r.name for r in got["nodes"].collect()}
    assert {(names[r.source], names[r.target]) for r in got["edges"].collect()} == {("go", "one"), ("go", "two"), ("go", "three")}
    assert brace_source.bind(brace_source.parse_files(files))["edges"].count() == 0


def test_modules_taken_whole_are_beyond_advice(spark):
    files = spark.createDataFrame([("a.py", "import b\nfrom pkg import sub\n\n\ndef go():\n    return b\n"), ("b.py", "def used():\n    pass\n"), ("pkg/sub.py", "def deep():\n    pass\n"), ("c.py", "def plain():\n    pass\n"), ("test_c.py", "import c\n\n\ndef test_c():\n    pass\n")], "path string, contents string")
    got = python_source.bind(python_source.parse_files(files))["nodes"].collect()
    assert {r.name: r.advice_exempt for r in got} == {"go": False, "used": True, "deep": True, "plain": False, "test_c": False}


def test_incremental_findings(spark, tmp_path):
    from keelson.operators import graph
    from keelson.streaming.incremental import watch

    src = str(tmp_path / "in")
    ddl = "src long, dst long"
    find = lambda e: graph.condense(e).groupBy("scc").count().filter("count > 1")
    spark.createDataFrame([(1, 2)], ddl).coalesce(1).write.mode("append").parquet(src)
    run = lambda: watch(spark.readStream.schema(ddl).parquet(src), str(tmp_path / "state"), find, str(tmp_path / "ck")).awaitTermination()
    run()
    spark.createDataFrame([(2, 1)], ddl).coalesce(1).write.mode("append").parquet(src)
    run()
    assert [(r.change, r.scc) for r in spark.read.parquet(f"{tmp_path}/state/changes/00000001").collect()] == [("new", 1)]
