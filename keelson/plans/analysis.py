"""From a folder or tables to a result: extraction, snapshot, findings, search, advice."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson import functions as K
from keelson import schema
from keelson.model import Snapshot, assemble, flatten, merge_fragments
from keelson.operators import advice, findings, graph, hierarchy, moves, partition, search, symbols
from keelson.session import cut, ship
from keelson.sources import brace_source, config, discovery, python_source


def snapshot_from_path(spark: SparkSession, root: str | Path, cfg: dict | None = None) -> Snapshot:
    ship(spark)
    cfg = cfg or config.defaults()
    a = cfg["adapters"]
    paths, roots = discovery.discover(root, a["include"], a["exclude"], a["languages"])
    files = discovery.source_files(spark, root, paths)
    fragments = []
    python = [p for p in paths if discovery.language_of(p) == "python"]
    other = [p for p in paths if discovery.language_of(p) != "python"]
    if python:
        fragments.append(python_source.bind(python_source.parse_files(files.filter(F.col("path").isin(python) if len(python) < 1000 else F.col("path").rlike(r"\.pyi?$")))))
    if other:
        got = brace_source.bind(brace_source.parse_files(files.filter(~F.col("path").rlike(r"\.pyi?$"))), _module_maps(spark, Path(root), roots))
        got["affinities"] = brace_source.companions(got["nodes"].filter("language = 'typescript'"))
        fragments.append(got)
    if not fragments:
        return assemble(spark, {})
    name = Path(root).resolve().name
    roots_df = spark.createDataFrame([(r,) for r in roots], "root string")
    tables = flatten(merge_fragments(spark, fragments, name, roots_df))
    n = tables["nodes"].withColumn("visibility", F.lit("File")).withColumn("test_source", F.col("polarity") != "Production").withColumn("owner", F.lit(None).cast("long"))
    n = _test_policy(n, cfg["tests"])
    demoted = findings.demoted(n, tables["edges"]).withColumnRenamed("polarity", "after")
    tables["nodes"] = cut(n.join(demoted, "id").withColumn("polarity", F.col("after")).drop("after"))
    return assemble(spark, tables)


def _matches(path: F.Column, patterns: list[str]) -> F.Column:
    """A pattern with a slash is held against the whole path, any other against the base name."""
    hits = [(path if "/" in p else K.basename(path)).rlike(K.glob_to_regex(p)) for p in patterns]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def _test_policy(nodes: DataFrame, tests: dict) -> DataFrame:
    """The configured patterns over what extraction took for test code; ``!`` patterns win."""
    yes, no = [p for p in tests["patterns"] if not p.startswith("!")], [p[1:] for p in tests["patterns"] if p.startswith("!")]
    if not tests["patterns"] and tests["builtins"]:
        return nodes
    path = F.col("path")
    return findings.relabelled(nodes, _matches(path, yes), _matches(path, no), tests["builtins"]).withColumn("test_source", F.col("polarity") != "Production")


def _module_maps(spark: SparkSession, root: Path, roots: list[str]) -> DataFrame:
    """What the manifests of the package roots say about module names; one or two small files a package."""
    there = [p for r in roots for name in ("package.json", "tsconfig.json") if (root / (p := f"{r}/{name}".lstrip("/"))).is_file()]
    rows = [m for p in there for m in brace_source.module_maps(p, (root / p).read_text(errors="replace"))]
    return spark.createDataFrame(rows, "step int, scope string, key string, target string")


def snapshot_from_tables(spark: SparkSession, tables: dict[str, DataFrame], version: int = 3) -> Snapshot:
    return assemble(ship(spark), tables, version)


def _homes(s: Snapshot) -> DataFrame:
    tree = cut(hierarchy.ancestors(s.containers))
    names = s.containers.select(F.col("id").alias("file"), F.col("name").alias("path"))
    return s.nodes.select("id", "kind", "polarity", "effective_size", "container").join(tree.withColumnRenamed("id", "container"), "container").join(names, "file")


def structural(s: Snapshot, cfg: dict, profile: str) -> DataFrame:
    """Findings as rows of schema.FINDINGS; the layout search plays no part in them."""
    p = cfg["profiles"][profile]
    homes = cut(_homes(s))
    hard = cut(graph.hard_edges(s.edges).select(F.col("source").alias("src"), F.col("target").alias("dst")))
    membership = cut(graph.condense(hard, s.nodes.select(F.col("id").alias("node"))))
    files = homes.select(F.col("id").alias("node"), F.col("path").alias("file"))
    cycles = findings.cycle_findings(membership, files)
    breaks = findings.solved_cycles(s.edges, membership, files, s.nodes, p["weights"]["same-file-symbol"], p["weights"]["same-file-type"], p["solver"]["ilp-threshold"], float(p["solver"]["timeout-seconds"]))
    named = s.nodes.select("id", "name")
    first = breaks.join(named.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(named.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
    first = first.groupBy("scc").agg(F.count("*").alias("cuts"), F.min_by(F.struct("a", "b", "weight"), F.struct(~F.col("crossing"), "src", "dst")).alias("cut"))
    said = F.concat(F.col("members").cast("string"), F.lit(" items depend on each other; cut "), F.col("cut.a"), F.lit(" -> "), F.col("cut.b"), F.when(F.col("cuts") > 1, F.concat(F.lit(" and "), (F.col("cuts") - 1).cast("string"), F.lit(" more"))).otherwise(F.lit("")))
    rows = [cycles.join(first, "scc", "left").select(*findings.finding_rows("Cycle", F.lit("Violation"), F.col("location"), F.coalesce(said, F.lit("cycle"))))]
    place = homes.select("id", "path")
    pol = findings.polarity_findings(s.edges, s.nodes).join(place.select(F.col("id").alias("source"), F.col("path").alias("pa")), "source").join(place.select(F.col("id").alias("target"), F.col("path").alias("pb")), "target")
    pol = pol.join(named.select(F.col("id").alias("source"), F.col("name").alias("a")), "source").join(named.select(F.col("id").alias("target"), F.col("name").alias("b")), "target")
    rows.append(pol.select(*findings.finding_rows("Polarity", F.lit("Violation"), F.array("pa", "pb"), F.concat("from_polarity", F.lit(" "), "a", F.lit(" depends on "), "to_polarity", F.lit(" "), "b"))))
    sized = homes.groupBy("path").agg(F.sum(F.when(F.col("polarity") == "Production", F.col("effective_size")).otherwise(0)).alias("measure"))
    caps = {"File": p["capacity"]["file"], "Folder": p["capacity"]["folder"], "Domain": p["capacity"]["domain"], "Package": p["capacity"]["package"], "PackageGroup": p["capacity"]["package-group"]}
    measured = findings._capacity(sized.select(F.col("path").alias("container"), "measure"), "File", caps["File"])
    measured = measured.unionByName(findings.folder_capacity(sized.select("path"), caps["Folder"]))
    real = s.containers.filter("not synthetic").select("id", "name")
    tree = homes.select("file", "folder", "domain", "package", "packagegroup").distinct()
    for parent, child, level in (("domain", "folder", "Domain"), ("package", "domain", "Package"), ("packagegroup", "package", "PackageGroup")):
        got = findings.child_capacity(tree, parent, child, level, caps[level]).join(real, F.col("container") == F.col("id"))
        measured = measured.unionByName(got.select("level", F.col("name").alias("container"), "measure", "cap", "severity"))
    over = measured.filter("severity is not null")
    rows.append(over.select(*findings.finding_rows("Capacity", F.col("severity"), F.array("container"), F.concat("level", F.lit(" has "), F.col("measure").cast("string"), F.lit(" of "), F.col("cap").cast("string")))))
    only = cut(findings.test_only(_in_support(s, place), s.edges, advisory=s.advisory_uses))
    rows.append(only.join(place, "id").join(named, "id").select(*findings.finding_rows("TestOnly", F.lit("Violation"), F.array("path"), F.concat("name", F.lit(" is used by tests only")))))
    scopes = findings.derived_scopes(s.nodes, s.edges, hierarchy.ancestors(s.containers))
    wide = findings.visibility_findings(s.nodes, scopes, s.scope_ladders, only)
    rows.append(wide.join(place, "id").join(named, "id").select(*findings.finding_rows("Visibility", F.lit("Violation"), F.array("path"), F.concat("name", F.lit(" is declared "), "visibility", F.lit(", needed "), "derived"))))
    return findings.ranked(reduce(DataFrame.unionByName, rows)).select("kind", "severity", "location", "detail")


def _in_support(s: Snapshot, place: DataFrame) -> DataFrame:
    """Nodes with in_support: does the file lie below a test-support root?"""
    above = place.select("id", F.split("path", "/").alias("p")).select("id", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"), "p")
    hit = above.select("id", F.array_join(F.slice("p", F.lit(1), F.col("k")), "/").alias("root")).join(s.test_support_roots.select("root"), "root", "left_semi")
    return s.nodes.join(hit.select("id").distinct().withColumn("in_support", F.lit(True)), "id", "left").withColumn("in_support", F.coalesce("in_support", F.lit(False)))


def _test_pairs(paths: DataFrame) -> DataFrame:
    """(source, test) of Python files by their names; a test that two sources claim is nobody's."""
    return moves.test_pairs(python_source.test_pair_candidates(paths), paths)


def layout_of(s: Snapshot, cfg: dict, profile: str) -> tuple[search.Layout, float]:
    """The file-level layout for the search, and the priced mass inside files."""
    p = cfg["profiles"][profile]
    homes = cut(_homes(s))
    names = s.containers.select("id", "name", "synthetic")
    files = homes.groupBy("path", "folder", "domain", "package").agg(F.sum(F.when(F.col("polarity") == "Production", F.col("effective_size")).otherwise(0)).alias("size"), F.bool_and(F.col("polarity") != "Production").alias("test"))
    for c in ("folder", "domain", "package"):
        files = files.join(names.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"), F.col("synthetic").alias(f"{c}_s")), c)
    files = files.withColumn("tokens", K.name_tokens(F.col("path")))
    started = python_source.entry_facts(files.select("path")).select(F.col("file").alias("path"), F.lit(True).alias("started")).distinct()
    files = files.join(started, "path", "left").withColumn("pinned", F.coalesce("started", F.lit(False)) | _matches(F.col("path"), p["relocation"]["forbid-files"]))
    rows = files.collect()  # one row per file of a repository
    at = {r["path"]: search.File(r["path"], int(r["size"]), r["folder_name"], r["domain_name"], r["package_name"], bool(r["folder_s"]), frozenset(r["tokens"]), bool(r["pinned"]), bool(r["test"])) for r in rows}
    priced = graph.price_edges(s.edges, config.weights_of(p))
    home = homes.select("id", F.col("path").alias("file"))
    zone = files.filter("test").select(F.col("path").alias("file"))
    weights = lambda z: {(r["src"], r["dst"]): r["weight"] for r in graph.file_graph(priced, home, z).collect()}
    edges, scored = weights(zone), weights(zone.limit(0))
    kinds = homes.select("id", "kind", "path")
    inner = priced.join(kinds.select(F.col("id").alias("source"), F.col("path").alias("pa"), F.col("kind").alias("ka")), "source").join(kinds.select(F.col("id").alias("target"), F.col("path").alias("pb"), F.col("kind").alias("kb")), "target").filter("pa = pb")
    mass = inner.agg(F.sum(F.col("weight") * findings.same_file_affinity("pa", "pb", "ka", "kb", p["weights"]["same-file-symbol"], p["weights"]["same-file-type"]))).first()[0] or 0.0
    caps = dict(zip(schema.LEVELS, (p["capacity"][k] for k in ("file", "folder", "domain", "package", "package-group"))))
    return search.Layout(at, {k: f.folder for k, f in at.items()}, edges, config.objective_of(p), caps, priced=scored), mass


def symbol_moves(s: Snapshot, cfg: dict, profile: str, x: search.Layout) -> list[dict]:
    """Single symbols that would lower the objective of layout ``x`` in another file: (symbol, from, to).

    On one repository, like the search: a sweep looks at every symbol and its files.
    """
    p = cfg["profiles"][profile]
    homes = _homes(s).join(s.nodes.select("id", "name"), "id").select("id", "name", "kind", "path", "effective_size", (F.col("polarity") != "Production").alias("test"))
    stay = _matches(F.concat("path", F.lit("::"), "name"), p["relocation"]["forbid-symbols"]) | _matches(F.col("name"), [g for g in p["relocation"]["forbid-symbols"] if "/" not in g])
    rows = homes.withColumn("stay", stay).collect()  # one row per symbol of a repository
    some = {r["id"]: symbols.Symbol(r["id"], r["name"], r["kind"], r["path"], x.files[r["path"]].package, int(r["effective_size"]), r["path"].count("/"), r["test"], r["stay"] or x.files[r["path"]].pinned) for r in rows if r["path"] in x.files}
    edges = [(r["source"], r["target"], r["weight"]) for r in graph.price_edges(s.edges, config.weights_of(p)).select("source", "target", "weight").collect() if r["source"] in some and r["target"] in some]

    def objective(now) -> float:
        between: dict[tuple[str, str], float] = {}
        inner, size = 0.0, dict.fromkeys(x.files, 0)
        for i, f in now.items():
            size[f] += 0 if some[i].test else some[i].size
        for a, b, w in edges:
            if now[a] == now[b]:
                inner += w * (p["weights"]["same-file-type"] if "Type" in (some[a].kind, some[b].kind) and some[a].file == some[b].file else p["weights"]["same-file-symbol"] if some[a].file == some[b].file else 1.0)
            else:
                between[now[a], now[b]] = between.get((now[a], now[b]), 0.0) + w
        files = {k: replace(f, size=size[k]) for k, f in x.files.items()}
        return search.score(replace(x, files=files, edges=between, priced=None), inner)

    now = symbols.polish(some, edges, {k: f.package for k, f in x.files.items()}, objective)
    return [{"symbol": some[i].name, "kind": some[i].kind, "from": some[i].file, "to": f} for i, f in sorted(now.items()) if f != some[i].file]


def evidence(s: Snapshot, cfg: dict, profile: str, x: search.Layout, best: search.Layout) -> DataFrame:
    """(subject, destination, profile, six signals, weighted, structural, margin, qualified) of each file that ``best`` moves."""
    spark, q = s.nodes.sparkSession, cfg["profiles"][profile]["qualification"]
    went = [(p, f.folder, best.folder[p]) for p, f in sorted(x.files.items()) if best.folder[p] != f.folder]
    moved = spark.createDataFrame(went, "subject string, source string, destination string")
    files = spark.createDataFrame([(p, p, f.folder, sorted(f.tokens)) for p, f in x.files.items()], "vertex string, subject string, place string, tokens array<string>")
    edges = spark.createDataFrame([(a, b, float(w)) for (a, b), w in x.edges.items()], "src string, dst string, weight double")
    owned = cut(_homes(s)).select("id", "path")
    owners = s.affinities.join(owned.toDF("owner", "owner_path"), "owner").join(owned.toDF("companion", "companion_path"), "companion").select(F.col("owner_path").alias("owner"), F.col("companion_path").alias("companion"))
    place = files.select("vertex", "place")
    near = edges.filter("weight > 0").select("src", "dst").union(edges.filter("weight > 0").select("dst", "src")).toDF("subject", "vertex").join(place, "vertex").select("subject", "place")
    use = edges.filter("weight > 0").select(F.col("dst").alias("subject"), F.col("src").alias("file")).join(place.select(F.col("vertex").alias("file"), K.path_segments(F.col("place")).alias("folder")), "file")
    span = use.groupBy("subject").agg(F.countDistinct("folder").alias("n"), F.min("folder").alias("lo"), F.max("folder").alias("hi")).filter("n >= 2")
    common = span.select("subject", F.array_join(F.slice("lo", F.lit(1), K.common_prefix_length(F.col("lo"), F.col("hi"))), "/").alias("place"))
    by_owner = owners.select(F.col("companion").alias("subject"), F.col("owner").alias("vertex")).join(place, "vertex").select("subject", "place")
    other = advice.alternatives(moved.select("subject", F.col("source").alias("place")), near, common, by_owner).join(moved.select("subject", "source", F.col("destination").alias("taken")), "subject").filter("place <> taken")
    every = moved.unionByName(other.select("subject", "source", F.col("place").alias("destination"))).distinct()
    every = cut(every.withColumns({"destination_segments": K.path_segments(F.col("destination")), "place_tokens": K.name_tokens(F.col("destination"))}))
    keys = ["subject", "source", "destination"]
    signals = advice.cohesion_signals(every, edges, files).join(advice.owner_signals(every, owners, files), keys).join(advice.role_affinity(every, files), keys).join(advice.architectural_reach(every, use), keys)
    scored = cut(advice.weigh(signals))
    rivals = scored.join(moved, keys, "left_anti").select("subject", F.col("destination").alias("place"), F.col("weighted").alias("score"))
    got = advice.qualified(advice.margins(scored.join(moved, keys, "left_semi"), rivals), q["weighted"], q["structural"], q["margin"])
    return got.withColumn("profile", F.lit(profile))


def _candidate(x: search.Layout, s: float) -> dict:
    moves = [{"file": p, "from": f.folder, "to": x.folder[p]} for p, f in sorted(x.files.items()) if x.folder[p] != f.folder]
    return {"score": s, "moves": moves, "tree": _tree(x, search.assemble(x))}


def tree_of(x: search.Layout) -> list[dict]:
    return _tree(x, x.up)


def _tree(x: search.Layout, up: dict[str, tuple[str, str]]) -> list[dict]:
    return [{"path": p, "folder": x.folder[p], "domain": up[x.folder[p]][0], "package": up[x.folder[p]][1], "size": f.size} for p, f in sorted(x.files.items())]


def analyze(s: Snapshot, cfg: dict | None = None) -> dict:
    """The nested result document."""
    cfg = cfg or config.defaults()
    names = cfg["analysis"]["profiles"]
    per, profiles, votes = {}, [], []
    pairs = [(r["source"], r["test"]) for r in _test_pairs(s.containers.filter("level = 'File'").select(F.col("name").alias("path"))).collect()]
    for name in names:
        per[name] = cut(structural(s, cfg, name))
        x, mass = layout_of(s, cfg, name)
        got = search.search(x, mass, cfg["profiles"][name]["candidates"], cfg["profiles"][name]["relocation"]["allow-cross-package-moves"], pairs)
        paths = sorted(x.files)
        cells = [[_number(c.folder[p], c) for p in paths] for _, c in got["candidates"]]
        profiles.append({
            "name": name, "current": {"score": got["current"], "standing": got["standing"], "tree": tree_of(x)},
            "candidates": [_candidate(c, v) for v, c in got["candidates"]],
            "distances": [[partition.vi(a, b) for b in cells] for a in cells],
        })
        for c, (_, layout) in zip(profiles[-1]["candidates"], got["candidates"]):
            c["symbolMoves"] = symbol_moves(s, cfg, name, layout)
        if profiles[-1]["candidates"][:1] and profiles[-1]["candidates"][0]["moves"]:
            votes.append(evidence(s, cfg, name, x, got["candidates"][0][1]))
    common = findings.shared(per[names[0]], per[names[1]]) if len(names) == 2 else per[names[0]].limit(0)
    order = lambda df: [r.asDict() for r in findings.ranked(df).select("kind", "severity", "location", "detail").collect()]
    said = advice.consensus(reduce(DataFrame.unionByName, votes), len(names)).orderBy("subject").collect() if votes else []
    told = [{"subject": r["subject"], "destination": r["destination"], "votes": r["votes"], "recommended": r["recommended"], "reasons": list(r["reasons"])} for r in said]
    census = findings.census(s.nodes, s.edges, s.containers.filter("level = 'File'").select(F.col("name").alias("file"))).first()
    languages = s.containers.filter("level = 'File'").select(K.matches_language(F.col("name")).alias("l")).groupBy("l").count().collect()
    for p in profiles:
        p["findings"] = order(findings.unique_to(per[p["name"]], common) if len(names) == 2 else per[p["name"]])
    return {
        "schemaVersion": schema.RESULT_SCHEMA_VERSION, "snapshot": s.digest,
        "summary": {"nodes": census["n_nodes"], "edges": census["n_edges"], "files": census["n_files"], "languages": {r["l"]: r["count"] for r in languages if r["l"]}},
        "sharedFindings": order(common), "profiles": profiles, "advice": told,
    }


def _number(folder: str, x: search.Layout) -> int:
    return sorted(set(x.folder.values())).index(folder)
