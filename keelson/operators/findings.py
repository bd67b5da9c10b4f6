"""Findings: cycles, polarity, capacity, visibility, test-only items, and what is done with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson import schema
from keelson.functions import path_segments, rank_of, severity
from keelson.operators import graph, hierarchy
from keelson.session import cut


def census(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """One row: nodes, edges, files."""
    return nodes.agg(F.count("*").alias("n_nodes")).join(F.broadcast(edges.agg(F.count("*").alias("n_edges")))).join(F.broadcast(files.agg(F.countDistinct("file").alias("n_files"))))


def cycle_findings(membership: DataFrame, home: DataFrame) -> DataFrame:
    """(scc, members, location): components of two or more, unless all members share one known file.

    home(node, file); location is the sorted set of files.
    """
    rows = membership.join(home, "node", "left").groupBy("scc").agg(
        F.count("*").alias("members"), F.array_sort(F.collect_set("file")).alias("location"), F.count("file").alias("known")
    )
    return rows.filter("members > 1 and not (size(location) = 1 and known = members)").select("scc", "members", "location")


def solved_cycles(edges: DataFrame, membership: DataFrame, home: DataFrame, nodes: DataFrame, affinity_symbol: float = schema.SAME_FILE_SYMBOL, affinity_type: float = schema.SAME_FILE_TYPE, exact_vertices: int = schema.EXACT_VERTICES, seconds: float = schema.EXACT_SECONDS) -> DataFrame:
    """Cheapest breaks per component on priced hard edges; file-crossing breaks come first (``crossing``).

    edges(source, target, kind, hardness, confidence), nodes(id, kind).
    """
    kinds = nodes.select("id", "kind")
    priced = graph.price_edges(graph.hard_edges(edges)).drop("kind")
    priced = priced.join(kinds.select(F.col("id").alias("source"), F.col("kind").alias("ks")), "source").join(kinds.select(F.col("id").alias("target"), F.col("kind").alias("kt")), "target")
    a, b = home.select(F.col("node").alias("source"), F.col("file").alias("fs")), home.select(F.col("node").alias("target"), F.col("file").alias("ft"))
    priced = priced.join(a, "source", "left").join(b, "target", "left").withColumn("weight", F.col("weight") * same_file_affinity("fs", "ft", "ks", "kt", affinity_symbol, affinity_type))
    breaks = graph.shatter(priced.select(F.col("source").alias("src"), F.col("target").alias("dst"), "weight"), membership, exact_vertices, seconds)
    files = home.select("node", "file")
    both = breaks.join(files.select(F.col("node").alias("src"), F.col("file").alias("fs")), "src", "left").join(files.select(F.col("node").alias("dst"), F.col("file").alias("ft")), "dst", "left")
    return both.select("scc", "src", "dst", "weight", "exact", (~F.col("fs").eqNullSafe(F.col("ft"))).alias("crossing"))


def same_file_affinity(fs: str, ft: str, ks: str, kt: str, symbol: float = schema.SAME_FILE_SYMBOL, kind: float = schema.SAME_FILE_TYPE) -> Column:
    typed = (F.col(ks) == "Type") | (F.col(kt) == "Type")
    return F.when(F.col(fs) == F.col(ft), F.when(typed, kind).otherwise(symbol)).otherwise(1.0)


def conditional_splits(membership: DataFrame, nodes: DataFrame, cap: int = schema.CAPS["File"]) -> DataFrame:
    """(scc, production_size, files): components too large for one file, and the files they need."""
    big = membership.groupBy("scc").agg(F.count("*").alias("k")).filter("k > 1").select("scc")
    size = membership.join(big, "scc", "left_semi").join(nodes, F.col("node") == F.col("id")).groupBy("scc").agg(F.sum(F.when(F.col("polarity") == "Production", F.col("effective_size")).otherwise(0)).alias("production_size"))
    return size.filter(F.col("production_size") > cap).withColumn("files", F.ceil(F.col("production_size") / cap))


def polarity_findings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by which production depends on test code, or test support on test cases; one row each pair."""
    a = nodes.select(F.col("id").alias("source"), F.col("polarity").alias("from_polarity"))
    b = nodes.select(F.col("id").alias("target"), F.col("polarity").alias("to_polarity"))
    bad = ((F.col("from_polarity") == "Production") & F.col("to_polarity").isin("TestCase", "TestSupport")) | ((F.col("from_polarity") == "TestSupport") & (F.col("to_polarity") == "TestCase"))
    return edges.select("source", "target").join(a, "source").join(b, "target").filter(bad).select("source", "target", "from_polarity", "to_polarity").distinct()


def demoted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, polarity): a production node that is not exported and used by test nodes only becomes TestSupport; one step."""
    src = nodes.select(F.col("id").alias("source"), (F.col("polarity") != "Production").alias("test"))
    use = edges.filter("source <> target").join(src, "source").groupBy(F.col("target").alias("id")).agg(F.min("test").alias("only_test"))
    j = nodes.join(use, "id", "left")
    low = (F.col("polarity") == "Production") & ~F.coalesce("public_api", F.lit(False)) & F.coalesce("only_test", F.lit(False))
    return j.select("id", F.when(low, "TestSupport").otherwise(F.col("polarity")).alias("polarity"))


def relabelled(nodes: DataFrame, positive: Column, negated: Column, builtin: bool = True) -> DataFrame:
    """Test policy: negated files are production; positive ones turn production into test support."""
    kept = F.col("polarity") if builtin else F.lit("Production")
    up = F.when(F.col("polarity") == "Production", "TestSupport").otherwise(F.col("polarity"))
    return nodes.withColumn("polarity", F.when(negated, "Production").when(positive, up).otherwise(kept))


def builtin_test_path(path: Column) -> Column:
    """A segment spec, test or tests, or a dotted part spec or test in the base name."""
    s = path_segments(path)
    dirs = F.exists(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), lambda x: x.isin("spec", "test", "tests"))
    return dirs | F.exists(F.split(F.element_at(F.split(path, "/"), -1), r"\."), lambda x: x.isin("spec", "test"))


def case_only_files(nodes: DataFrame) -> DataFrame:
    """Files whose nodes are all test cases."""
    return nodes.groupBy("file").agg(F.bool_and(F.col("polarity") == "TestCase").alias("case_only")).filter("case_only").select("file")


def _capacity(measured: DataFrame, level: str, cap: int | None) -> DataFrame:
    cap = schema.CAPS[level] if cap is None else cap
    s = severity(F.col("measure"), F.lit(float(cap)))
    return measured.select(F.lit(level).alias("level"), F.col("container"), F.col("measure").cast("long").alias("measure"), F.lit(cap).cast("long").alias("cap"), s.alias("severity"))


def file_capacity(nodes: DataFrame, cap: int | None = None) -> DataFrame:
    """Production size per file against its cap; severity is null within it."""
    return _capacity(nodes.groupBy("container").agg(F.sum(F.when(F.col("polarity") == "Production", F.col("effective_size")).otherwise(0)).alias("measure")), "File", cap)


def folder_capacity(paths: DataFrame, cap: int | None = None) -> DataFrame:
    """Per physical directory: direct files plus distinct direct child directories that hold files. paths(path)."""
    s = paths.select(path_segments(F.col("path")).alias("s")).filter("size(s) > 0").distinct()
    step = s.select(F.explode(F.sequence(F.lit(1), F.size("s"))).alias("k"), "s")
    child = step.select(F.array_join(F.slice("s", F.lit(1), F.col("k") - 1), "/").alias("container"), F.element_at("s", F.col("k").cast("int")).alias("child"), (F.col("k") == F.size("s")).alias("leaf"))
    return _capacity(child.distinct().groupBy("container").agg(F.count("*").alias("measure")), "Folder", cap)


def child_capacity(tree: DataFrame, parent: str, child: str, level: str, cap: int | None = None) -> DataFrame:
    """Distinct ``child`` containers with a file beneath, per ``parent`` (columns of an ancestor table over files)."""
    return _capacity(tree.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("container")).agg(F.countDistinct(child).alias("measure")), level, cap)


def derived_scopes(nodes: DataFrame, edges: DataFrame, tree: DataFrame) -> DataFrame:
    """(id, level, container): the least scope that covers a node's own file and all its users.

    Types exposed by something wider than a file take the wider scope, until nothing changes; scopes only widen over
    five levels, so that ends. Each round looks at what the last one moved. ``tree`` has the
    ancestors of every container.
    """
    levels = [x.lower() for x in schema.LEVELS]
    at = nodes.select("id", "kind", "container")
    own = at.join(tree.withColumnRenamed("id", "container"), "container").select("id", *levels)
    users = edges.select(F.col("source").alias("id"), "target").join(own, "id").select(F.col("target").alias("id"), *levels)
    scope = cut(hierarchy.scope_of_sets(own.unionByName(users), "id"))
    tied = edges.filter(F.col("kind").isin("TypeReference", "Inheritance")).select("source", "target").distinct()
    tied = cut(tied.join(at.filter("kind = 'Type'").select(F.col("id").alias("target")), "target", "left_semi"))
    front = scope
    while True:
        wide = front.filter("level <> 'File'").join(tree.withColumnRenamed("id", "container"), "container").select(F.col("id").alias("source"), *levels)
        sent = cut(tied.join(wide, "source").select(F.col("target").alias("id"), *levels))
        if not sent.limit(1).count():
            return scope
        reached = scope.join(sent.select("id").distinct(), "id", "left_semi")
        spread = reached.join(tree.withColumnRenamed("id", "container"), "container").select("id", *levels)
        new = hierarchy.scope_of_sets(spread.unionByName(sent), "id").select("id", F.col("level").alias("l2"), F.col("container").alias("c2"))
        front = cut(reached.join(new, "id").filter("c2 <> container").select("id", F.col("l2").alias("level"), F.col("c2").alias("container")))
        if not front.limit(1).count():
            return scope
        scope = cut(scope.join(front.select("id"), "id", "left_anti").unionByName(front.select(*scope.columns)))


def finding_count(nodes: DataFrame, edges: DataFrame, tree: DataFrame, placement: DataFrame) -> DataFrame:
    """One row: how many items would be declared too wide if each lived where placement(id, container) puts it."""
    trial = nodes.drop("container").join(placement.select("id", "container"), "id")
    wide = hierarchy.level_rank(F.col("visibility")) > hierarchy.level_rank(F.col("level"))
    free = ~(F.coalesce("re_export", F.lit(False)) | F.coalesce("public_api", F.lit(False)) | F.coalesce("advice_exempt", F.lit(False)))
    return trial.filter(free).join(derived_scopes(trial, edges, tree).select("id", "level"), "id").filter(wide).agg(F.count("*").alias("findings"))


def capacity_remainder(measured: DataFrame) -> DataFrame:
    """One row: hard capacity findings that a layout leaves, and how many of them are of files.

    measured(level, severity), as the capacity operators give it, physical folders as level Folder.
    """
    hard = F.coalesce(F.col("severity") == "Violation", F.lit(False))
    return measured.agg(F.count_if(hard).alias("remaining"), F.count_if(hard & (F.col("level") == "File")).alias("file_level"))


def visibility_findings(nodes: DataFrame, scopes: DataFrame, ladders: DataFrame | None = None, test_only: DataFrame | None = None) -> DataFrame:
    """Nodes declared wider than needed. Ladder nodes are judged by their ladder; others only when File would do."""
    free = ~(F.coalesce("re_export", F.lit(False)) | F.coalesce("public_api", F.lit(False)) | F.coalesce("advice_exempt", F.lit(False)))
    j = nodes.filter(free).join(scopes.select("id", F.col("level").alias("derived")), "id")
    if test_only is not None:
        j = j.join(test_only.select("id"), "id", "left_anti")
    wider = hierarchy.level_rank(F.col("visibility")) > hierarchy.level_rank(F.col("derived"))
    plain = (F.col("derived") == "File") & wider
    if ladders is None:
        return j.filter(plain).select("id", "visibility", "derived")
    rung = ladders.select(F.col("node").alias("id"), "declared", "needed", F.lit(True).alias("laddered"))
    j = j.join(rung, "id", "left")
    judged = F.when(F.col("laddered"), F.coalesce(F.col("declared") != F.col("needed"), F.lit(False)) & wider).otherwise(plain)
    return j.filter(judged).select("id", "visibility", "derived")


def ladder_verdicts(rungs: DataFrame, footprint: DataFrame) -> DataFrame:
    """Narrowest rung whose files contain the footprint; the last of rungs with equal file sets; only if narrower than declared.

    rungs(node, rung, files, spelling, declared_rung), footprint(node, files).
    """
    fit = rungs.join(footprint.withColumnRenamed("files", "used"), "node").filter(F.size(F.array_except("used", "files")) == 0)
    sets = fit.withColumn("key", F.array_sort("files"))
    last = sets.groupBy("node", "key").agg(F.max("rung").alias("rung"), F.min("rung").alias("first"), F.max_by("spelling", "rung").alias("spelling"), F.max("declared_rung").alias("declared_rung"))
    best = last.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("first"))).filter("k = 1")
    return best.filter("rung < declared_rung").select("node", "rung", "spelling")


def test_only(nodes: DataFrame, edges: DataFrame, exposures: DataFrame | None = None, advisory: DataFrame | None = None, passes: int = 2) -> DataFrame:
    """Production items that only test code uses; members of an item settled in the first pass count as test in the second.

    nodes(id, kind, test_source, re_export, public_api, advice_exempt, owner, in_support).
    """
    n = nodes.select("id", "kind", "test_source", "owner", (F.coalesce("re_export", F.lit(False)) | F.coalesce("advice_exempt", F.lit(False)) | F.coalesce("in_support", F.lit(False))).alias("excused"))
    use = edges.filter("source <> target").select("source", "target").distinct().join(n.select(F.col("id").alias("source"), F.col("test_source").alias("t"), F.col("owner").alias("source_owner")), "source")
    blocked = advisory.filter("not from_test").select(F.col("used").alias("id")).distinct() if advisory is not None else None
    settled = None
    for _ in range(passes):
        u = use
        if settled is not None:
            # A use by a settled test-only member of the item itself counts as test code.
            known = settled.select(F.col("id").alias("source"), F.lit(True).alias("s"))
            u = use.join(known, "source", "left").withColumn("t", F.col("t") | (F.coalesce("s", F.lit(False)) & F.coalesce(F.col("source_owner") == F.col("target"), F.lit(False)))).drop("s")
        only = u.groupBy(F.col("target").alias("id")).agg(F.bool_and("t").alias("all_test")).filter("all_test").select("id")
        got = n.filter("not test_source and not excused and kind <> 'FileBody'").join(only, "id", "left_semi")
        if blocked is not None:
            got = got.join(blocked, "id", "left_anti")
        settled = cut(got.select("id"))
    return settled


def finding_rows(kind: str, sev: Column, location: Column, detail: Column) -> list[Column]:
    return [F.lit(kind).alias("kind"), sev.alias("severity"), location.alias("location"), detail.alias("detail")]


def ranked(findings: DataFrame) -> DataFrame:
    """Deduplicated, with their place in the order severity, kind, location, detail (place ties cannot arise)."""
    return findings.dropDuplicates().withColumns({"severity_rank": rank_of(F.col("severity"), schema.SEVERITIES), "kind_rank": rank_of(F.col("kind"), schema.FINDING_KINDS)}).orderBy("severity_rank", "kind_rank", "location", "detail")


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def unique_to(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(a.intersect(b)).distinct()


def hard_capacity_breaks(findings: DataFrame) -> DataFrame:
    return findings.filter("kind = 'Capacity' and severity = 'Violation'").agg(F.count("*").alias("breaks"))


def gate(findings: DataFrame, fail_on: tuple[str, ...]) -> DataFrame:
    """One row: does a hard finding match kind or kind:violation; borderline findings never do; and the exit code."""
    wanted = [x.split(":")[0].replace("-", "").lower() for x in fail_on if x.partition(":")[2].lower() in ("", "violation")]
    hit = F.coalesce(F.bool_or(F.lower("kind").isin(*wanted) & (F.col("severity") == "Violation")), F.lit(False)) if wanted else F.lit(False)
    return findings.agg(hit.alias("failed")).select("failed", F.when(F.col("failed"), 2).otherwise(0).cast("long").alias("exit_code"))
