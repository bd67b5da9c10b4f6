"""Moves between two layouts: grouping, kinds, reasons, collisions, test mirrors, pins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions import basename, mirror_regex


def moved(placed: DataFrame) -> DataFrame:
    """Files whose parent changed: placed(file, size, origin, destination)."""
    return placed.filter(~F.col("origin").eqNullSafe(F.col("destination")))


def move_groups(placed: DataFrame) -> DataFrame:
    """(destination, files, origins, size, kind): Merge with two or more origins, Split when an origin feeds two
    or more destinations, else Move; with the origin that gives most size (ties to the smaller name)."""
    m = moved(placed)
    feeds = m.groupBy("origin").agg(F.countDistinct("destination").alias("feeds"))
    by = m.groupBy("destination", "origin").agg(F.count("*").alias("n"), F.sum("size").alias("s")).join(feeds, "origin")
    main = F.min_by("origin", F.struct(-F.col("s"), F.col("origin")))
    g = by.groupBy("destination").agg(F.sum("n").alias("files"), F.countDistinct("origin").alias("origins"), F.sum("s").alias("size"), F.max("feeds").alias("feeds"), main.alias("main_origin"))
    kind = F.when(F.col("origins") >= 2, "Merge").when(F.col("feeds") >= 2, "Split").otherwise("Move")
    return g.select("destination", F.col("files").cast("long").alias("files"), "origins", F.col("size").cast("long").alias("size"), kind.alias("kind"), "main_origin")


def move_reasons(groups: DataFrame, over_cap: DataFrame, pulls: DataFrame, naming: DataFrame) -> DataFrame:
    """The first that holds: relieves an over-cap origin, pulled by a neighbour, shares name tokens, else clustering.

    over_cap(origin), pulls(destination, puller), naming(destination).
    """
    j = groups.join(over_cap.select(F.col("origin").alias("main_origin"), F.lit(True).alias("over")).distinct(), "main_origin", "left")
    j = j.join(pulls.groupBy("destination").agg(F.min("puller").alias("puller")), "destination", "left").join(naming.select("destination", F.lit(True).alias("named")).distinct(), "destination", "left")
    reason = F.when(F.col("over"), "RelievesOverCap").when(F.col("puller").isNotNull(), "PulledBy").when(F.col("named"), "NamingCohesion").otherwise("Clustering")
    return j.select("destination", "kind", reason.alias("reason"), "puller")


def broken_imports(relocations: DataFrame, edges: DataFrame, homes: DataFrame) -> DataFrame:
    """Per moved symbol: distinct other files of its direct users and uses that do not live with it after the move.

    relocations(id, file), edges(source, target), homes(id, file) after the move.
    """
    near = edges.select(F.col("source").alias("id"), F.col("target").alias("other")).union(edges.select(F.col("target").alias("id"), F.col("source").alias("other")))
    j = relocations.select("id", F.col("file").alias("new")).join(near, "id", "left").join(homes.select(F.col("id").alias("other"), "file"), "other", "left")
    return j.groupBy("id").agg(F.countDistinct(F.when(F.col("file") != F.col("new"), F.col("file"))).alias("broken"))


def collisions(proposed: DataFrame) -> DataFrame:
    """Claimants of one path: the stayer keeps it, else the smallest current path; others withdraw.

    proposed(file, path): ``keeps`` tells who has the path.
    """
    order = Window.partitionBy("path").orderBy(F.when(F.col("file") == F.col("path"), 0).otherwise(1), "file")
    twice = Window.partitionBy("path")
    return proposed.withColumns({"n": F.count("*").over(twice), "k": F.row_number().over(order)}).filter("n > 1").select("path", "file", (F.col("k") == 1).alias("keeps"))


def test_pairs(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(source, test) where the candidate test path exists and just one source claims it."""
    there = candidates.select("source", "test").distinct().join(files.select(F.col("path").alias("test")).distinct(), "test", "left_semi")
    one = there.groupBy("test").agg(F.count("*").alias("n"), F.min("source").alias("source")).filter("n = 1")
    return one.select("source", "test")


def mirror_candidates(files: DataFrame, source_template: str, test_template: str) -> DataFrame:
    """(source, test) from {dir}/{stem} templates."""
    rx = mirror_regex(source_template).replace("(?<dir>", "(").replace("(?<stem>", "(")
    first = "dir" if source_template.find("{dir}") < source_template.find("{stem}") and "{dir}" in source_template else "stem"
    two = "{dir}" in source_template
    d = F.regexp_extract("path", rx, 1 if first == "dir" else 2) if two else F.lit("")
    s = F.regexp_extract("path", rx, (2 if first == "dir" else 1) if two else 1)
    parts = []
    for piece in test_template.replace("{dir}", "\0d\0").replace("{stem}", "\0s\0").split("\0"):
        parts.append(d if piece == "d" else s if piece == "s" else F.lit(piece))
    return files.filter(F.col("path").rlike(rx)).select(F.col("path").alias("source"), F.concat(*parts).alias("test"))


def follow_tests(moves: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tests of moved sources move along; a move whose test is pinned is dropped. moves(file, destination), pairs(source, test, pinned)."""
    led = moves.join(pairs.withColumnRenamed("source", "file"), "file", "left")
    kept = led.filter(~F.coalesce("pinned", F.lit(False)))
    return kept.select("file", "destination").union(kept.filter("test is not null").select(F.col("test").alias("file"), "destination")).distinct()


def pinned_components(members: DataFrame) -> DataFrame:
    """(scc, pinned): a component is pinned if any of its files is. members(scc, file, pinned)."""
    return members.groupBy("scc").agg(F.bool_or("pinned").alias("pinned"))


def cycle_homes(members: DataFrame) -> DataFrame:
    """Components whose files start in more than one folder. members(scc, file, folder)."""
    return members.groupBy("scc").agg(F.countDistinct("folder").alias("homes"), F.count("*").alias("files")).filter("homes > 1")


def capacity_veto(before: DataFrame, after: DataFrame) -> DataFrame:
    """Folders whose overage grows. before and after: (container, measure, cap)."""
    over = lambda df, n: df.select("container", F.greatest(F.lit(0).cast("long"), F.col("measure") - F.col("cap")).alias(n))
    j = over(before, "b").join(over(after, "a"), "container", "full")
    return j.filter(F.coalesce("a", F.lit(0)) > F.coalesce("b", F.lit(0))).select("container")


def identity_veto(clusters: DataFrame) -> DataFrame:
    """(cluster, namespace, name) that two files of one cluster would share. clusters(cluster, namespace, path)."""
    return clusters.groupBy("cluster", "namespace", basename(F.col("path")).alias("name")).agg(F.count("*").alias("n")).filter("n > 1").select("cluster", "namespace", "name")


def folder_labels(folders: DataFrame) -> DataFrame:
    """Unique display keys: bare, with its package when shared across packages, with package and domain when shared within.

    folders(key, package, domain).
    """
    f = folders.select("key", "package", "domain").distinct()
    per = f.groupBy("key").agg(F.countDistinct("package").alias("packages"))
    inside = f.groupBy("key", "package").agg(F.count("*").alias("domains"))
    j = f.join(per, "key").join(inside, ["key", "package"])
    label = F.when(F.col("domains") > 1, F.concat("key", F.lit(" ("), "package", F.lit(" "), F.replace("domain", F.lit("/"), F.lit(".")), F.lit(")"))).when(F.col("packages") > 1, F.concat("key", F.lit(" ("), "package", F.lit(")"))).otherwise(F.col("key"))
    return j.select("key", "package", "domain", label.alias("label"))


def strip_group(paths: DataFrame, group: str) -> DataFrame:
    return paths.withColumn("path", F.regexp_replace("path", f"^\\Q{group}\\E/", ""))


def worst(rows: DataFrame, rank: str, limit: int = 5) -> DataFrame:
    """The first ``limit`` rows by rank and the number hidden: a display limit."""
    n = rows.agg(F.count("*").alias("n"))
    return rows.orderBy(rank).limit(limit).join(F.broadcast(n.select(F.greatest(F.lit(0).cast("long"), F.col("n") - limit).alias("hidden"))))


def kept_namespaces(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, package, namespace) after a move: a file keeps its namespace where the package has it, else takes the
    package's only one, else none. before(file, package, namespace), after(file, package)."""
    known = before.filter("namespace is not null").select("package", "namespace").distinct()
    only = known.groupBy("package").agg(F.count("*").alias("n"), F.min("namespace").alias("only"))
    own = after.select("file", "package").join(before.filter("namespace is not null").select("file", "namespace"), "file")
    there = own.join(known.withColumn("has", F.lit(True)), ["package", "namespace"], "left").join(only, "package", "left")
    kept = F.when(F.coalesce("has", F.lit(False)), F.col("namespace")).when(F.col("n") == 1, F.col("only")).otherwise("")
    return there.select("file", "package", kept.alias("namespace"))


def qualify_names(elected: DataFrame) -> DataFrame:
    """(cluster, label): names that siblings share get their anchor. elected(cluster, parent, name, anchor)."""
    shared = F.count("*").over(Window.partitionBy("parent", "name")) > 1
    anchor = F.replace(F.coalesce("anchor", F.lit("workspace")), F.lit("/"), F.lit("."))
    return elected.withColumn("shared", shared).select("cluster", F.when(F.col("shared"), F.concat("name", F.lit(" ("), anchor, F.lit(")"))).otherwise(F.col("name")).alias("label"))


def folder_impacts(moves: DataFrame) -> DataFrame:
    """(folder, leaving, entering): files that leave and enter each folder. moves(path, destination): the new folder."""
    old = F.regexp_replace("path", r"/?[^/]*$", "")
    both = moves.select(F.explode(F.array(F.struct(old.alias("folder"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("destination").alias("folder"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"), (old != F.col("destination")).alias("real")).filter("real")
    return both.groupBy("x.folder").agg(F.sum("x.o").alias("leaving"), F.sum("x.i").alias("entering"))


def change_tree(moves: DataFrame) -> DataFrame:
    """(side, path, depth, branch): the branches of the trees before and after that a move touches, files and directories."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    new = F.concat_ws("/", F.when(F.col("destination") != "", F.col("destination")), name)
    sides = moves.filter(new != F.col("path")).select(F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("path").alias("path")), F.struct(F.lit("after").alias("side"), new.alias("path")))).alias("x")).select("x.side", "x.path")
    s = F.split("path", "/")
    step = sides.select("side", "path", F.explode(F.sequence(F.lit(1), F.size(s))).alias("depth"))
    branch = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("depth")), "/")
    return step.select("side", F.col("depth").cast("long").alias("depth"), branch.alias("branch"), (F.col("depth") == F.size(F.split("path", "/"))).alias("is_file")).distinct()
