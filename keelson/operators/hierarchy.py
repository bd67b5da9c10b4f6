"""The five-level container tree: building, checking, ancestors, subtree sums, common ancestors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson import schema
from keelson.functions import path_segments, rank_of

SOURCE_ROOTS = ("src", "lib", "app", "source")  # fixed values: leading directories that hold sources


def level_rank(level: Column) -> Column:
    return rank_of(level, schema.LEVELS)


def laminar_tree(files: DataFrame, package_roots: DataFrame, root_name: str, source_roots: tuple[str, ...] = SOURCE_ROOTS) -> DataFrame:
    """files(path) to (path, package, domain, folder, synthetic): where each file hangs.

    A file belongs to the package root that is the longest strict segment prefix of its path, the
    lexicographically least of equals; without one, to ``root_name``. One leading source directory
    is stripped. The domain is the package and the first scope segment, the folder the whole scope;
    files directly in a root go to the synthetic ``workspace``.
    """
    f = files.select("path").distinct().withColumn("seg", path_segments(F.col("path")))
    # Every directory above a file, the root included, is a key of an equi-join: no range join.
    above = f.select("path", F.explode(F.sequence(F.lit(0), F.size("seg") - 1)).alias("n"), "seg")
    above = above.select("path", F.col("n"), F.array_join(F.slice("seg", F.lit(1), F.col("n")), "/").alias("root"))
    roots = package_roots.select(F.array_join(path_segments(F.col("root")), "/").alias("root")).distinct()
    home = above.join(roots, "root").groupBy("path").agg(F.max("n").alias("n"), F.max_by("root", "n").alias("root"))
    j = f.join(home, "path", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    j = j.withColumn("package", F.when(F.coalesce("root", F.lit("")) == "", F.lit(root_name)).otherwise(F.col("root")))
    inner = F.slice("seg", F.col("n") + 1, F.greatest(F.size("seg") - 1 - F.col("n"), F.lit(0)))
    j = j.withColumn("scope", inner)
    lead = (F.size("scope") > 0) & F.try_element_at("scope", F.lit(1)).isin(*source_roots)
    j = j.withColumn("scope", F.when(lead, F.slice("scope", F.lit(2), F.greatest(F.size("scope") - 1, F.lit(0)))).otherwise(F.col("scope")))
    flat = F.size("scope") == 0
    j = j.withColumn("domain", F.concat("package", F.lit("/"), F.when(flat, "workspace").otherwise(F.try_element_at("scope", F.lit(1)))))
    j = j.withColumn("folder", F.concat("package", F.lit("/"), F.when(flat, "workspace").otherwise(F.array_join("scope", "/"))))
    return j.select("path", "package", "domain", "folder", flat.alias("synthetic"))


def tree_containers(placed: DataFrame, group_name: str) -> DataFrame:
    """Containers with dense ids from laminar_tree's rows: a row per group, package, domain, folder, file."""
    pick = lambda level, name, up: placed.select(F.lit(level).alias("level"), F.col(name).alias("name"), up.alias("up"), (F.col("synthetic") if name in ("domain", "folder") else F.lit(False)).alias("synthetic")).distinct()
    rows = [
        placed.select(F.lit("PackageGroup").alias("level"), F.lit(group_name).alias("name"), F.lit(None).cast("string").alias("up"), F.lit(False).alias("synthetic")).distinct(),
        pick("Package", "package", F.lit(group_name)), pick("Domain", "domain", F.col("package")), pick("Folder", "folder", F.col("domain")), pick("File", "path", F.col("folder")),
    ]
    every = reduce(DataFrame.unionByName, rows).groupBy("level", "name", "up").agg(F.max("synthetic").alias("synthetic"))
    rank = level_rank(F.col("level"))
    # Dense ids in two steps: counts per (level, bucket) first, so no task numbers all rows.
    keyed = every.withColumn("bucket", F.substring("name", 1, 2))
    counts = keyed.groupBy("level", "bucket").agg(F.count("*").alias("k"))
    before = counts.withColumn("before", F.sum("k").over(Window.orderBy(F.desc(level_rank(F.col("level"))), "bucket")) - F.col("k")).drop("k")
    inside = F.row_number().over(Window.partitionBy("level", "bucket").orderBy("name", "up"))
    ids = keyed.withColumn("inside", inside).join(before, ["level", "bucket"]).withColumn("id", F.col("before") + F.col("inside") - 1)
    up = ids.select(F.col("id").alias("parent"), F.col("name").alias("up"), (level_rank(F.col("level")) - 1).alias("r"))
    return ids.withColumn("r", rank).join(up, ["up", "r"], "left").select("id", "name", "level", "parent", "synthetic", F.lit(False).alias("label_keyed"))


def ancestors(containers: DataFrame) -> DataFrame:
    """(id, file, folder, domain, package, packagegroup): the container itself and all above it, by level.

    The tree has five levels, so four joins reach every root.
    """
    c = containers.select("id", "level", "parent")
    now = c.select("id", F.array(F.struct("level", "id")).alias("chain"), "parent")
    for _ in range(len(schema.LEVELS) - 1):
        up = c.select(F.col("id").alias("p"), F.col("level").alias("l"), F.col("parent").alias("next"))
        now = now.join(up, F.col("parent") == F.col("p"), "left").select("id", F.when(F.col("p").isNotNull(), F.concat("chain", F.array(F.struct(F.col("l").alias("level"), F.col("p").alias("id"))))).otherwise(F.col("chain")).alias("chain"), F.col("next").alias("parent"))
    at = lambda level: F.try_element_at(F.filter("chain", lambda x: x["level"] == level), F.lit(1))["id"].alias(level.lower())
    return now.select("id", *[at(x) for x in schema.LEVELS])


def common_level(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Level of the deepest common ancestor, from ancestor columns; PackageGroup when trees are disjoint."""
    out = F.lit("PackageGroup")
    for level in reversed(schema.LEVELS[:-1]):
        out = F.when(a[level] == b[level], level).otherwise(out)
    return out


def common_ancestor(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Id of the deepest common ancestor; the left side's root when there is none."""
    root = F.coalesce(*[a[x] for x in reversed(schema.LEVELS)])
    return F.coalesce(*[F.when(a[x] == b[x], a[x]) for x in schema.LEVELS], root)


def scope_of_sets(members: DataFrame, key: str) -> DataFrame:
    """members(key, file.. packagegroup): per key the deepest level at which all members agree, and its container."""
    same = [F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")), F.struct(F.lit(x).alias("level"), F.min(c).alias("container"))) for x in schema.LEVELS for c in [x.lower()]]
    top = F.struct(F.lit("PackageGroup").alias("level"), F.min("packagegroup").alias("container"))
    return members.groupBy(key).agg(F.coalesce(*same, top).alias("s")).select(key, "s.level", "s.container")


def container_sizes(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """(container, level, size): production size summed over each subtree; empty containers have 0."""
    sized = nodes.groupBy(F.col("container").alias("id")).agg(F.sum(F.when(F.col("polarity") == "Production", F.col("effective_size")).otherwise(0)).alias("size"))
    files = tree.join(sized, "id", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    spread = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x.lower()).alias("container")) for x in schema.LEVELS])).alias("c")
    return files.select(spread, "size").filter("c.container is not null").groupBy(F.col("c.container").alias("container"), F.col("c.level").alias("level")).agg(F.sum("size").cast("long").alias("size"))


def tree_violations(containers: DataFrame) -> DataFrame:
    """(defect, id): NonDenseIds, DuplicateId, MissingParent, LevelNotAscending."""
    c = containers.select("id", "level", "parent")
    twice = c.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").select(F.lit("DuplicateId").alias("defect"), "id")
    whole = c.agg(F.countDistinct("id").alias("n"), F.max("id").alias("most"), F.min("id").alias("least"))
    gaps = whole.filter("least <> 0 or most <> n - 1").select(F.lit("NonDenseIds").alias("defect"), F.col("most").alias("id"))
    up = c.select(F.col("id").alias("p"), F.col("level").alias("above")).dropDuplicates(["p"])
    lost = c.filter("parent is not null").join(up, F.col("parent") == F.col("p"), "left_anti").select(F.lit("MissingParent").alias("defect"), "id")
    low = c.join(up, F.col("parent") == F.col("p")).filter(level_rank(F.col("above")) <= level_rank(F.col("level"))).select(F.lit("LevelNotAscending").alias("defect"), "id")
    return gaps.unionByName(twice).unionByName(lost).unionByName(low)


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an endpoint that is no node."""
    ids = nodes.select("id").distinct()
    lost = lambda side: edges.join(ids, F.col(side) == F.col("id"), "left_anti")
    return lost("source").unionByName(lost("target").join(ids, F.col("source") == F.col("id"), "left_semi"))
