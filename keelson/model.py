"""A snapshot: the canonical tables, validated, in canonical order, with a content hash."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson import schema
from keelson.errors import KeelsonError
from keelson.operators import graph, hierarchy
from keelson.session import cut

# Fixed value: columns that a saved snapshot leaves out, and so its hash.
_UNHASHED = {"containers": ("synthetic", "label_keyed")}


@dataclass(frozen=True)
class Snapshot:
    tables: dict[str, DataFrame] = field(repr=False)
    digest: str = ""
    version: int = 3

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.tables[name]
        except KeyError:
            raise AttributeError(name) from None


def conform(df: DataFrame | None, ddl: str, spark: SparkSession) -> DataFrame:
    """``df`` with exactly the table's columns; absent ones are null, absent flags false."""
    if df is None:
        return spark.createDataFrame([], ddl)
    out = []
    for part in ddl.split(", "):
        name, kind = part.split(" ")
        c = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        out.append((F.coalesce(c, F.lit(False)) if kind == "boolean" else c).alias(name))
    return df.select(*out)


def digest(tables: dict[str, DataFrame]) -> str:
    """Equal contents give equal hashes, whatever the row order: rows are hashed, and their hashes summed by parts."""
    parts = []
    for name in sorted(tables):
        df = tables[name].drop(*_UNHASHED.get(name, ()))
        row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        lanes = [F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)").cast("decimal(38,0)")).alias(f"l{k}") for k in range(8)]
        parts.append((name, tuple(df.select(row.alias("h")).agg(F.count("*"), *lanes).first())))
    import hashlib

    return hashlib.sha256(repr(parts).encode()).hexdigest()


def assemble(spark: SparkSession, tables: dict[str, DataFrame], version: int = 3) -> Snapshot:
    """Version gate and upgrade, referential integrity, tree validation, deduplication, hash."""
    if version not in range(schema.IR_SCHEMA_VERSIONS[0], schema.IR_SCHEMA_VERSIONS[1] + 1):
        raise KeelsonError("SNAPSHOT_INVALID", f"schema version {version} is not supported")
    t = {name: conform(tables.get(name), ddl, spark) for name, ddl in schema.TABLES.items()}
    if version == 2:  # earlier snapshots say by their edges which nodes re-export
        made = t["edges"].filter("kind = 'ReExport'").select(F.col("source").alias("id"), F.lit(True).alias("made")).distinct()
        t["nodes"] = t["nodes"].join(made, "id", "left").withColumn("re_export", F.col("re_export") | F.coalesce("made", F.lit(False))).drop("made")
    # Every check, the hash and all later queries read each table: it is written once.
    t |= {name: cut(t[name]) for name in t if tables.get(name) is not None}
    twice = t["nodes"].groupBy("id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise KeelsonError("SNAPSHOT_INVALID", "duplicate node id", id=twice[0]["id"])
    lost = hierarchy.dangling_edges(t["edges"], t["nodes"]).limit(1).collect()
    if lost:
        raise KeelsonError("SNAPSHOT_INVALID", "dangling edge", source=lost[0]["source"], target=lost[0]["target"])
    pairs = t["affinities"].select(F.col("owner").alias("source"), F.col("companion").alias("target"))
    if hierarchy.dangling_edges(pairs, t["nodes"]).limit(1).collect():
        raise KeelsonError("SNAPSHOT_INVALID", "dangling affinity")
    order = F.array_position(F.array(*[F.lit(x) for x in ("NonDenseIds", "DuplicateId", "MissingParent", "LevelNotAscending")]), F.col("defect"))
    defect = hierarchy.tree_violations(t["containers"]).orderBy(order, "id").limit(1).collect()
    if defect:
        raise KeelsonError("SNAPSHOT_INVALID", defect[0]["defect"], container=defect[0]["id"])
    for name in ("affinities", "file_facts", "test_support_roots"):
        t[name] = t[name].distinct()
    return Snapshot(t, digest(t), schema.IR_SCHEMA_VERSIONS[1])


def merge_fragments(spark: SparkSession, fragments: Sequence[dict[str, DataFrame]], root_name: str, package_roots: DataFrame) -> dict[str, DataFrame]:
    """One set of tables: node ids moved past those of earlier fragments, one new tree over all files.

    Fragment nodes carry ``path``; containers of fragments are dropped.
    """
    base, shifted = 0, []
    for f in fragments:
        moved = {"nodes": f["nodes"].withColumn("id", F.col("id") + base)}
        for name, columns in (("edges", ("source", "target")), ("affinities", ("owner", "companion")), ("exposures", ("exposer", "exposed")), ("advisory_uses", ("user", "used")), ("scope_ladders", ("node",))):
            if name in f:
                moved[name] = f[name].withColumns({c: F.col(c) + base for c in columns})
        for name in ("file_facts", "test_support_roots"):
            if name in f:
                moved[name] = f[name]
        top = f["nodes"].agg(F.max("id")).first()[0]
        base += 0 if top is None else top + 1
        shifted.append(moved)
    names = {n for m in shifted for n in m}
    out = {n: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [m[n] for m in shifted if n in m]) for n in names}
    placed = hierarchy.laminar_tree(out["nodes"].select("path"), package_roots, root_name)
    tree = cut(hierarchy.tree_containers(placed, root_name))
    files = tree.filter("level = 'File'").select(F.col("id").alias("container"), F.col("name").alias("path"))
    out["nodes"] = out["nodes"].drop("container").join(files, "path")
    out["containers"] = tree
    return out


def flatten(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every other edge to a re-export goes to what the re-export stands for."""
    links = tables["edges"].filter("kind = 'ReExport'").select("source", "target")
    other = tables["edges"].filter("kind <> 'ReExport'")
    ends = graph.flatten_re_exports(other.select(F.col("target").alias("node")), links)
    moved = other.join(ends.select(F.col("node").alias("target"), F.col("target").alias("final")), "target").withColumn("target", F.col("final")).drop("final").filter("source <> target")
    return tables | {"edges": moved.unionByName(tables["edges"].filter("kind = 'ReExport'"))}


def deduplicated_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target, kind): hard beats soft, then the higher confidence."""
    best = Window.partitionBy("source", "target", "kind").orderBy(F.when(F.col("hardness") == "Hard", 0).otherwise(1), F.desc("confidence"))
    return edges.withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k")


def fingerprint(s: Snapshot) -> Snapshot:
    return replace(s, digest=digest(s.tables))
