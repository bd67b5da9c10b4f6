"""Deterministic projections of ordinary tables onto the model: nodes, edges, containers, placements.

``handover``: customers; an edge to the next customer who ordered the same part in the same quantity at the
same discount. ``org``: orders as nodes in a tree customer < (nation, segment) < nation < region < world, with an edge to
the next order of the same part. ``event_graph``: event types; an edge to the user's next, different type.
``page_files``: pages as files host/lang/leaf.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How order attributes stand for attributes of the model.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
KIND_OF_PRIORITY = {"1-URGENT": "ValueImport", "2-HIGH": "TypeReference", "3-MEDIUM": "Inheritance", "4-NOT SPECIFIED": "Call", "5-LOW": "ReExport"}
POLARITY_OF_STATUS = {"F": "Production", "O": "TestSupport", "P": "TestCase"}
GROUP_ID = 4


def _map(c: Column, table: dict) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def segment_rank(c: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), c) - 1).cast("long")


def folder_id(nation: Column, segment: Column) -> Column:
    return (nation.cast("long") * 16 + segment) * 8 + 1


class Tables:
    """The tables of one directory, with the projections on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def handover(self) -> DataFrame:
        """(src, dst, weight)."""
        bought = self["lineitem"].select("l_orderkey", "l_partkey", "l_quantity", "l_discount").join(self["orders"].select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        # Equal rows lie side by side in the order that the window needs anyway, so they go without a shuffle or a table of their own.
        line = Window.partitionBy("l_partkey", "l_quantity", "l_discount").orderBy("o_orderdate", "o_orderkey", "o_custkey")
        row = F.struct("o_orderdate", "o_orderkey", "o_custkey")
        once = bought.drop("l_orderkey").withColumn("again", F.lag(row).over(line).eqNullSafe(row)).filter("not again")
        pairs = once.select(F.col("o_custkey").alias("src"), F.lead("o_custkey").over(line).alias("dst")).filter("dst is not null and src <> dst")
        return pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))

    @cached_property
    def handover_nodes(self) -> DataFrame:
        return self.handover.select(F.col("src").alias("node")).union(self.handover.select(F.col("dst").alias("node"))).distinct()

    @cached_property
    def event_graph(self) -> DataFrame:
        """(src, dst, weight) between ranks of event types in alphabetical order, with names."""
        line = Window.partitionBy("user_id").orderBy("ts", "event_id")
        e = self["events"].select(F.col("event_type").alias("s"), F.lead("event_type").over(line).alias("t")).filter("t is not null and s <> t")
        return e.groupBy("s", "t").agg(F.count("*").cast("double").alias("weight"))

    @cached_property
    def org_nodes(self) -> DataFrame:
        size = self["lineitem"].groupBy("l_orderkey").agg(F.count("*").alias("effective_size"))
        o = self["orders"].join(size, F.col("o_orderkey") == F.col("l_orderkey"))
        first = Window.partitionBy("o_custkey")
        o = o.withColumn("first", F.min("o_orderkey").over(first))
        k, v = F.col("o_orderkey") % 5, F.floor(F.col("o_orderkey") / 5) % 5
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.when(k <= 2, "Symbol").when(k == 3, "Type").otherwise("FileBody").alias("kind"),
            _map(F.col("o_orderstatus"), POLARITY_OF_STATUS).alias("polarity"),
            (F.col("o_custkey") * 8).alias("container"),
            F.element_at(F.array(*[F.lit(x) for x in ("File", "Folder", "Domain", "Package", "PackageGroup")]), (v + 1).cast("int")).alias("visibility"),
            "effective_size",
            (F.col("o_orderstatus") != "F").alias("test_source"),
            F.when(F.col("first") != F.col("o_orderkey"), F.col("first")).alias("owner"),
            F.lit(False).alias("re_export"),
            (F.col("o_orderpriority") == "1-URGENT").alias("public_api"),
            F.lit(False).alias("advice_exempt"),
            F.lit(False).alias("in_support"),
        )

    @cached_property
    def org_edges(self) -> DataFrame:
        """(source, target, kind, hardness, confidence)."""
        lines = self["lineitem"].select("l_orderkey", "l_partkey", "l_discount", "l_linestatus")
        # Dealt by order once: the rows of one order and part meet there, sorted as the join needs them.
        per = lines.repartition("l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.min("l_discount").alias("d"), F.min("l_linestatus").alias("ls"))
        j = per.join(self["orders"].select("o_orderkey", "o_orderdate", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
        # Numbers travel instead of words.
        j = j.select("l_partkey", "o_orderkey", "o_orderdate", "d", (F.col("ls") == "O").alias("hard"), _map(F.col("o_orderpriority"), {k: n for n, k in enumerate(KIND_OF_PRIORITY)}).cast("byte").alias("kind"))
        line = Window.partitionBy("l_partkey").orderBy("o_orderdate", "o_orderkey")
        seq = j.select(F.col("o_orderkey").alias("source"), F.lead("o_orderkey").over(line).alias("target"), "kind", "hard", "d").filter("target is not null")
        kind = _map(F.col("kind"), dict(enumerate(KIND_OF_PRIORITY.values())))
        return seq.select("source", "target", kind.alias("kind"), F.when(F.col("hard"), "Hard").otherwise("Soft").alias("hardness"), (1 - F.col("d")).alias("confidence"))

    @cached_property
    def customers(self) -> DataFrame:
        """(cust, file, folder, domain, package, packagegroup, name, segment, acctbal, start_folder moved when in debt)."""
        c = self["customer"].join(self["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        seg = segment_rank(F.col("c_mktsegment"))
        new = F.when(F.col("c_acctbal") < 0, (seg + 1) % len(SEGMENTS)).otherwise(seg)
        return c.select(
            F.col("c_custkey").alias("cust"), (F.col("c_custkey") * 8).alias("file"), folder_id(F.col("c_nationkey"), seg).alias("folder"),
            (F.col("c_nationkey").cast("long") * 8 + 2).alias("domain"), (F.col("n_regionkey").cast("long") * 8 + 3).alias("package"), F.lit(GROUP_ID).cast("long").alias("packagegroup"),
            F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("acctbal"), folder_id(F.col("c_nationkey"), new).alias("new_folder"),
        )

    @cached_property
    def org_tree(self) -> DataFrame:
        """Ancestor rows of the files: (id, file, folder, domain, package, packagegroup)."""
        return self.customers.select(F.col("file").alias("id"), "file", "folder", "domain", "package", "packagegroup")

    @cached_property
    def org_containers(self) -> DataFrame:
        """(id, name, level, parent)."""
        c = self.customers
        row = lambda i, n, level, up: c.select(F.col(i).alias("id"), n.cast("string").alias("name"), F.lit(level).alias("level"), (F.col(up) if up else F.lit(None).cast("long")).alias("parent")).distinct()
        return (
            row("file", F.col("name"), "File", "folder").unionByName(row("folder", F.col("folder"), "Folder", "domain")).unionByName(row("domain", F.col("domain"), "Domain", "package"))
            .unionByName(row("package", F.col("package"), "Package", "packagegroup")).unionByName(row("packagegroup", F.lit("world"), "PackageGroup", None))
        )

    @cached_property
    def affinities(self) -> DataFrame:
        """(owner, companion): an order and the same customer's next."""
        line = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        return self["orders"].select(F.col("o_orderkey").alias("owner"), F.lead("o_orderkey").over(line).alias("companion")).filter("companion is not null")

    @cached_property
    def relocated(self) -> DataFrame:
        """(id, file, start_file): urgent orders go to the file of the least order that follows one on them."""
        to = self.org_edges.groupBy(F.col("source").alias("id")).agg(F.min("target").alias("to"))
        home = self.org_nodes.select(F.col("id"), F.col("container").alias("start_file"))
        j = self.org_nodes.select("id", "container", "public_api").join(to, "id", "left").join(home.select(F.col("id").alias("to"), "start_file"), "to", "left")
        return j.select("id", F.when(F.col("public_api") & F.col("start_file").isNotNull(), F.col("start_file")).otherwise(F.col("container")).alias("file"), F.col("container").alias("start_file"))

    @cached_property
    def page_files(self) -> DataFrame:
        """(page_id, path): host/lang/leaf.html of every page."""
        path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
        return self["pages"].select("page_id", F.concat(path, F.lit(".html")).alias("path"))
