"""Graph kernels over edge tables: prices, projections, components, layers, closure, re-export chains.

Vertices are longs. Iterations cut lineage each round; per-component solvers run in pandas only for
components below a size, larger ones are solved by DataFrame rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson import schema
from keelson.functions import edge_weight
from keelson.operators import kernels
from keelson.operators.components import connected_components
from keelson.session import cut, partitions, ship

LOCAL_EDGES = 1_000_000
MOST_ROUNDS = 10_000
MOST_PARTS = 100
SLICE = 1_024


def price_edges(edges: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """edges plus weight = kind weight times confidence; zero-priced rows stay."""
    return edges.withColumn("weight", edge_weight(F.col("kind"), F.col("confidence"), weights))


def hard_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("hardness") == "Hard")


def weighted_edges(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """One row per (src, dst) with parallel weights summed."""
    return edges.groupBy("src", "dst").agg(F.sum(weight).alias("weight"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "__s", "dst": "src"}).withColumnRenamed("__s", "dst")


def file_graph(edges: DataFrame, home: DataFrame, zone: DataFrame) -> DataFrame:
    """Edges between owning files: edges(source, target, weight), home(id, file), zone(file).

    Edges inside a file go; those that touch the zone keep their row at price 0; parallel ones are summed.
    """
    a = home.select(F.col("id").alias("source"), F.col("file").alias("src"))
    b = home.select(F.col("id").alias("target"), F.col("file").alias("dst"))
    z = zone.select("file").distinct()
    zs, zd = z.select(F.col("file").alias("src"), F.lit(True).alias("zs")), z.select(F.col("file").alias("dst"), F.lit(True).alias("zd"))
    crossing = edges.join(a, "source").join(b, "target").filter("src <> dst").join(zs, "src", "left").join(zd, "dst", "left")
    price = F.when(F.col("zs") | F.col("zd"), 0.0).otherwise(F.col("weight"))
    return crossing.select("src", "dst", price.alias("weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _trimmed(edges: DataFrame, rounds: int) -> DataFrame:
    """Drop edges at vertices that lack incoming or outgoing edges: those are on no cycle."""
    now = edges
    for _ in range(rounds):
        outs, ins = now.select(F.col("src").alias("v")).distinct(), now.select(F.col("dst").alias("v")).distinct()
        both = outs.join(ins, "v").select("v")
        now = now.join(both.withColumnRenamed("v", "src"), "src", "left_semi").join(both.withColumnRenamed("v", "dst"), "dst", "left_semi")
    return now


def condense(edges: DataFrame, vertices: DataFrame | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, scc): strongly connected components, each named by its least member.

    Vertices off every cycle are trimmed away first; what is left is split into weakly connected
    parts. Parts below ``local_edges`` are solved in one task each, larger ones by colouring rounds.
    """
    ship(edges.sparkSession)
    plain = cut(edges.select("src", "dst").distinct())
    every = plain.select(F.col("src").alias("node")).union(plain.select(F.col("dst").alias("node")))
    every = (every.union(vertices.select("node")) if vertices is not None else every).distinct()
    core = cut(_trimmed(plain.filter("src <> dst"), 3))
    parts = connected_components(core)
    dealt = core.join(parts.withColumnRenamed("vertex", "src"), "src")
    sizes = cut(dealt.groupBy("component").agg(F.count("*").alias("m")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(kernels.strong_components(pdf["src"].to_numpy(), pdf["dst"].to_numpy()), columns=["node", "scc"])

    # Small parts are solved in batches of about LOCAL_EDGES edges.
    total = sizes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    batches = max(8, total // max(1, local_edges // 4))
    small = dealt.join(sizes.filter(F.col("m") <= local_edges).select("component"), "component", "left_semi")
    found = small.groupBy(F.pmod(F.xxhash64("component"), F.lit(batches)).alias("batch")).applyInPandas(solve, "node long, scc long") if total else None
    large = sizes.filter(F.col("m") > local_edges).select("component")
    if large.limit(1).count():
        big = color_components(dealt.join(large, "component", "left_semi").select("src", "dst"))
        found = found.unionByName(big)
    if found is None:
        return every.select("node", F.col("node").alias("scc"))
    return every.join(found, "node", "left").select("node", F.coalesce("scc", "node").alias("scc"))


def color_components(edges: DataFrame) -> DataFrame:
    """Strong components by colouring: least reaching vertex forward, then backward from each colour's root."""
    now, done = cut(edges.select("src", "dst").distinct()), None
    for _ in range(MOST_ROUNDS):
        if not now.limit(1).count():
            break
        ids = now.select(F.col("src").alias("v")).union(now.select(F.col("dst").alias("v"))).distinct()
        color = cut(ids.select("v", F.col("v").alias("c")))
        while True:
            sent = now.join(color.select(F.col("v").alias("src"), "c"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("c").alias("n"))
            after = cut(color.join(sent, "v", "left").select("v", F.least("c", F.coalesce("n", "c")).alias("c"), (F.coalesce("n", "c") < F.col("c")).alias("moved")))
            moved = after.filter("moved").limit(1).count()
            color = after.select("v", "c")
            if not moved:
                break
        inside = now.join(color.select(F.col("v").alias("src"), F.col("c").alias("cs")), "src").join(color.select(F.col("v").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd")
        inside = cut(inside.select("src", "dst", F.col("cs").alias("c")))
        front = color.filter("v = c")
        reach = cut(front)
        while front.limit(1).count():
            back = inside.join(front.select(F.col("v").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("v"), "c").distinct()
            front = cut(back.join(reach, ["v", "c"], "left_anti"))
            reach = cut(reach.unionByName(front))
        got = reach.select(F.col("v").alias("node"), F.col("c").alias("scc"))
        done = got if done is None else done.unionByName(got)
        gone = reach.select("v")
        now = cut(now.join(gone.withColumnRenamed("v", "src"), "src", "left_anti").join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti"))
    else:
        raise RuntimeError("strong components did not settle")
    return done if done is not None else edges.select(F.col("src").alias("node"), F.col("src").alias("scc")).limit(0)


def quotient(edges: DataFrame, membership: DataFrame, vertex: str = "node", cluster: str = "scc") -> DataFrame:
    """Cluster graph: loops dropped, cross weights summed."""
    a = membership.select(F.col(vertex).alias("src"), F.col(cluster).alias("cs"))
    b = membership.select(F.col(vertex).alias("dst"), F.col(cluster).alias("cd"))
    return edges.join(a, "src").join(b, "dst").filter("cs <> cd").groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.sum("weight").alias("weight"))


def layers(dag: DataFrame, vertices: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, layer): 1 without dependencies, else 1 + the highest layer depended on. ``dag`` has no cycle."""
    ship(dag.sparkSession)
    dag = cut(dag.select("src", "dst").distinct())
    parts = connected_components(dag)
    dealt = cut(dag.join(parts.withColumnRenamed("vertex", "src"), "src"))
    sizes = cut(dealt.groupBy("component").agg(F.count("*").alias("m")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(kernels.longest_layers(pdf["src"].to_numpy(), pdf["dst"].to_numpy()), columns=["node", "layer"])

    small = dealt.join(sizes.filter(F.col("m") <= local_edges).select("component"), "component", "left_semi")
    found = small.groupBy("component").applyInPandas(solve, "node long, layer long")
    large = sizes.filter(F.col("m") > local_edges).select("component")
    if large.limit(1).count():
        found = found.unionByName(_layers_by_rounds(dealt.join(large, "component", "left_semi").select("src", "dst")))
    return vertices.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("layer", F.lit(1)).cast("long").alias("layer"))


def _layers_by_rounds(dag: DataFrame) -> DataFrame:
    """A layer a round; each is written once, and all are put together at the end."""
    rest, at, done = cut(dag), 1, []
    while True:
        outs = rest.select(F.col("src").alias("node")).distinct()
        leaves = rest.select(F.col("dst").alias("node")).distinct().join(outs, "node", "left_anti")
        if not leaves.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        got = leaves.select("node", F.lit(at).cast("long").alias("layer"))
        after = cut(rest.join(leaves.withColumnRenamed("node", "dst"), "dst", "left_anti"))
        last = rest.select(F.col("src").alias("node")).distinct().join(after.select(F.col("src").alias("node")), "node", "left_anti")
        ending = last.join(after.select(F.col("dst").alias("node")), "node", "left_anti").select("node", F.lit(at + 1).cast("long").alias("layer"))
        done.append(cut(got.unionByName(ending)))
        if len(done) == MOST_PARTS:
            done = [cut(reduce(DataFrame.unionByName, done))]
        rest, at = after, at + 1


def closure(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(start, reached): pairs joined by one hop or more, each once.

    There can be as many as the square of the vertices, so they are made where they are given out, neither grouped nor
    shuffled: a weakly connected part below ``local_edges`` edges goes to several tasks, each of which finds what leads to
    some slices of its vertices. Larger parts are solved by DataFrame rounds.
    """
    spark = ship(edges.sparkSession)
    plain = cut(edges.select("src", "dst").distinct())
    parts = connected_components(plain)
    # A loop joins a vertex to no other, so it may be in no component.
    dealt = cut(plain.join(parts.withColumnRenamed("vertex", "src"), "src", "left").withColumn("component", F.coalesce("component", "src")))
    sizes = cut(dealt.groupBy("component").agg(F.count("*").alias("m")))
    small, large = sizes.filter(F.col("m") <= local_edges), sizes.filter(F.col("m") > local_edges).select("component")
    # Parts of few edges are put together.
    tiny = F.col("m") < SLICE
    batch = F.when(tiny, F.pmod(F.xxhash64("component"), F.lit(max(8, plain.count() // SLICE)))).otherwise(F.col("component"))
    most = max(1, 4 * partitions(spark))
    tasks = F.when(tiny, 1).otherwise(F.least(F.ceil(F.col("m") / SLICE), F.lit(most)))
    ways = small.select("component", tiny.alias("tiny"), batch.alias("batch"), tasks.cast("int").alias("tasks"), F.explode(F.sequence(F.lit(0), tasks.cast("int") - 1)).alias("task"))
    sent = dealt.join(ways, "component").select("tiny", "batch", "task", "tasks", "src", "dst")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def pairs() -> Iterator[pa.RecordBatch]:
            if now is not None:
                src, dst = (np.concatenate([h[k] for h in held]) for k in range(2))
                of = max(now[3], -(-len(np.union1d(src, dst)) // SLICE))
                for start, reached in kernels.reach_slices(src, dst, range(now[2], of, now[3]), of):
                    yield pa.RecordBatch.from_arrays([pa.array(start), pa.array(reached)], names=["start", "reached"])

        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(4))))
            src, dst = b.column(4).to_numpy(), b.column(5).to_numpy()
            low = 0
            for k in range(len(keys) + 1):
                if k == len(keys) or (k and keys[k] != keys[k - 1]):
                    if k > low:
                        if keys[low] != now:
                            yield from pairs()
                            now, held = keys[low], []
                        held.append((src[low:k].copy(), dst[low:k].copy()))
                    low = k
        yield from pairs()

    keys = ("tiny", "batch", "task", "tasks")
    found = sent.repartition(most, *keys).sortWithinPartitions(*keys).mapInArrow(solve, "start long, reached long")
    if large.limit(1).count():
        found = found.unionByName(_closure_by_rounds(dealt.join(large, "component", "left_semi").select("src", "dst")))
    return found


def _closure_by_rounds(edges: DataFrame) -> DataFrame:
    """Computed between strong components, doubling path lengths each round, then spread to members."""
    membership = cut(condense(edges))
    hop = quotient(edges.withColumn("weight", F.lit(1.0)), membership).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    reach = cut(hop.distinct())
    n = reach.count()
    while True:
        longer = reach.join(reach.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        reach = cut(reach.unionByName(longer).distinct())
        m = reach.count()
        if m == n:
            break
        n = m
    looped = membership.groupBy("scc").agg(F.count("*").alias("k")).filter("k > 1").select("scc")
    own = edges.filter("src = dst").select(F.col("src").alias("scc")).distinct()
    loops = looped.union(own.join(membership.select(F.col("node").alias("scc"), F.col("scc").alias("m")), "scc").select("m")).distinct().select(F.col("scc").alias("a"), F.col("scc").alias("b"))
    pairs = reach.unionByName(loops)
    left, right = membership.select(F.col("scc").alias("a"), F.col("node").alias("start")), membership.select(F.col("scc").alias("b"), F.col("node").alias("reached"))
    # A self-loop's component may have other members only if it is looped anyway.
    return pairs.join(left, "a").join(right, "b").select("start", "reached")


def flatten_re_exports(targets: DataFrame, re_exports: DataFrame, most_hops: int = schema.MAX_REEXPORT_HOPS) -> DataFrame:
    """targets(node) to (node, target, hops): follow re_exports(source, target) until a vertex that re-exports
    nothing, or itself. Pointer doubling; chains longer than ``most_hops`` raise, naming an origin."""
    step = re_exports.groupBy("source").agg(F.max("target").alias("to")).filter("source <> to")
    jump = cut(step.select(F.col("source").alias("at"), "to", F.lit(1).cast("long").alias("hops")))
    rounds = most_hops.bit_length() + 1
    for _ in range(rounds):
        further = jump.select(F.col("at").alias("to"), F.col("to").alias("then"), F.col("hops").alias("more"))
        jumped = jump.join(further, "to", "left")
        live = jumped.filter(F.col("then").isNotNull() & (F.col("hops") <= most_hops)).limit(1).count()
        jump = cut(jumped.select("at", F.coalesce("then", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
        if not live:
            break
    deep = jump.filter(F.col("hops") > most_hops).orderBy("at").limit(1).collect()
    if deep:
        raise ReExportDepthExceeded(deep[0]["at"])
    return targets.select("node").distinct().join(jump, F.col("node") == F.col("at"), "left").select("node", F.coalesce("to", "node").alias("target"), F.coalesce("hops", F.lit(0)).cast("long").alias("hops"))


class ReExportDepthExceeded(ValueError):
    code = "RE_EXPORT_DEPTH_EXCEEDED"

    def __init__(self, origin: int):
        super().__init__(f"re-export chain from {origin} is too deep")
        self.origin = origin


def cycle_counts(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: vertices in components of two or more, and edges inside them."""
    size = membership.groupBy("scc").agg(F.count("*").alias("k")).filter("k > 1")
    nodes = size.agg(F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("cyclic_nodes"))
    a = membership.select(F.col("node").alias("src"), F.col("scc").alias("cs"))
    b = membership.select(F.col("node").alias("dst"), F.col("scc").alias("cd"))
    inner = edges.select("src", "dst").distinct().filter("src <> dst").join(a, "src").join(b, "dst").filter("cs = cd").agg(F.count("*").alias("cyclic_edges"))
    return nodes.join(F.broadcast(inner))


def shatter(edges: DataFrame, membership: DataFrame, exact_vertices: int = schema.EXACT_VERTICES, seconds: float = schema.EXACT_SECONDS) -> DataFrame:
    """Cheapest edges to cut so that each component becomes acyclic: (scc, src, dst, weight, exact).

    edges(src, dst, weight); an absent weight counts 1. Exact within the budgets, else by heuristic; ``exact`` says which.
    """
    ship(edges.sparkSession)
    size = membership.groupBy("scc").agg(F.count("*").alias("k")).filter("k > 1").select("scc")
    big = membership.join(size, "scc", "left_semi")
    a = big.select(F.col("node").alias("src"), F.col("scc"))
    b = big.select(F.col("node").alias("dst"), F.col("scc").alias("other"))
    inner = edges.filter("src <> dst").join(a, "src").join(b, "dst").filter("scc = other")
    inner = inner.groupBy("scc", "src", "dst").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        cuts, exact = kernels.feedback_arcs(list(zip(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["weight"].tolist())), exact_vertices, seconds)
        rows = [(int(pdf["scc"].iloc[0]), s, d, w, exact) for s, d, w in cuts]
        return pd.DataFrame(rows, columns=["scc", "src", "dst", "weight", "exact"])

    return inner.groupBy("scc").applyInPandas(solve, "scc long, src long, dst long, weight double, exact boolean")


def pull_targets(edges: DataFrame, home: DataFrame, top: int = 4) -> DataFrame:
    """(vertex, cluster, pull, rank): the clusters that pull a vertex most, other than its own; ties, to six decimals, go to the lower id."""
    here = home.select(F.col("vertex"), F.col("cluster").alias("own"))
    there = home.select(F.col("vertex").alias("other"), "cluster")
    both = edges.select(F.col("src").alias("vertex"), F.col("dst").alias("other"), "weight").unionByName(edges.select(F.col("dst").alias("vertex"), F.col("src").alias("other"), "weight"))
    pulls = both.join(here, "vertex").join(there, "other").filter("cluster <> own").groupBy("vertex", "cluster").agg(F.sum("weight").alias("pull")).filter("pull > 0")
    rank = F.row_number().over(Window.partitionBy("vertex").orderBy(F.desc(F.round("pull", 6)), "cluster"))
    return pulls.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
