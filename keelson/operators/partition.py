"""Partitions of one vertex set: comparison, quotient, diversification."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions import search_tokens
from keelson.session import ship


def _cells(x: DataFrame, y: DataFrame) -> DataFrame:
    """Contingency table of partition(vertex, cluster) x and y."""
    both = x.select("vertex", F.col("cluster").alias("a")).join(y.select("vertex", F.col("cluster").alias("b")), "vertex")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"))


def vi_distance(x: DataFrame, y: DataFrame) -> DataFrame:
    """Variation of information H(x) + H(y) - 2 I, in nats, not below 0; one row."""
    cells = _cells(x, y)
    total = cells.agg(F.sum("n").alias("t"))
    h = lambda key: cells.groupBy(key).agg(F.sum("n").alias("n")).join(F.broadcast(total)).agg(F.sum(-F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t"))).alias(f"h_{key}"))
    joint = cells.join(F.broadcast(total)).agg(F.sum(-F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t"))).alias("h_ab"))
    row = joint.join(F.broadcast(h("a"))).join(F.broadcast(h("b")))
    return row.select(F.greatest(F.lit(0.0), F.coalesce(2 * F.col("h_ab") - F.col("h_a") - F.col("h_b"), F.lit(0.0))).alias("vi"))


def vi_matrix(partitions: dict[str, DataFrame]) -> DataFrame:
    """(a, b, vi) for every two of a few partitions."""
    names = sorted(partitions)
    rows = [vi_distance(partitions[a], partitions[b]).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "vi") for a in names for b in names if a < b]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def pair_f1(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Precision, recall and F1 of co-membership pairs, from counts of the contingency table; 0/0 is 1."""
    cells = _cells(expected, found)
    pairs = lambda c: c * (c - 1) / 2
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("tp"))
    exp = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("e"))
    got = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("g"))
    row = both.join(F.broadcast(exp)).join(F.broadcast(got))
    share = lambda a, b: F.when(F.coalesce(b, F.lit(0)) == 0, 1.0).otherwise(a / b)
    row = row.select(share(F.col("tp"), F.col("g")).alias("precision"), share(F.col("tp"), F.col("e")).alias("recall"))
    both_zero = F.col("precision") + F.col("recall") == 0
    return row.withColumn("f1", F.when(both_zero, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def moved_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(vertex, before, after) whose cluster, told by its members, changed; one-sided rows count as moved."""
    sign = lambda df, name: df.join(df.groupBy("cluster").agg(F.array_sort(F.collect_set("vertex")).alias("m")).select("cluster", F.sha2(F.array_join(F.transform("m", lambda v: v.cast("string")), ","), 256).alias(f"s_{name}")), "cluster").select("vertex", F.col("cluster").alias(name), f"s_{name}")
    j = sign(before, "before").join(sign(after, "after"), "vertex", "full")
    return j.filter(~F.col("s_before").eqNullSafe(F.col("s_after"))).select("vertex", "before", "after")


def name_alignment(members: DataFrame) -> DataFrame:
    """Per cluster, the share of members that share a token with its last name segment. members(cluster, name)."""
    hit = F.arrays_overlap(search_tokens(F.col("name")), search_tokens(F.element_at(F.split("cluster", "/"), -1)))
    return members.groupBy("cluster").agg(F.avg(hit.cast("double")).alias("alignment"))


def project(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """Lift coarse(vertex, cluster) to the finer level: fine(vertex, coarse_vertex)."""
    return fine.join(coarse.withColumnRenamed("vertex", "coarse_vertex"), "coarse_vertex").select("vertex", "cluster")


def dominant_members(files: DataFrame) -> DataFrame:
    """Per component the file with the largest size; ties to the smaller path. files(scc, path, size)."""
    best = Window.partitionBy("scc").orderBy(F.desc("size"), "path")
    return files.withColumn("k", F.row_number().over(best)).filter("k = 1").select("scc", "path", "size")


def plurality(votes: DataFrame) -> DataFrame:
    """Per group the key with most votes (ties to the smaller), its votes, all votes, and whether it has a strict majority."""
    c = votes.groupBy("grp", "key").agg(F.count("*").alias("n"))
    best = Window.partitionBy("grp").orderBy(F.desc("n"), "key")
    every = F.sum("n").over(Window.partitionBy("grp"))
    rows = c.withColumns({"k": F.row_number().over(best), "total": every}).filter("k = 1")
    return rows.select("grp", "key", F.col("n").alias("votes"), F.col("total").cast("long").alias("total"), (2 * F.col("n") > F.col("total")).alias("majority"))


def vi(x: Sequence[int], y: Sequence[int]) -> float:
    """Driver form of vi_distance for short assignments; only the common length counts."""
    n = min(len(x), len(y))
    if not n:
        return 0.0
    x, y = x[:n], y[:n]
    h = lambda c: -sum(k / n * math.log(k / n) for k in c.values())
    return max(0.0, 2 * h(Counter(zip(x, y))) - h(Counter(x)) - h(Counter(y)))


def diversify(candidates: Sequence[tuple[float, Sequence[int]]], k: int = 3, tolerance: float = 0.05, least: float = 0.05) -> tuple[list[int], bool]:
    """Indexes of up to k good and mutually distant candidates, best first, and whether fewer than k exist."""
    order = sorted(range(len(candidates)), key=lambda i: (candidates[i][0], list(candidates[i][1])))
    if not order:
        return [], True
    best = candidates[order[0]][0]
    bound = best * (1 + tolerance) if best >= 0 else best - best * tolerance
    pool = [i for i in order if candidates[i][0] <= bound]
    picked = [pool[0]]
    while len(picked) < k:
        rest = [(min(vi(candidates[i][1], candidates[p][1]) for p in picked), -r, i) for r, i in enumerate(pool) if i not in picked]
        rest = [x for x in rest if x[0] >= least]
        if not rest:
            break
        picked.append(max(rest)[2])
    picked.sort(key=lambda i: (candidates[i][0], list(candidates[i][1])))
    return picked, len(picked) < k


def restarts(seeds: DataFrame, solve: Callable[[int], tuple[float, list[int]]]) -> DataFrame:
    """Runs ``solve`` for each seed in parallel: (seed, score, assignment)."""
    ship(seeds.sparkSession)

    def run(frames):
        for pdf in frames:
            rows = [(int(s), *solve(int(s))) for s in pdf["seed"]]
            yield pd.DataFrame(rows, columns=["seed", "score", "assignment"])

    return seeds.select("seed").mapInPandas(run, "seed long, score double, assignment array<long>")
