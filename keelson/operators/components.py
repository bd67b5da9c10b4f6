"""Connected components of an undirected edge table, by alternating large-star and small-star steps.

Each step is one grouped minimum and one join on the edge table, so the work is in DataFrames
and the number of rounds grows with the logarithm of the longest path. The edge table is
deduplicated and checkpointed each round. Hot vertices are fine: minima are combined before the
shuffle, and the join sides are left to adaptive skew splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.session import cut

MOST_ROUNDS = 100


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(vertex, component): the least vertex reachable, for every vertex that an edge joins to another."""
    now = cut(edges.select(F.greatest(src, dst).alias("v"), F.least(src, dst).alias("u")).filter("u < v").distinct())
    total = now.count()
    for _ in range(MOST_ROUNDS):
        # Large star: every larger neighbour moves to the least of the closed neighbourhood.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        up = both.filter("v > u").join(least, "u").select("v", F.col("m").alias("u")).filter("u < v").distinct()
        # Small star: a vertex and its smaller neighbours move to the least of them.
        low = up.groupBy("v").agg(F.min("u").alias("m"))
        moved = up.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u < v")
        after = cut(moved.unionByName(low.select("v", F.col("m").alias("u"))).distinct())
        rows = after.count()
        if rows == total and not after.join(now, ["u", "v"], "left_anti").limit(1).count():
            break
        total, now = rows, after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("vertex"), F.col("u").alias("component")).distinct()
    return now.select(F.col("v").alias("vertex"), F.col("u").alias("component")).unionByName(roots)
