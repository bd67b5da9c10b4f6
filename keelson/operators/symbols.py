"""Moving single symbols between files: nominations as DataFrames, admission and greedy polish on one repository."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson import schema

MOST_SWEEPS, MOST_DESTINATIONS, COMPANION_PULL = 2, 4, 0.05  # fixed values: bounds of the search


def nominations(edges: DataFrame, nodes: DataFrame, zone: DataFrame, affinities: DataFrame | None = None, top: int = MOST_DESTINATIONS) -> DataFrame:
    """(id, file, pull, rank): the files that pull a symbol most.

    edges(source, target, weight), nodes(id, kind, file), zone(file). Edges that touch the zone do not pull. A
    companion pulls with a fixed coefficient. A type is only nominated where the pull exceeds that of its own file.
    """
    live = nodes.join(zone.select("file"), "file", "left_anti")
    # The file of the one who pulls joins first, then rows stay with the one who is pulled: its file, its groups and its rank need no other shuffle.
    ends = live.select("id", "file", (F.col("kind") == "Type").alias("typed"), (F.col("kind") == "FileBody").alias("body"))
    a, b = ends.select(F.col("id").alias("source"), F.struct("file", "typed", "body").alias("s")), ends.select(F.col("id").alias("target"), F.struct("file", "typed", "body").alias("t"))
    met = edges.select("source", "target", "weight").join(a, "source").join(b, "target")
    way = lambda x, y: F.struct(F.col(x).alias("id"), F.col(f"{x[0]}.file").alias("own"), F.col(f"{x[0]}.typed").alias("typed"), F.col(f"{x[0]}.body").alias("body"), F.col(f"{y[0]}.file").alias("file"), F.col("weight").alias("weight"))
    near = met.select(F.explode(F.array(way("source", "target"), way("target", "source"))).alias("n")).select("n.*")
    if affinities is not None:
        drawn = affinities.select(F.col("owner").alias("source"), F.col("companion").alias("target"), F.lit(COMPANION_PULL).alias("weight"))
        near = near.unionByName(drawn.join(a, "source").join(b, "target").select(way("target", "source").alias("n")).select("n.*"))
    pulls = near.filter("not body").drop("body").repartition("id").groupBy("id", "own", "typed", "file").agg(F.sum("weight").alias("pull"))
    pulls = pulls.withColumn("stay", F.max(F.when(F.col("file") == F.col("own"), F.col("pull"))).over(Window.partitionBy("id")))
    away = pulls.filter("file <> own and pull > 0").filter(~F.col("typed") | (F.round("pull", 6) > F.round(F.coalesce("stay", F.lit(0.0)), 6)))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("pull", 6)), "file"))
    return away.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("id", "file", "pull", "rank")


@dataclass(frozen=True)
class Symbol:
    id: int
    name: str
    kind: str
    file: str
    package: str
    size: int
    depth: int = 0
    test: bool = False
    pinned: bool = False
    start: bool = False


def admissible(s: Symbol, to: str, symbols: Mapping[int, Symbol], now: Mapping[int, str], edges: list[tuple[int, int, float]], package_of: Mapping[str, str], reach: set[tuple[str, str]], cap: int = schema.CAPS["File"]) -> bool:
    """May the symbol live in ``to``? Package wall, zone side, no name clash, no symbol into a type-only file, no file
    above its cap, and no pair of files brought together that did not reach each other at the start."""
    if s.pinned or s.start or s.kind == "FileBody" or package_of.get(to) != s.package:
        return False
    there = [symbols[i] for i, f in now.items() if f == to and i != s.id]
    left = [i for i, f in now.items() if f == now[s.id] and i != s.id]
    if not left or any(x.name == s.name for x in there):
        return False
    if there and (all(x.test for x in there) != s.test or (s.kind == "Symbol" and all(x.kind == "Type" for x in there))):
        return False
    if sum(x.size for x in there) + s.size > cap:
        return False
    for a, b, _ in edges:
        if s.id not in (a, b) or a == b:
            continue
        other = now[b if a == s.id else a]
        pair = (to, other) if a == s.id else (other, to)
        if other != to and pair not in reach:
            return False
    return True


def file_cycles(now: Mapping[int, str], edges: list[tuple[int, int, float]]) -> tuple[int, int]:
    from keelson.operators import kernels

    pairs = sorted({(now[a], now[b]) for a, b, w in edges if w > 0 and now[a] != now[b]})
    if not pairs:
        return 0, 0
    names = sorted({f for p in pairs for f in p})
    at = {f: i for i, f in enumerate(names)}
    scc = dict(kernels.strong_components([at[a] for a, _ in pairs], [at[b] for _, b in pairs]))
    size = Counter(scc.values())
    return sum(n for n in size.values() if n > 1), sum(scc[at[a]] == scc[at[b]] for a, b in pairs)


def polish(symbols: Mapping[int, Symbol], edges: list[tuple[int, int, float]], package_of: Mapping[str, str], score: Callable[[Mapping[int, str]], float]) -> dict[int, str]:
    """At most two sweeps over symbols in order; the first admitted destination that lowers the score is taken, once per symbol."""
    now = {i: s.file for i, s in symbols.items()}
    reach = {(now[a], now[b]) for a, b, _ in edges}
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in reach if b == c}
        if more == reach:
            break
        reach = more
    best, moved = score(now), set()
    for _ in range(MOST_SWEEPS):
        changed = False
        for i in sorted(symbols):
            if i in moved:
                continue
            pull: dict[str, float] = defaultdict(float)
            for a, b, w in edges:
                if i in (a, b) and a != b:
                    pull[now[b if a == i else a]] += w
            order = sorted((f for f, w in pull.items() if f != now[i] and w > 0), key=lambda f: (-pull[f], f))[:MOST_DESTINATIONS]
            for to in order:
                if symbols[i].kind == "Type" and pull[to] <= pull.get(now[i], 0.0):
                    continue
                if not admissible(symbols[i], to, symbols, now, edges, package_of, reach):
                    continue
                trial = {**now, i: to}
                if any(x > y for x, y in zip(file_cycles(trial, edges), file_cycles(now, edges))):
                    continue
                s = score(trial)
                if s < best - schema.EPSILON:
                    now, best, changed = trial, s, True
                    moved.add(i)
                    break
        if not changed:
            break
    return now
