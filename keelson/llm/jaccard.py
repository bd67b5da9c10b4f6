"""Exact n-gram Jaccard join by vertical partitioning.

Every document is the set of its word n-gram hashes, in one global order (that of the hashes).
The order is cut into fragments. Two sets with Jaccard similarity t or more differ in at most
D = (1 - t) / t * (the smaller size) n-grams, so of more than D fragments at least one is equal in
both: equal fragments (hashed) bring candidates together, without losing any. Sets meet only in
bands of like sizes. Fragments of fewer than two n-grams join unlike documents by chance; spare fragments make
them unnecessary, save for the few sets that have more of them than spares, which use all theirs.

Candidates that share a fragment are gathered round one of them (the pivot), once per pivot, not once per
fragment. Inside such a group overlaps are counted fragment by fragment
and summed per pair, first with the pivot, then from each set not yet linked to it against those of other
components; a pair is dropped when what is left cannot reach the bound. Only a spanning set of
links leaves a group. Groups above a size are dealt in blocks, each with the pivot: sets that reach the pivot
within their block are linked with one another, so only pairs with a set that does not (a loose one) are left, and
those are compared in pairs of blocks. Equal sets are one node (128 bits of hash) from the start.

Cases. Null, empty or blank text: no shingles, its own component. Fewer words than n: the whole
sequence is the one shingle. Repeated rows: equal sets, so linked. Null doc_id: linked like any,
never the component's id unless no other is there. Ties: the least hash. Empty table: no rows.
Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.operators.components import connected_components
from keelson.llm.workers import lean
from keelson.session import cut, partitions, ship

GROWTH = 1.25
FEWEST = 2
BLOCK_SHINGLES = 1_000_000
BLOCK_MEMBERS = 4_096
MOST_KEYS_SENT = 1_000_000
PIECES = 4
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams, A-Z in lower case."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(words) < n:
        x = np.array([len(words)], dtype=np.uint64)
        for v in h:
            x = _mix(x * _B + v)
        return x
    x = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        x = _mix(x * _B + h[k : k + len(x)] + _A)
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x


class Bands:
    """Size bands for a threshold percent/100: fragments, spares, and the fewest n-grams a fragment needs to count."""

    def __init__(self, percent: int, largest: int = 1 << 40):
        self.percent, self.upper, self.count, self.spare, self.fewest = percent, [0], [0], [0], [1]
        low = 1
        while self.upper[-1] < largest:
            high = max(low, int(low * GROWTH))
            differ = high * (100 - percent) // percent
            k, spare, fewest = differ + 1, 0, FEWEST
            for fewest in (FEWEST, 1):
                k = differ + 1
                for _ in range(20):
                    mean = low / k
                    few = math.exp(-mean) * (1 + mean if fewest == 2 else 1)
                    spare = min(differ // 2, math.ceil(1.5 * k * few))
                    k = differ + 1 + spare
                if spare <= differ // 5:
                    break
            self.upper.append(high)
            self.count.append(k if differ else 0)
            self.spare.append(spare)
            self.fewest.append(fewest)
            low = high + 1
        self.edges = np.array(self.upper)

    def of(self, size: int) -> list[int]:
        """The bands in which a set of this size signs: its own, and those of smaller sets it can be like."""
        own = int(np.searchsorted(self.edges, size))
        least = -(-size * self.percent // 100)
        return [b for b in range(int(np.searchsorted(self.edges, least)), own + 1) if self.count[b]]


def signatures(x: np.ndarray, bands: Bands) -> np.ndarray:
    """Hashes of the fragments under which a set looks for like ones."""
    out = []
    high, mixed = x >> np.uint64(32), None
    for b in bands.of(len(x)):
        k, spare = bands.count[b], bands.spare[b]
        ways = []
        for way in range(3 if len(x) < 64 else 1):
            if way:
                y = _mix(x ^ (_C * np.uint64(way)))
                y.sort()
                top = y >> np.uint64(32)
            else:
                y, top = x, high
            edge = np.searchsorted(top, (np.arange(1, k, dtype=np.uint64) << np.uint64(32)) // np.uint64(k) + np.uint64(1))
            edge = np.concatenate([[0], edge, [len(x)]])
            m = _mix(y + _A)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(m)])
            size = np.diff(edge)
            total = sums[edge[1:]] - sums[edge[:-1]]
            tag = np.full(k, b * 4 + way, dtype=np.uint64) * _C + np.arange(k, dtype=np.uint64) * _A
            key = _mix(total + _mix(tag) * _B + size.astype(np.uint64))
            ways.append((key, size >= bands.fewest[b]))
        poor = all((~big).sum() > spare for _, big in ways)
        out += [key if poor else key[big] for key, big in ways]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _node(x: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(x.tobytes(), seed=len(x)) if len(x) else None


def digest() -> F.Column:
    """16 bytes that stand for a text; null and empty texts are one."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, t (the text's digest), n_shingles, node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [shingles(t, n) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(v) for v in x], pa.int64()), pa.array([_node(v) for v in x], pa.binary())], names=["doc_id", "t", "n_shingles", "node"])

    return docs.select("doc_id", "text", digest().alias("t")).mapInArrow(lean(run), "doc_id long, t binary, n_shingles long, node binary")


def _signed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(sign, doc): the signatures of every set, once per set and task; doc is the document's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for b in batches:
            keys, signs, counts = [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                x = shingles(t, n)
                v = _node(x)
                if v is None or v in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(v)
                s = signatures(x, bands)
                keys.append(d)
                signs.append(s)
                counts.append(len(s))
            flat = np.concatenate(signs).view(np.int64) if signs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.array(keys, dtype=np.int64), counts))], names=["sign", "doc"])

    return docs.mapInArrow(lean(run), "sign long, doc long")


def link_group(nodes: list[bytes], sets: list[np.ndarray], percent: int, blocks: list[int] | None = None, joined: bool = False) -> tuple[list[tuple[bytes, bytes]], np.ndarray]:
    """A spanning set of the links among the sets (overlaps per fragment, summed per pair), and a label per set, equal in one component.

    With ``blocks`` (0 or 1 per set) only pairs across the two blocks count; with ``joined`` the sets of block 1
    are known to be one component.
    """
    m = len(nodes)
    label = np.arange(m)
    if m < 2:
        return [], label
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    if m == 2:
        if blocks and blocks[0] == blocks[1]:
            return [], label
        inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return ([(nodes[0], nodes[1])], label * 0) if 100 * inter >= percent * (sizes.sum() - inter) else ([], label)
    owner = np.repeat(np.arange(m), sizes)
    flat = np.concatenate(sets).view(np.uint64)
    _, ids = np.unique(flat, return_inverse=True)
    piece = (flat >> np.uint64(32)) * np.uint64(PIECES) >> np.uint64(32)
    parts = [(ids[p], owner[p]) for p in (piece == np.uint64(k) for k in range(PIECES))]
    parts = [(i, np.searchsorted(o, np.arange(m + 1))) for i, o in parts]
    side = np.array(blocks) if blocks else None
    if joined and side.any():
        label[side == 1] = label[side == 1][0]
    seen, out = np.zeros(int(ids.max()) + 1, dtype=np.int32), []

    def against(v: int, others: np.ndarray) -> np.ndarray:
        """Which of the others are linked with v."""
        need = -(-percent * (sizes[others] + sizes[v]) // (100 + percent))
        ok = (need <= sizes[v]) & (need <= sizes[others])
        others, need = others[ok], need[ok]
        have, left = np.zeros(len(others), dtype=np.int64), np.full(len(others), sizes[v])
        for i, edge in parts:
            if not len(others):
                return others
            mine = i[edge[v] : edge[v + 1]]
            if len(mine):
                seen[mine] = 1
                if len(others) > m // 4:
                    total = np.concatenate([[0], np.cumsum(seen[i])])
                    have += total[edge[others + 1]] - total[edge[others]]
                else:
                    have += [int(seen[i[edge[u] : edge[u + 1]]].sum()) for u in others.tolist()]
                seen[mine] = 0
            left -= len(mine)
            ok = have + left >= need
            others, need, have, left = others[ok], need[ok], have[ok], left[ok]
        return others

    for v in range(m - 1):
        # Of each pair the earlier set asks; pairs within one component need no comparison.
        others = v + 1 + np.flatnonzero(label[v + 1 :] != label[v])
        if side is not None:
            others = others[side[others] != side[v]]
        for u in against(v, others).tolist() if len(others) else ():
            if label[u] != label[v]:
                label[label == label[u]] = label[v]
                out.append((nodes[v], nodes[u]))
    return out, label


def _links(texts: DataFrame, deals: DataFrame, sizes: DataFrame, n: int, percent: int) -> DataFrame:
    """texts(key, text) compared as deals(doc, g) say; sizes(doc, s). See _compare for the rows.

    Copies of a text travel to each of its groups, and the more documents there are, the more groups each is in. So groups
    are taken in passes, each with about as many shingles as all documents have, and its shuffle files go behind it.
    """
    whole = sizes.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
    copies = deals.join(sizes, "doc").agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
    passes = max(1, math.ceil(copies / max(1, whole)))
    now = F.pmod(F.xxhash64("g.pivot", "g.a", "g.b"), F.lit(passes))
    found = [cut(_compare(_dealt(texts, deals.filter(now == k) if passes > 1 else deals), n, percent)) for k in range(passes)]
    return reduce(DataFrame.unionByName, found)


def _compare(members: DataFrame, n: int, percent: int) -> DataFrame:
    """members(pivot, a, b, side, later, t, doc, text), each group (pivot, a, b) within one task, together and the pivot first.

    A group with a = b is one block, a < b two, and b < 0 stands for loose sets (side 0) against sets linked with the
    pivot (side 1). Rows are links (src, dst), and (pivot, doc) of the loose sets of blocks with side 1: the first
    blocks of groups that have several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets, sides, docs, met = None, [], [], [], [], set()
        kinds = {"src": pa.binary(), "dst": pa.binary(), "pivot": pa.int64(), "doc": pa.int64()}

        def links() -> list[tuple]:
            if not now:
                return []
            pivot, a, b = now
            pairs, label = link_group(nodes, sets, percent, sides if a != b else None, joined=b < 0)
            loose = np.flatnonzero(label != label[0]).tolist() if a == b and sides[0] else ()
            return [(x, y, None, None) for x, y in pairs] + [(None, None, pivot, docs[k]) for k in loose]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values())], names=list(kinds))

        for b in batches:
            out: list[tuple] = []
            keys = list(zip(*(b.column(k).to_pylist() for k in range(3))))
            side, doc, text = b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).cast(pa.binary()).to_pylist()
            for r, key in enumerate(keys):
                if key != now:
                    out += links()
                    now, nodes, sets, sides, docs, met = key, [], [], [], [], set()
                x = shingles(text[r], n)
                v = _node(x)
                if v is None or (v, side[r]) in met:
                    continue
                met.add((v, side[r]))
                nodes.append(v)
                sides.append(side[r])
                docs.append(doc[r])
                sets.append(x.view(np.int64))
            yield batch(out)
        yield batch(links())

    together = members.repartition(partitions(members.sparkSession), "pivot", "a", "b").sortWithinPartitions("pivot", "a", "b", "later", "t", "doc")
    return together.select("pivot", "a", "b", "side", "doc", "text").mapInArrow(lean(run), "src binary, dst binary, pivot long, doc long")


def _groups(signed: DataFrame) -> DataFrame:
    """(pivot, doc): groups such that two documents with a signature in common meet in one of them.

    The pivot of a signature is the least document that has it. A pivot that stands under a lesser one
    itself gives its group to that, so copies of one text gather in few groups.
    """
    least = F.min("doc").over(Window.partitionBy("sign"))
    pairs = cut(signed.select(least.alias("pivot"), "doc").filter("pivot <> doc").distinct())
    above = cut(pairs.groupBy(F.col("doc").alias("pivot")).agg(F.min("pivot").alias("top")))
    given = pairs.join(above, "pivot", "left").withColumn("top", F.coalesce("top", "pivot"))
    every = given.select(F.col("top").alias("pivot"), F.explode(F.array("top", "pivot", "doc")).alias("doc"))
    return every.distinct()


def _components(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows (see _sets), and (vertex, component) of the linked nodes."""
    spark = ship(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Rows without an id get a key from their text; keys only bring candidates together.
    keyed = named.select(F.coalesce("doc_id", F.xxhash64("text")).alias("key"), "text")
    sets = cut(_sets(named, n))
    groups = cut(_groups(_signed(keyed, n, percent)))
    # Grouped sides are cut off before their joins: then both sides are shuffled, and a hot pivot can be split among tasks.
    blocks = cut(_blocks(groups, sets, named, "k"))
    dealt = groups.join(blocks, "pivot").withColumn("block", _block("k"))
    first = dealt.select("pivot", "doc", "k", F.explode(F.when(F.col("doc") == F.col("pivot"), _each("k")).otherwise(F.array("block"))).alias("block"))
    sizes = cut(_sizes(sets, named))
    found = _links(keyed, first.select("doc", _deal("block", "block", F.col("k") > 1)), sizes, n, percent)
    loose = found.filter("src is null").select("pivot", "doc").distinct()
    links = found.filter("src is not null").select("src", "dst")
    if loose.limit(1).count():
        loose = cut(loose)
        again = dealt.join(cut(_blocks(loose, sets, named, "c")), "pivot").join(loose.withColumn("loose", F.lit(True)), ["pivot", "doc"], "left")
        again = cut(again.select("pivot", "doc", "block", "k", "c", "loose"))
        # Only the texts of these groups travel again: known by their keys where those are few enough to be sent.
        keys = again.select(F.col("doc").alias("key")).distinct()
        near = keyed.join(F.broadcast(keys), "key", "left_semi") if keys.count() <= MOST_KEYS_SENT else keyed
        own, other = _block("c"), F.col("other")
        # Block j of the linked sets is named -1 - j.
        apart = again.filter("loose").select("pivot", "doc", own.alias("own"), F.explode(_each("c")).alias("other")).select("doc", _deal(F.least("own", other), F.greatest("own", other), F.col("own") > other))
        across = again.filter("loose").select("pivot", "doc", own.alias("own"), F.explode(_each("k")).alias("other")).select("doc", _deal("own", -1 - other, F.lit(False)))
        linked = again.filter("loose is null").select("pivot", "doc", "block", F.explode(_each("c")).alias("other")).select("doc", _deal("other", -1 - F.col("block"), F.lit(True)))
        more = _links(near, apart.unionByName(across).unionByName(linked), sizes, n, percent)
        links = links.unionByName(more.filter("src is not null").select("src", "dst"))
    return sets, connected_components(links)


def _blocks(groups: DataFrame, sets: DataFrame, named: DataFrame, name: str) -> DataFrame:
    """(pivot, number of blocks), by the shingles and members of each group."""
    wide = F.greatest(F.ceil(F.sum("s") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_MEMBERS), F.lit(1).cast("long"))
    return groups.join(_sizes(sets, named), "doc").groupBy("pivot").agg(wide.alias(name))


def _block(count: str) -> F.Column:
    return F.pmod(F.xxhash64("doc"), F.col(count))


def _each(count: str) -> F.Column:
    return F.sequence(F.lit(0).cast("long"), F.col(count) - 1)


def _deal(a: F.Column | str, b: F.Column | str, side: F.Column) -> F.Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct("pivot", col(a).cast("long").alias("a"), col(b).cast("long").alias("b"), side.cast("int").alias("side")).alias("g")


def _dealt(keyed: DataFrame, deals: DataFrame) -> DataFrame:
    """A row per deal with its text: pivot, a, b, side, later, t, doc, text. Texts meet their deals once, and are copied after that."""
    met = keyed.join(deals.groupBy(F.col("doc").alias("key")).agg(F.collect_list("g").alias("deals")), "key")
    each = met.select(F.explode("deals").alias("g"), F.col("key").alias("doc"), digest().alias("t"), "text")
    return each.select("g.pivot", "g.a", "g.b", "g.side", (F.col("doc") != F.col("g.pivot")).alias("later"), "t", "doc", "text")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    sets, comps = _components(docs, n, percent)
    ids = sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(comps, F.col("node") == F.col("vertex"), "left").withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = ids.join(least, "component").select("node", "component_id")
    return sets.select("doc_id", "n_shingles", "node").join(by_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_per_component(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(stay_id, stay_t, repeated): doc_id and digest of the row that stays of each component.

    It is the one with the least (doc_id, digest), null ids last; ``repeated`` says that several rows are equal in
    both. Rows without shingles all stay, and are never marked as repeated.
    """
    sets, comps = _components(docs, n, percent)
    rows = sets.filter("node is not null").groupBy("node", "doc_id", "t").agg(F.count("*").alias("c"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "c")
    # Least by node first, so that equal texts do not meet in the join.
    best = rows.groupBy("node").agg(F.min(place).alias("best")).join(comps, F.col("node") == F.col("vertex"), "left")
    best = best.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("best").alias("best"))
    blank = sets.filter("node is null").select("doc_id", "t", F.lit(False)).distinct()
    return best.select(F.col("best.doc_id").alias("stay_id"), F.col("best.t").alias("stay_t"), (F.col("best.c") > 1).alias("repeated")).union(blank)


def _sizes(sets: DataFrame, named: DataFrame) -> DataFrame:
    """(doc, s): shingles of each key; keys of rows without an id count as one block's worth of members only."""
    known = sets.filter("doc_id is not null").groupBy(F.col("doc_id").alias("doc")).agg(F.max("n_shingles").alias("s"))
    keys = named.filter("doc_id is null").select(F.xxhash64("text").alias("doc"), F.length("text").cast("long").alias("s")).distinct()
    return known.unionByName(keys).groupBy("doc").agg(F.max("s").alias("s"))
