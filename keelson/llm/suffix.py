"""Suffix-array dedup: finds every string of ``length`` bytes that starts at two places of the corpus.

Every window has an anchor: the leftmost of its byte k-grams with the least hash. Equal windows have equal
anchors, so windows meet by anchor: runs of neighbouring windows with one anchor form a piece, and only
pieces whose anchor occurs twice are gathered. Equal pieces of a task leave it as one, so a passage that very
many documents share reaches the next task once per task. There the pieces are strung
together and their suffix array is built by two-stage sorting: suffixes smaller than their
successors are sorted directly, all others are induced by one scan over the buckets; then the common
prefixes of adjacent suffixes tell which windows repeat. Anchors with very many pieces are split by the
bytes that all windows of a slot share, and those with extremely many by whole windows.

Two lengths can be asked for at once: strings of ``length`` bytes go wherever they stand, strings of ``once`` bytes
stay where they come first (by doc_id, null last, then the digest of the text, then the position) and go elsewhere.

Cases. Null or empty text: no bytes, nothing removed. Texts shorter than the strings: kept. Equal texts
and repeated rows: repeats of each other, wherever they are long enough; where a first copy stays, rows equal in
doc_id and text are one and stay alike. Matches never cross documents. Null
doc_id: a document like any, after those with one. Empty table: no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.workers import lean
from keelson.session import cut, partitions, ship

LENGTH = 400
GRAM = 64
CHUNK = 1 << 20
BUFFER = 2 << 20
HOT_PIECES = 2_000
SLOT = 32
HELD = 16 << 20
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, dtype=np.uint64)
_MULTIPLIER = 0x9E3779B97F4A7C15
_PLACES = np.uint64((1 << 24) - 1)


def gram_hashes(text: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of each ``gram`` (a power of two) bytes, by doubling."""
    h, size, factor = _TABLE[text], 1, _MULTIPLIER
    while size < gram:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor = factor * factor & (1 << 64) - 1
        size *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(text: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Per window start: the place of its anchor, and the anchor's hash. At most CHUNK windows."""
    h = gram_hashes(text, gram)
    w = length - gram + 1
    n = len(h) - w + 1
    v = (h & ~_PLACES) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(v) // w)
    grid = np.full(rows * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[: len(v)] = v
    grid = grid.reshape(rows, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & _PLACES).astype(np.int64)
    return place, h[place]


def runs(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows, does the anchor occur twice in this text) of every piece."""
    text = np.frombuffer(raw, dtype=np.uint8)
    keys, firsts, sizes, spots = [], [], [], []
    for at in range(0, len(text) - length + 1, CHUNK):
        place, h = anchors(text[at : at + CHUNK + length - 1], length, gram)
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        moved = np.concatenate([[0], np.cumsum(place[1:] != place[:-1])])
        end = np.append(new[1:], len(h))
        keys.append(h[new])
        firsts.append(new + at)
        sizes.append(end - new)
        spots.append(moved[end - 1] - moved[new] + 1)
    if not keys:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    key, spot = np.concatenate(keys), np.concatenate(spots)
    _, inverse = np.unique(key, return_inverse=True)
    often = np.bincount(inverse, weights=spot) > 1
    return key, np.concatenate(firsts), np.concatenate(sizes), often[inverse]


def two_stage(text: np.ndarray, depth: int = LENGTH, asked: np.ndarray | None = None) -> np.ndarray:
    """The suffix array of ``text``, ordered by the first ``depth`` bytes at least.

    With ``asked`` (one boolean per byte) it holds the suffixes asked for, and those they are induced from.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    # Smaller than the successor: at the next different byte it rises.
    differs = text[1:] != text[:-1]
    change, following = np.flatnonzero(differs), np.append(0, np.cumsum(differs))
    rises = np.append(text[change + 1] > text[change], False)
    smaller = rises[following]
    needed = np.ones(n, dtype=bool)
    if asked is not None:
        # A suffix that is induced needs its successors, as far as the first that is sorted directly.
        last = np.maximum.accumulate(np.where(asked, np.arange(n), -1))
        before = np.maximum.accumulate(np.where(smaller, np.arange(n), -1))
        needed = asked | (last > np.append(-1, before[:-1]))
    first = text.astype(np.int64)
    all_of, small_of = np.bincount(first[needed], minlength=256), np.bincount(first[smaller & needed], minlength=256)
    start = np.concatenate([[0], np.cumsum(all_of)])
    sa = np.empty(int(start[-1]), dtype=np.int64)
    # Directly sorted, two leading bytes at a time.
    raw, own = text.tobytes(), np.flatnonzero(smaller & needed)
    second = np.append(first[1:], 0)[own]
    pair = (first[own] << 8 | second).astype(np.uint16)
    own = own[np.argsort(pair, kind="stable")]
    edge = np.concatenate([[0], np.cumsum(np.bincount(pair, minlength=65_536))])
    full = np.flatnonzero(np.diff(edge))
    fill: list[int] = []
    for p in full.tolist():
        some = own[edge[p] : edge[p + 1]].tolist()
        if len(some) > 1:
            some.sort(key=lambda i: raw[i : i + depth])
        fill += some
    slots = np.concatenate([np.arange(start[c + 1] - small_of[c], start[c + 1]) for c in range(256)]) if len(fill) else np.zeros(0, np.int64)
    sa[slots] = fill
    # Induced: the scan meets S[i + 1] before it needs S[i].
    head = start[:-1].copy()

    def induce(batch: np.ndarray) -> None:
        p = batch - 1
        p = p[p >= 0]
        p = p[~smaller[p] & needed[p]]
        if not len(p):
            return
        c = text[p]
        order = np.argsort(c, kind="stable")
        p, count = p[order], np.bincount(c, minlength=256)
        at = 0
        for b in np.flatnonzero(count).tolist():
            k = int(count[b])
            sa[head[b] : head[b] + k] = p[at : at + k]
            head[b] += k
            at += k

    induce(np.array([n]))
    for c in np.flatnonzero(all_of).tolist():
        done = int(start[c])
        while done < head[c]:
            batch = sa[done : head[c]]
            done = int(head[c])
            induce(batch)
        induce(sa[start[c + 1] - small_of[c] : start[c + 1]])
    return sa


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Common prefix lengths of the suffixes at a and b, up to ``most`` rounded up to a word."""
    padded = text.tobytes() + bytes(most + 16)
    word = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))
    out, live, depth = np.zeros(len(a), dtype=np.int64), np.arange(len(a)), 0
    while len(live) and depth < most:
        x = word[a[live] + depth] ^ word[b[live] + depth]
        differ = x != 0
        low = x[differ]
        tail = np.zeros(len(low), dtype=np.int64)
        for k in range(1, 8):
            tail += (low << np.uint64(64 - 8 * k)) == 0
        out[live[differ]] = depth + tail
        live = live[~differ]
        depth += 8
    out[live] = depth
    return out


def repeated_windows(pieces: list[bytes], windows: list[int], length: int = LENGTH, places: list[tuple] | None = None, longer: int | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per piece: which of its first ``windows`` starts begin a string of ``length`` bytes that also starts elsewhere
    in the pieces, and which begin one of ``longer`` bytes that does.

    With ``places`` (document order and first window of each piece) the least place of a shorter string is not among them.
    """
    flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    counted = np.zeros(len(flat), dtype=bool)
    for s, k in zip(begin.tolist(), windows):
        counted[s : s + k] = True
    most = max(length, longer or 0)
    sa = two_stage(flat, most, counted)
    sa = sa[counted[sa]]
    hit, far = np.zeros(len(flat), dtype=bool), np.zeros(len(flat), dtype=bool)
    if len(sa) > 1:
        shared = common_prefixes(flat, sa[:-1], sa[1:], most)
        same = shared >= length
        hit[sa[1:][same]] = True
        hit[sa[:-1][same]] = True
        if same.any() and (places is not None or longer):
            owner = np.searchsorted(begin, sa, side="right") - 1
        if places is not None and same.any():
            rank = {d: k for k, d in enumerate(sorted({d for d, _ in places}))}
            base = np.array([(rank[d] << 40) + a for d, a in places], dtype=np.int64)
            spot = base[owner] + sa - begin[owner]
            group = np.flatnonzero(np.append(True, ~same))
            hit[sa[spot == np.repeat(np.minimum.reduceat(spot, group), np.diff(np.append(group, len(sa))))]] = False
        if longer and same.any():
            # Near the end of its text a window has too few bytes to begin a longer string.
            full = begin[owner + 1] - sa >= longer
            group = np.append(0, np.cumsum(shared < longer))
            far[sa[full & (np.bincount(group, weights=full)[group] > 1)]] = True
    cut_up = lambda x: [x[s : s + k] for s, k in zip(begin.tolist(), windows)]
    return cut_up(hit), cut_up(far)


def self_repeats(pieces: list[bytes], gram: int = 32) -> list[bool]:
    """Per piece: may a string of ``gram`` bytes occur twice in it?"""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    out = np.zeros(len(pieces), dtype=bool)
    if sizes.sum() >= gram:
        h = gram_hashes(np.frombuffer(b"".join(pieces), dtype=np.uint8), gram)
        owner = np.repeat(np.arange(len(pieces)), sizes)[: len(h)]
        inside = np.cumsum(sizes)[owner] - np.arange(len(h)) >= gram
        key, owner = (h + owner.astype(np.uint64) * np.uint64(_MULTIPLIER))[inside], owner[inside]
        order = np.argsort(key)
        out[owner[order[1:][key[order[1:]] == key[order[:-1]]]]] = True
    return out.tolist()


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges that windows at the ascending ``starts`` cover."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate([[0], gap + 1])].tolist(), (starts[np.append(gap, len(starts) - 1)] + length).tolist()))


def _split_hot(raw: bytes, first: int, count: int, length: int, gram: int, width: int) -> Iterator[tuple[int, int, int]]:
    """(route, first window, windows): slots of a piece, routed by the bytes that all windows of a slot share."""
    for at in range(first, first + count, CHUNK):
        n = min(CHUNK, first + count - at)
        place, h = anchors(np.frombuffer(raw, np.uint8, n + length - 1, at), length, gram)
        back = place - np.arange(n)
        slot = back // width
        edge = np.flatnonzero(np.concatenate([[True], (slot[1:] != slot[:-1]) | (place[1:] != place[:-1]), [True]]))
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
            q, p = int(slot[a]), at + int(place[a])
            core = raw[p - q * width : p - q * width - width + 1 + length]
            yield xxhash.xxh3_64_intdigest(core, seed=(int(h[a]) + q) & (1 << 63) - 1), at + a, z - a


def _signed(x: np.ndarray | list) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


class Pieces:
    """Pieces held by their bytes, each with its least place, and the ranges of those met again."""

    def __init__(self, length: int | None, once: int | None):
        self.length, self.once, self.held, self.size = length, once, {}, 0
        self.done: list[tuple[bytes, int, int, bool]] = []  # text, start, end, is it of a string that stays elsewhere

    def whole(self, t: bytes, a: int, n: int, size: int, later: bool = True) -> None:
        """All windows of a piece repeat."""
        if self.once and later:
            self.done.append((t, a, a + n - 1 + self.once, True))
        if self.length and (m := min(n, size - self.length + 1)) > 0:
            self.done.append((t, a, a + m - 1 + self.length, False))

    def add(self, route: int, place: tuple[int, bytes, int], n: int, piece: bytes, met: bool) -> None:
        h = self.held.get((route, n, piece))
        if h is None:
            self.held[(route, n, piece)] = [place, met]
            self.size += len(piece)
        elif h[0] == place:
            h[1] |= met
        else:
            later, h[0], h[1] = max(h[0], place), min(h[0], place), True
            self.whole(later[1], later[2], n, len(piece))

    def solve(self) -> None:
        """Turns what is held into ranges."""
        base, alone = min(x for x in (self.length, self.once) if x), Counter(k for k, _, _ in self.held)
        single = [x for x in self.held if alone[x[0]] == 1]
        # A piece that met no other needs no sorting, unless it may repeat within itself.
        calm = {x for x, again in zip(single, self_repeats([p for _, _, p in single])) if not again}
        for (_, n, p), ((_, t, a), met) in ((x, self.held.pop(x)) for x in calm):
            if met:
                self.whole(t, a, n, len(p), later=False)
        if self.held:
            hit, far = repeated_windows([p for _, _, p in self.held], [n for _, n, _ in self.held], base, [((o, t), a) for (o, t, a), _ in self.held.values()] if self.once else None, self.length)
            for ((_, n, p), ((_, t, a), met)), f, g in zip(self.held.items(), hit, far):
                if self.once:
                    self.done.extend((t, x, y, True) for x, y in covered(a + np.flatnonzero(f), self.once))
                if met:
                    self.whole(t, a, n, len(p), later=False)
                elif self.length:
                    self.done.extend((t, x, y, False) for x, y in covered(a + np.flatnonzero(g), self.length))
        self.held, self.size = {}, 0


ROW = "to long, route long, o long, t binary, a long, n long, met boolean, later boolean, piece binary"


def _rows(p: Pieces, held: bool) -> pa.RecordBatch:
    """What is done (dealt evenly by ``to``, no piece) and, with ``held``, the pieces."""
    rows = [(int.from_bytes(t[:7], "little") ^ a, 0, 0, t, a, z, False, later, None) for t, a, z, later in p.done]
    if held:
        rows += [(k, k, o, t, a, n, met, False, piece) for (k, n, piece), ((o, t, a), met) in p.held.items()]
        p.held, p.size = {}, 0
    p.done = []
    cols = list(zip(*rows)) if rows else [()] * 9
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in ROW.split(", ")])


def repeated_ranges(named: DataFrame, length: int | None = LENGTH, once: int | None = None, gram: int = GRAM, hot: int = HOT_PIECES) -> DataFrame:
    """named: t (binary digest of the text), row (with text and doc_id). Returns t and the byte ranges to remove, merged per
    piece: ``ranges`` of strings of ``length`` bytes, ``later`` of those of ``once`` bytes that also come earlier."""
    spark = ship(named.sparkSession)
    base, most = min(x for x in (length, once) if x), max(length or 0, once or 0)
    long = named.select("t", F.col("row.text").alias("text"), F.col("row.doc_id").alias("doc_id")).filter(F.octet_length("text") >= base)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            ts, ks, fs, ns, os = [], [], [], [], []
            for t, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if raw is None or len(raw) < base or t in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(t)
                key, first, count, own = runs(raw, base, gram)
                ts += [t] * len(key)
                ks.append(key)
                fs.append(first)
                ns.append(count)
                os.append(own)
            flat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays([pa.array(ts, pa.binary()), pa.array(_signed(flat(ks, np.uint64))), pa.array(flat(fs, np.int64)), pa.array(flat(ns, np.int64)), pa.array(flat(os, bool))], names=["t", "key", "first", "n", "own"])

    found = long.select("t", "text").mapInArrow(lean(find), "t binary, key long, first long, n long, own boolean")
    # Grouped sides are cut off before their joins: then both sides are shuffled, and hot keys can be split among tasks.
    short = F.xxhash64("t")
    often = cut(found.groupBy("key").agg(F.min(short).alias("a"), F.max(short).alias("z"), F.max("own").alias("own"), F.count("*").alias("c")).filter("own or a <> z").select("key", "c"))
    runs_of = found.join(often, "key").groupBy("t").agg(F.collect_set(F.struct("first", "n", "key", "c")).alias("runs"))
    least = long.groupBy("t").agg(F.min(_rank()).alias("o")) if once else None
    wanted = cut(runs_of.join(least, "t") if once else runs_of.withColumn("o", F.lit(0).cast("long")))
    # One copy of each text is cut into pieces; which copy does not matter.
    rich = named.join(wanted, "t").select("t", "row", "runs", "o")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held = Pieces(length, once)
        for b in batches:
            for t, raw, own, o in zip(b.column(0).to_pylist(), _texts(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if t in seen:
                    continue
                seen.add(t)
                for r in own:
                    f, n = r["first"], r["n"]
                    if r["c"] > hot:
                        cuts = _split_hot(raw, f, n, base, gram, SLOT if r["c"] <= 100 * hot else 1)
                    else:
                        cuts = [(r["key"] & (1 << 64) - 1, f, n)]
                    for k, a, m in cuts:
                        held.add(k - (1 << 64) if k >> 63 else k, (o, t, a), m, raw[a : a + m + most - 1], False)
                        if held.size > HELD:
                            yield _rows(held, held=True)
        yield _rows(held, held=True)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = Pieces(length, once), None
        for b in batches:
            for _, k, o, t, a, n, met, later, p in zip(*(c.to_pylist() for c in b.columns)):
                if p is None:
                    held.done.append((t, a, n, later))
                    continue
                if k != last and held.size > BUFFER:
                    held.solve()
                last = k
                held.add(k, (o, t, a), n, p, met)
            yield ranges_of(held)
        held.solve()
        yield ranges_of(held)

    def ranges_of(held: Pieces) -> pa.RecordBatch:
        t, x, y, later = zip(*held.done) if held.done else ([],) * 4
        held.done = []
        return pa.RecordBatch.from_arrays([pa.array(t, pa.binary()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(later, pa.bool_())], names=["t", "a", "z", "later"])

    met = rich.mapInArrow(lean(cut_up), ROW).repartition(partitions(spark), "to").sortWithinPartitions("route", "a", "t")
    hits = met.mapInArrow(lean(solve), "t binary, a long, z long, later boolean")
    of = lambda c: F.sort_array(F.collect_set(F.when(c, F.struct("a", "z"))))
    return hits.groupBy("t").agg(of(~F.col("later")).alias("ranges"), of(F.col("later")).alias("later"))


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            if z > out[-1][1]:
                out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out


def _rank() -> F.Column:
    """Documents without an id come last."""
    return F.coalesce("doc_id", F.lit((1 << 63) - 1))


def _texts(rows: pa.StructArray) -> list[bytes]:
    return rows.field("text").cast(pa.binary()).to_pylist()


def _joined(docs: DataFrame, length: int | None, once: int | None, gram: int, *carried: str) -> DataFrame:
    """row (doc_id, carried columns and text), ranges and later (see repeated_ranges), and for texts that occur twice
    or more as a whole: least, the least rank of their rows.

    Whole rows travel once: the texts are cut up and put together again after one and the same exchange.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), *carried, text.alias("text"))
    named = docs.select(F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("t"), row.alias("row"))
    ranges = repeated_ranges(named, length, once, gram)
    base = min(x for x in (length, once) if x)
    ids = named.select("t", F.col("row.doc_id").alias("doc_id"), F.octet_length("row.text").alias("size")).filter(F.col("size") >= base)
    twice = ids.groupBy("t").agg(F.count("*").alias("c"), F.min(_rank()).alias("least")).filter("c > 1").select("t", "least")
    known = twice.join(ranges, "t", "full").withColumnRenamed("t", "k")
    return named.join(known, F.col("t") == F.col("k"), "left").select("row", "ranges", "later", "least")


def _spans(rows: pa.StructArray, raw: list[bytes], given: list, least: list, size: int | None, stays: bool) -> list[list[tuple[int, int]]]:
    """Per row the byte spans to remove."""
    if not size:
        return [[] for _ in raw]
    none = (1 << 63) - 1
    ids = rows.field("doc_id").to_pylist()
    whole = [x is not None and len(r) >= size and (not stays or (none if i is None else i) > x) for x, r, i in zip(least, raw, ids)]
    return [[(0, len(r))] if w else merge([(x["a"], x["z"]) for x in g or ()]) for w, r, g in zip(whole, raw, given)]


def _left(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, z in gone:
        parts.append(raw[at:a])
        at = z
    parts.append(raw[at:])
    return b"".join(parts)


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, once: int | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, spans, kept (the remaining bytes), all by ``length``.

    n_later is the number of bytes in strings of ``once`` bytes that also come earlier, 0 if that is not given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        total = lambda spans: pa.array([sum(z - a for a, z in s) for s in spans], pa.int64())
        for b in batches:
            raw, least = _texts(b.column(0)), b.column(3).to_pylist()
            spans = _spans(b.column(0), raw, b.column(1).to_pylist(), least, length, False)
            later = _spans(b.column(0), raw, b.column(2).to_pylist(), least, once, True)
            lists = pa.array([[{"start": a, "end": z} for a, z in s] for s in spans], kind)
            kept = pa.array([_left(r, s) for r, s in zip(raw, spans)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).field("doc_id"), pa.array([len(x) for x in raw], pa.int64()), total(spans), pa.array([len(s) for s in spans], pa.int64()), lists, kept, total(later)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "n_later"])

    return _joined(docs, length, once, gram).mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary, n_later long")


def cut_text(docs: DataFrame, once: int, gram: int = GRAM) -> DataFrame:
    """doc_id, text, lang, source, n_chars and was_cut: strings of ``once`` bytes stay where they come first and are cut
    out elsewhere, with characters cut in half; n_chars is counted anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(0)
            raw = _texts(rows)
            gone = _spans(rows, raw, b.column(2).to_pylist(), b.column(3).to_pylist(), once, True)
            left = [_left(r, s).decode("utf-8", "ignore") for r, s in zip(raw, gone)]
            yield pa.RecordBatch.from_arrays([rows.field("doc_id"), pa.array(left, pa.string()), rows.field("lang"), rows.field("source"), pa.array([len(x) for x in left], pa.int64()), pa.array([bool(s) for s in gone], pa.bool_())], names=["doc_id", "text", "lang", "source", "n_chars", "was_cut"])

    return _joined(docs, None, once, gram, "lang", "source").mapInArrow(lean(run), "doc_id long, text string, lang string, source string, n_chars long, was_cut boolean")
