"""Order-preserving packing by dynamic programming.

The token stream of a partition, in the order in which its documents are read, is cut into windows
of at most ``width`` ids. Cuts may lie at document ends (free), at sentence ends, or, for long
sentences and at the very end, inside a sentence (dearer). best[j], the least padding plus cut
penalties up to boundary j, is the minimum over boundaries i within ``width`` before j of
best[i] + (width - (pos[j] - pos[i])) + penalty[j]. As best[i] + pos[i] does not depend on j, a
monotone queue gives each minimum in constant time. A window whose length is a power of two is not
padded, so boundaries at exactly such distances are looked up besides (at a small cost, as they make
more windows). Streams are planned in
blocks of bounded size; the last windows of a block are planned again with the next block.

No shuffle: every partition packs what it reads, and a task that is run again reads the same rows.
Cases. Null or empty text: the end id alone. Null doc_id: packed like any. Repeated rows: each is
packed. Empty table: no rows. Very long texts: cut over as many windows as they need.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.workers import lean
from keelson.session import ship

WIDTH = 2048
SENTENCE_CUT = 4
INNER_CUT = 16
SHORT_WINDOW = 200
LONGEST_UNCUT = 64
BLOCK_TOKENS = 1 << 21
AGAIN_WINDOWS = 2


def choose_cuts(pos: np.ndarray, penalty: np.ndarray, width: int = WIDTH) -> list[int]:
    """Indexes into ``pos`` of the best chain of cuts from pos[0] to pos[-1]; gaps must not exceed width."""
    n = len(pos)
    if n < 2:
        return [0]
    pairs_j, pairs_i = [], []
    p = 1
    while p < width:
        i = np.searchsorted(pos, pos - p)
        ok = (pos >= pos[0] + p) & (pos[np.minimum(i, n - 1)] == pos - p)
        pairs_j.append(np.flatnonzero(ok))
        pairs_i.append(i[ok])
        p *= 2
    js, ys = np.concatenate(pairs_j), np.concatenate(pairs_i)
    order = np.argsort(js, kind="stable")
    exact_j, exact_i = [*js[order].tolist(), n], ys[order].tolist()
    at, cost = pos.tolist(), penalty.tolist()
    best, came = [0] * n, [0] * n
    key = [0] * n
    key[0] = at[0]
    queue, head, e = [0], 0, 0
    for j in range(1, n):
        here = at[j]
        far = here - width
        while at[queue[head]] < far:
            head += 1
        i = queue[head]
        least = key[i] + width - here
        while exact_j[e] == j:
            if best[exact_i[e]] + SHORT_WINDOW < least:
                i = exact_i[e]
                least = best[i] + SHORT_WINDOW
            e += 1
        least += cost[j]
        best[j], came[j] = least, i
        k = least + here
        key[j] = k
        while len(queue) > head and key[queue[-1]] > k:
            queue.pop()
        queue.append(j)
    chain, j = [n - 1], n - 1
    while j:
        j = came[j]
        chain.append(j)
    return chain[::-1]


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, final: bool, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Candidate cut positions and their penalties."""
    total = len(ids)
    ends = np.flatnonzero(sentence_end[ids]) + 1
    pos = np.union1d(np.union1d(ends, doc_ends), [0, total])
    gaps = np.diff(pos)
    step = min(LONGEST_UNCUT, width)
    wide = np.flatnonzero(gaps > step)
    more = [np.arange(pos[i] + step, pos[i + 1], step) for i in wide]
    if final:
        more.append(np.arange(max(0, total - width), total))
    pos = np.union1d(pos, np.concatenate(more)) if more else pos
    penalty = np.full(len(pos), INNER_CUT, dtype=np.int64)
    penalty[np.isin(pos, ends, assume_unique=True)] = SENTENCE_CUT
    penalty[np.isin(pos, doc_ends)] = 0
    penalty[[0, -1]] = 0
    return pos, penalty


class Packer:
    """Takes documents in order, gives finished windows' pieces: (doc index, start, length, window, offset, ids)."""

    def __init__(self, sentence_end: np.ndarray, width: int = WIDTH, block: int = BLOCK_TOKENS):
        self.sentence_end, self.width, self.block = sentence_end, width, block
        self.docs: list[tuple[int, int, int]] = []  # index, ids already packed, ids in all
        self.parts: list[np.ndarray] = []
        self.size = self.windows = 0

    def add(self, index: int, ids: np.ndarray):
        self.docs.append((index, 0, len(ids)))
        self.parts.append(ids)
        self.size += len(ids)
        return self.flush(False) if self.size >= self.block else ()

    def flush(self, final: bool):
        if not self.size:
            return []
        ids = np.concatenate(self.parts)
        lengths = np.array([len(p) for p in self.parts], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        pos, penalty = boundaries(ids, starts[1:], self.sentence_end, final, self.width)
        cuts = pos[choose_cuts(pos, penalty, self.width)]
        if not final and len(cuts) > AGAIN_WINDOWS + 1:
            cuts = cuts[:-AGAIN_WINDOWS]
        done = int(cuts[-1])
        edges = np.union1d(cuts, starts[starts <= done])
        firsts, sizes = edges[:-1], np.diff(edges)
        window = np.searchsorted(cuts, firsts, side="right") - 1
        doc = np.searchsorted(starts, firsts, side="right") - 1
        wide = ids.astype("<u4")
        out = [
            (*self.docs[d][::2], self.docs[d][1] + f - int(starts[d]), n, self.windows + w, f - int(cuts[w]), wide[f : f + n])
            for f, n, w, d in zip(firsts.tolist(), sizes.tolist(), window.tolist(), doc.tolist())
        ]
        self.windows += len(cuts) - 1
        left = int(np.searchsorted(starts, done, side="right")) - 1
        if left < len(self.docs):
            index, packed, total = self.docs[left]
            inside = done - int(starts[left])
            self.docs = [(index, packed + inside, total), *self.docs[left + 1 :]]
            self.parts = [ids[done : starts[left + 1]], *self.parts[left + 1 :]]
        else:
            self.docs, self.parts = [], []
        self.size = len(ids) - done
        return out


def sentence_ends(path: str) -> np.ndarray:
    """Per id: does its text end a sentence or a line?"""
    from keelson.llm.bpe import coder

    t = coder(path).tokenizer
    texts = [t.decode([i], skip_special_tokens=False) for i in range(t.get_vocab_size())]
    return np.array([x.rstrip(" \"')]").endswith((".", "!", "?")) or "\n" in x for x in texts] + [False] * (65_536 - len(texts)))


def pack(docs: DataFrame, vocabulary: str | None = None, end: int = 1, width: int = WIDTH, emit: str = "ids") -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, and its ids (emit="ids")
    or ids_crc32 (emit="digest")."""
    from keelson.llm.bpe import coder, default_path

    ship(docs.sparkSession)
    vocabulary = vocabulary or default_path()
    last = ("ids", "array<int>") if emit == "ids" else ("ids_crc32", "long")

    def rows(keys: list, pieces: list, part: int) -> pa.RecordBatch:
        if emit == "ids":
            values = pa.array([p[6].astype(np.int32) for p in pieces], pa.list_(pa.int32()))
        else:
            values = pa.array([zlib.crc32(p[6]) for p in pieces], pa.int64())
        columns = [pa.array([keys[p[0]] for p in pieces], pa.int64())]
        columns += [pa.array([p[k] for p in pieces], pa.int64()) for k in (2, 3, 1)]
        columns += [pa.array([(part << 32) + p[4] for p in pieces], pa.int64()), pa.array([p[5] for p in pieces], pa.int64()), values]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", last[0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, code, stop = TaskContext.get().partitionId(), coder(vocabulary), np.array([end], dtype="<u2")
        packer, keys = None, {}
        n = 0
        for b in batches:
            packer = packer or Packer(sentence_ends(vocabulary), width)
            for d, x in zip(b.column(0).to_pylist(), code.encode(b.column(1).cast(pa.binary()).to_pylist())):
                keys[n] = d
                if pieces := packer.add(n, np.concatenate([x, stop])):
                    yield rows(keys, pieces, part)
                    keys = {i: keys[i] for i, _, _ in packer.docs}
                n += 1
        if packer and (pieces := packer.flush(True)):
            yield rows(keys, pieces, part)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(lean(run), f"doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, {last[0]} {last[1]}")
