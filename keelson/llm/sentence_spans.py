"""Sliding sentence spans: every run of ``run_length`` consecutive sentences is hashed, spans with
one hash meet in a global join, and each sentence that lies in a span other than its first
occurrence is removed.

A sentence ends after . ! or ? before white space, or at a line end; white space around and
between its words and the case of A-Z do not count. A sentence of ``min_words`` words or more also is a span by
itself, so that a passage cut at both ends is found too; runs of such sentences alone are not hashed, as
their sentences cover them: where a run repeats, each of them does, and no earlier than in the run. For the same reason
no longer runs are hashed. Short stock phrases go only where a whole run of them repeats. First is the occurrence with the smallest (doc_id, digest of the text, position).

Cases. Null or empty text: no sentences, nothing removed, text kept as it is. Fewer sentences than a run, none of them long: kept. Null
doc_id: comes before all others. A document is a doc_id (or none) and the 64-bit digest of a text: rows equal in
both are one and are both kept or cut alike, rows that share only an id are apart. Ties cannot arise. Empty table: no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.workers import lean
from keelson.session import cut, ship

RUN = 2
MIN_WORDS = 12
ALONE = MIN_WORDS  # a sentence of so many words is a span by itself
_ENDS = re.compile(rb"(?<=[.!?])[ \t\r\x0b\x0c]+|[ \t\r\x0b\x0c]*\n\s*")


def sentences(text: bytes) -> list[tuple[int, int]]:
    """(start, end) of the sentences with a word; each reaches to the start of the next separator."""
    out, at = [], 0
    for m in _ENDS.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return [(a, z) for a, z in out if text[a:z].strip()]


def spans(text: bytes, run_length: int = RUN, alone: int = ALONE) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Number of sentences, and (hash high, hash low, first sentence, sentences) of every long sentence and every other run."""
    words = [text[a:z].lower().split() for a, z in sentences(text)]
    n = len(words)
    joined, sizes = [b" ".join(w) for w in words], [len(w) for w in words]
    out = []

    def add(i: int, j: int) -> None:
        d = xxhash.xxh3_128_digest(b"\n".join(joined[i:j]))
        out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), i, j - i))

    for i in range(n):
        if sizes[i] >= alone:
            add(i, i + 1)
        if i + run_length <= n and min(sizes[i : i + run_length]) < alone:
            add(i, i + run_length)
    return n, out


def cut_sentences(text: str | None, removed: list[int]) -> tuple[str | None, int, int]:
    """The text without the sentences, the number of all its sentences, and the words removed."""
    if not text:
        return text, 0, 0
    raw = text.encode()
    found = sentences(raw)
    if not removed:
        return text, len(found), 0
    gone, parts, at, words = set(removed), [], 0, 0
    for i, (a, z) in enumerate(found):
        if i in gone:
            words += len(raw[a:z].split())
            parts.append(raw[at:a])
            at = found[i + 1][0] if i + 1 < len(found) else len(raw)
    parts.append(raw[at:])
    return b"".join(parts).decode(), len(found), words


def _id() -> F.Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def _digest() -> F.Column:
    return F.xxhash64(F.col("text").cast("string"))


def repeated_sentences(docs: DataFrame, run_length: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc (null as the least long), digest of the text, and the sorted positions of its sentences in non-first repeated spans."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, own, high, low, first, size = [], [], [], [], [], []
            for d, g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                for h, k, i, n in spans(t, run_length, min_words)[1] if t else ():
                    ids.append(d)
                    own.append(g)
                    high.append(h)
                    low.append(k)
                    first.append(i)
                    size.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(first, pa.int32()), pa.array(size, pa.int32())], names=["doc", "digest", "h1", "h2", "first", "size"])

    found = docs.select(_id().alias("doc"), _digest().alias("digest"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc long, digest long, h1 long, h2 long, first int, size int")
    # Partial counts and minima leave each task as one row per hash, however often it occurs there.
    place = F.struct("doc", "digest", "first")
    # It is cut off, so that the join shuffles both its sides and a hot hash can be split among tasks.
    repeated = cut(found.groupBy("h1", "h2").agg(F.min(place).alias("least"), F.max(place).alias("most")).filter("least < most").select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "least"))
    later = found.join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))).filter(place > F.col("least"))
    gone = later.select("doc", "digest", F.explode(F.sequence("first", F.col("first") + F.col("size") - 1)).alias("at"))
    return gone.groupBy("doc", "digest").agg(F.array_sort(F.collect_set("at")).alias("removed"))


def drop_repeated_spans(docs: DataFrame, run_length: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_sentences, n_removed, words_removed, removed (positions), and the cut text."""
    gone = repeated_sentences(docs, run_length, min_words)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = named.join(gone, (_id() == F.col("doc")) & (_digest() == F.col("digest")), "left").select("doc_id", "text", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed = b.column(2).to_pylist()
            got = [cut_sentences(t, r) for t, r in zip(b.column(1).to_pylist(), removed)]
            text, n, words = zip(*got) if got else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([len(r) for r in removed], pa.int64()), pa.array(words, pa.int64()), b.column(2), pa.array(text, pa.string())], names=["doc_id", "n_sentences", "n_removed", "words_removed", "removed", "text"])

    return joined.mapInArrow(lean(run), "doc_id long, n_sentences long, n_removed long, words_removed long, removed array<int>, text string")
