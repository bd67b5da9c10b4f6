"""Token shards as wavelet matrices: one compressed file per shard with rank and select.

A shard holds the ids of consecutive documents. Its file keeps, per bit of an id (highest first),
a plane of bits in the order that stable partitioning by the bits above gives. Planes are cut in
blocks, each compressed alone, with the count of ones before each block; so ``access``, ``count``
and ``occurrence`` read a few blocks of a few planes, while ``decode`` rebuilds all ids by undoing
the partitions from the lowest plane up.

Cases. Null or empty text: only the end id. Null doc_id: sorts first. Repeated ids: kept, ordered
by text. Empty table: no files, no rows. A task that is run again writes the same bytes to a
temporary name and renames it, so a lost executor leaves nothing half-written. Other columns of
the input are not read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.workers import lean
from keelson.session import cut, fresh_folder, partitions, ship

MAGIC = b"KWM1"
LEVELS = 16
BLOCK = 1 << 13  # bytes of a plane in a block
SHARD_TOKENS = 1 << 21


def _packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(a).tobytes())


def build(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray, levels: int = LEVELS) -> bytes:
    """The bytes of a shard's file. starts: first position of each document, and the total."""
    squeeze = zstandard.ZstdCompressor(level=1)
    present = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    body: list[bytes] = []
    at = 0

    def put(data: bytes) -> tuple[int, int]:
        nonlocal at
        body.append(data)
        at += len(data)
        return at - len(data), len(data)

    meta: dict = {"n": int(len(ids)), "levels": levels, "docs": len(doc_ids), "zeros": [], "planes": []}
    meta["present"] = put(_packed(present))
    meta["doc_ids"] = put(_packed(np.diff(np.array([d or 0 for d in doc_ids], dtype="<i8"), prepend=0)))
    meta["starts"] = put(_packed(np.diff(starts.astype("<i8"), prepend=0)))
    now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    for level in range(levels - 1, -1, -1):
        ones = (now & now.dtype.type(1 << level)) != 0
        bits = np.packbits(ones)
        counts = np.bitwise_count(np.pad(bits, (0, -len(bits) % BLOCK))).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        before = np.concatenate([[0], np.cumsum(counts)])
        blocks = [put(squeeze.compress(bits[i : i + BLOCK].tobytes())) for i in range(0, len(bits), BLOCK)]
        meta["planes"].append({"before": put(_packed(before.astype("<i8"))), "blocks": put(_packed(np.array(blocks, dtype="<i8").reshape(-1, 2)))})
        zeros = np.compress(~ones, now)
        meta["zeros"].append(len(zeros))
        now = np.concatenate([zeros, np.compress(ones, now)])
    head = zstandard.ZstdCompressor(level=3).compress(json.dumps(meta).encode())
    return MAGIC + struct.pack("<Q", len(head)) + head + b"".join(body)


class Shard:
    """Reads a shard's file through ``read(offset, length)``."""

    def __init__(self, read: Callable[[int, int], bytes]):
        first = read(0, 12)
        if first[:4] != MAGIC:
            raise ValueError("not a token shard")
        size = struct.unpack("<Q", first[4:])[0]
        self._loose = zstandard.ZstdDecompressor()
        self._read, self._base = read, 12 + size
        self.meta = json.loads(self._loose.decompress(read(12, size)))
        self.n, self.levels = self.meta["n"], self.meta["levels"]
        self._tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._blocks: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def of(cls, data: bytes) -> "Shard":
        return cls(lambda at, n: data[at : at + n])

    def _section(self, where, kind) -> np.ndarray:
        return np.frombuffer(self._loose.decompress(self._read(self._base + where[0], where[1])), dtype=kind)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        present = self._section(self.meta["present"], np.uint8)
        ids = np.cumsum(self._section(self.meta["doc_ids"], "<i8"))
        return [int(d) if p else None for d, p in zip(ids, present)], np.cumsum(self._section(self.meta["starts"], "<i8"))

    def _table(self, k: int):
        if k not in self._tables:
            p = self.meta["planes"][k]
            self._tables[k] = self._section(p["before"], "<i8"), self._section(p["blocks"], "<i8").reshape(-1, 2)
        return self._tables[k]

    def _block(self, k: int, b: int) -> np.ndarray:
        if (k, b) not in self._blocks:
            if len(self._blocks) > 256:
                self._blocks.clear()
            at, n = self._table(k)[1][b]
            raw = self._loose.decompress(self._read(self._base + int(at), int(n)))
            self._blocks[k, b] = np.unpackbits(np.frombuffer(raw, dtype=np.uint8))
        return self._blocks[k, b]

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        b, rest = divmod(i, BLOCK * 8)
        return int(self._table(k)[0][b]) + (int(self._block(k, b)[:rest].sum()) if rest else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.levels):
            bit = int(self._block(k, i // (BLOCK * 8))[i % (BLOCK * 8)])
            ones = self._ones(k, i)
            i = self.meta["zeros"][k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.levels):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.meta["zeros"][k] + a, self.meta["zeros"][k] + b) if token >> (self.levels - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often ``token`` occurs at positions lo to hi - 1."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, k: int, bit: int, nth: int) -> int:
        before, blocks = self._table(k)
        if bit:
            b = int(np.searchsorted(before, nth, side="right")) - 1
            rest = nth - int(before[b])
        else:
            zeros = np.minimum(np.arange(len(before)) * BLOCK * 8, self.n) - before
            b = int(np.searchsorted(zeros, nth, side="right")) - 1
            rest = nth - int(zeros[b])
        return b * BLOCK * 8 + int(np.flatnonzero(self._block(k, b) == bit)[rest])

    def occurrence(self, token: int, nth: int) -> int | None:
        """Position of the nth occurrence (from 0), or None."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= nth < hi - lo:
            return None
        i = lo + nth
        for k in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - k) & 1
            i = self._select(k, bit, i - self.meta["zeros"][k] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids in order."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        value = np.zeros(self.n, dtype=kind)
        for k in range(self.levels - 1, -1, -1):
            raw = b"".join(self._loose.decompress(self._read(self._base + int(a), int(n))) for a, n in self._table(k)[1])
            ones = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=self.n).astype(bool) if self.n else np.zeros(0, bool)
            z, back = self.meta["zeros"][k], np.empty(self.n, dtype=kind)
            back[np.flatnonzero(~ones)] = value[:z]
            back[np.flatnonzero(ones)] = value[z:] | kind(1 << (self.levels - 1 - k))
            value = back
        return value


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def read_file(uri: str) -> bytes:
    where, path = _filesystem(uri)
    with where.open_input_file(path) as f:
        return f.read()


def write_shards(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes and writes all of ``docs`` in ascending doc_id; returns the manifest, one row per file:
    path, part, shard, n_docs, n_tokens, n_bytes, start (ids in all files before)."""
    from keelson.llm.bpe import coder, default_path

    spark = ship(docs.sparkSession)
    folder, vocabulary = folder or fresh_folder(spark, "token-shards"), vocabulary or default_path()
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = named.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, code, stop = TaskContext.get().partitionId(), coder(vocabulary), np.array([end], dtype="<u2")
        where, top = _filesystem(folder)
        where.create_dir(top, recursive=True)
        ids, parts, size, k = [], [], 0, 0

        def written() -> pa.RecordBatch:
            nonlocal ids, parts, size, k
            starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
            data = build(ids, starts, np.concatenate([x for p in parts for x in (p, stop)]))
            name = f"shard-{part:06d}-{k:05d}.kwm"
            own = f"{top}/.{name}.{uuid.uuid4().hex}"
            with where.open_output_stream(own) as f:
                f.write(data)
            where.move(own, f"{top}/{name}")
            row = [f"{folder.rstrip('/')}/{name}"], [part], [k], [len(ids)], [int(starts[-1])], [len(data)]
            ids, parts, size, k = [], [], 0, k + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.string(), *[pa.int64()] * 5))], names=["path", "part", "shard", "n_docs", "n_tokens", "n_bytes"])

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), code.encode(b.column(1).cast(pa.binary()).to_pylist())):
                ids.append(d)
                parts.append(x)
                size += len(x) + 1
                if size >= shard_tokens:
                    yield written()
        if ids:
            yield written()

    files = cut(ordered.mapInArrow(lean(run), "path string, part long, shard long, n_docs long, n_tokens long, n_bytes long"))
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = totals.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    return files.withColumn("inside", inside).join(before, "part").select("path", "part", "shard", "n_docs", "n_tokens", "n_bytes", (F.col("before") + F.col("inside")).alias("start"))


def read_shards(manifest: DataFrame, emit: str = "digest") -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and ids_crc32, or with emit="ids" its ids."""
    spark = ship(manifest.sparkSession)
    manifest = cut(manifest)
    spread = manifest.select("path", "start").repartition(max(1, min(partitions(spark) * 8, manifest.count())))
    last = ("ids", "array<int>", pa.list_(pa.int32())) if emit == "ids" else ("ids_crc32", "long", pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = Shard.of(read_file(path))
                docs, starts = shard.documents()
                flat = shard.decode().astype("<u4")
                view = memoryview(flat).cast("B")
                edges = starts.tolist()
                if emit == "ids":
                    values = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat.astype(np.int32)))
                else:
                    values = pa.array([zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(edges, edges[1:])], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), values], names=["doc_id", "start", "n_tokens", last[0]])

    return spread.mapInArrow(lean(run), f"doc_id long, start long, n_tokens long, {last[0]} {last[1]}")
