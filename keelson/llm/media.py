"""Media columns: signature sniffing.

One Aho-Corasick pass over a blob finds every magic number of every known format. A validator
per format then walks the structure from each hit and returns the exact length, or nothing when
chunks, checksums or lengths do not add up. A confirmed hit at byte 0 that spans the blob corrects
the declared type; confirmed hits elsewhere, not inside an earlier confirmed one, are carved out.

Cases. Null blob: treated as empty. Empty or unknown blob: type application/octet-stream, nothing
carved. Truncated media: not confirmed. Equal blobs give equal rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.workers import lean
from keelson.session import ship

UNKNOWN = "application/octet-stream"
BLOCK = 576
RATE = 8000


def _png(b: memoryview, at: int) -> int | None:
    i, n = at + 8, len(b)
    while i + 12 <= n:
        size = int.from_bytes(b[i : i + 4], "big")
        end = i + 12 + size
        if end > n or zlib.crc32(b[i + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None
        kind = bytes(b[i + 4 : i + 8])
        if i == at + 8 and (kind != b"IHDR" or size != 13):
            return None
        if kind == b"IEND":
            return end - at
        i = end
    return None


def _gif(b: memoryview, at: int) -> int | None:
    n = len(b)
    if at + 13 > n:
        return None
    flags = b[at + 10]
    i = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def blocks(i: int) -> int | None:
        while i < n:
            if b[i] == 0:
                return i + 1
            i += 1 + b[i]
        return None

    while i is not None and i < n:
        kind = b[i]
        if kind == 0x3B:
            return i + 1 - at
        if kind == 0x21 and i + 2 < n:
            i = blocks(i + 2)
        elif kind == 0x2C and i + 10 < n:
            local = b[i + 9]
            i = blocks(i + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
        else:
            return None
    return None


def _riff(b: memoryview, at: int) -> tuple[str, int] | None:
    if at + 12 > len(b):
        return None
    kind, size = bytes(b[at + 8 : at + 12]), int.from_bytes(b[at + 4 : at + 8], "little")
    end = at + 8 + size
    name = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(kind)
    if name is None or end > len(b) or size < 4:
        return None
    i, seen = at + 12, []
    while i < end:
        if i + 8 > end:
            return None
        part = int.from_bytes(b[i + 4 : i + 8], "little")
        seen.append(bytes(b[i : i + 4]))
        i += 8 + part + (part & 1)
    if i != end or (kind == b"WAVE" and seen[:1] != [b"fmt "]) or (kind == b"WAVE" and b"data" not in seen):
        return None
    return name, end - at


def _jpeg(b: memoryview, at: int) -> int | None:
    i, n, scan = at + 2, len(b), False
    while i + 4 <= n or (i + 2 <= n and b[i + 1] == 0xD9):
        if b[i] != 0xFF:
            return None
        kind = b[i + 1]
        if kind == 0xD9:
            return i + 2 - at if scan else None
        if kind == 0xFF:
            i += 1
            continue
        size = int.from_bytes(b[i + 2 : i + 4], "big")
        if size < 2:
            return None
        i += 2 + size
        if kind == 0xDA:
            scan = True
            while i + 1 < n and not (b[i] == 0xFF and b[i + 1] != 0 and not 0xD0 <= b[i + 1] <= 0xD7):
                i += 1
    return None


def _bmp(b: memoryview, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, zero, data, head = struct.unpack_from("<IIII", b, at + 2)
    wide, high, planes, depth = struct.unpack_from("<iiHH", b, at + 18)
    if zero or head not in (40, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or wide <= 0 or not high or data < 14 + head:
        return None
    rows = (wide * depth + 31) // 32 * 4 * abs(high)
    return size if data + rows <= size <= len(b) - at else None


_PDF_END = re.compile(rb"startxref[ \t\r\n]+(\d{1,12})[ \t\r\n]+%%EOF")
_PDF_TABLE = re.compile(rb"\s*(?:xref\b|\d+\s+\d+\s+obj\b)")


def _pdf(b: memoryview, at: int) -> int | None:
    """To the first end whose startxref names a table of this file, and on over updates, whose tables follow the end before."""
    raw, end = bytes(b[at:]), 0
    for m in _PDF_END.finditer(raw):
        table = int(m[1])
        if max(end, 1) <= table < m.start() and _PDF_TABLE.match(raw, table):
            end = m.end()
    return end or None


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ (poly if x >> bits - 1 else 0)) & (1 << bits) - 1
        out.append(x)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_FLAC_DEPTH = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _flac_head(b: memoryview, i: int, depth: int) -> tuple[int, int, int, int] | None:
    """Of the frame at i: bytes of its header, samples, channel code and bits of a sample."""
    h = bytes(b[i : i + 16])
    if len(h) < 6 or h[0] != 0xFF or h[1] >> 1 != 0x7C or h[3] & 1:
        return None
    size, rate, channels, bits = h[2] >> 4, h[2] & 15, h[3] >> 4, h[3] >> 1 & 7
    more = 0 if h[4] < 0x80 else 8 - (h[4] ^ 0xFF).bit_length()
    j = 5 + max(0, more - 1)
    if not size or rate == 15 or channels > 10 or bits == 3 or more in (1, 8) or any(x >> 6 != 2 for x in h[5:j]):
        return None
    wide = {6: 1, 7: 2}.get(size, 0)
    samples = int.from_bytes(h[j : j + wide], "big") + 1 if wide else 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8
    j += wide + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for x in h[:j]:
        crc = _CRC8[crc ^ x]
    return (j + 1, samples, channels, _FLAC_DEPTH.get(bits, depth)) if j < len(h) and crc == h[j] else None


def _flac_subframe(s: str, p: int, samples: int, depth: int) -> int | None:
    """Where the subframe at bit p ends; ValueError or IndexError where the bits do not reach."""
    kind, p, wasted = int(s[p : p + 8], 2), p + 8, 0
    if kind & 1:
        q = s.index("1", p)
        wasted, p = q - p + 1, q + 1
    kind, depth = kind >> 1, depth - wasted
    if kind > 63 or depth < 1:
        return None
    if kind < 2:
        return p + depth * (samples if kind else 1)
    order = kind - 8 if 8 <= kind <= 12 else kind - 31 if kind >= 32 else -1
    if not 0 <= order <= samples:
        return None
    p += order * depth
    if kind >= 32:
        p += 9 + order * (int(s[p : p + 4], 2) + 1)
    way, parts = int(s[p : p + 2], 2), int(s[p + 2 : p + 6], 2)
    p += 6
    if way > 1 or samples >> parts << parts != samples or samples >> parts < order:
        return None
    wide = 5 if way else 4
    for k in range(1 << parts):
        n, rice = (samples >> parts) - (0 if k else order), int(s[p : p + wide], 2)
        p += wide
        if rice == (1 << wide) - 1:
            p += 5 + n * int(s[p : p + 5], 2)
            continue
        for _ in range(n):
            p = s.index("1", p) + 1 + rice
    return p


def _flac_frame(b: memoryview, i: int, depth: int) -> tuple[int, int] | None:
    """End of the frame at i and its samples, or nothing where its header, subframes or checksums are wrong."""
    head = _flac_head(b, i, depth)
    if head is None:
        return None
    skip, samples, channels, depth = head
    n = channels + 1 if channels < 8 else 2
    reach = samples * n * (depth + 1) // 8 + 64
    while True:
        part = bytes(b[i + skip : i + skip + reach])
        s, p = format(int.from_bytes(part, "big"), f"0{8 * len(part)}b") if part else "", 0
        try:
            for c in range(n):
                side = channels in (8, 10) and c == 1 or channels == 9 and c == 0
                p = _flac_subframe(s, p, samples, depth + side)
                if p is None:
                    return None
        except (ValueError, IndexError):
            p = len(s) + 1
        end = i + skip + (p + 7) // 8 + 2
        if p <= len(s) and end <= len(b):
            crc = 0
            for x in b[i : end - 2]:
                crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ x]
            return (end, samples) if crc == int.from_bytes(b[end - 2 : end], "big") else None
        if len(part) < reach or p <= len(s):
            return None
        reach *= 2


def _flac(b: memoryview, at: int) -> int | None:
    """Metadata, then frames up to the number of samples announced, or as long as they are right where none is."""
    i, n, first = at + 4, len(b), True
    depth = total = 0
    while i + 4 <= n:
        last, kind, size = b[i] >> 7, b[i] & 127, int.from_bytes(b[i + 1 : i + 4], "big")
        if first and (kind or size != 34) or i + 4 + size > n:
            return None
        if first:
            info = int.from_bytes(b[i + 14 : i + 22], "big")
            depth, total = (info >> 36 & 31) + 1, info & (1 << 36) - 1
        first, i = False, i + 4 + size
        if last:
            done = 0
            while (not total or done < total) and (frame := _flac_frame(b, i, depth)):
                i, done = frame[0], done + frame[1]
            return i - at if done and done >= total else None
    return None


def _gzip(b: memoryview, at: int) -> int | None:
    try:
        d = zlib.decompressobj(31)
        left: bytes | memoryview = b[at:]
        while left and not d.eof:
            d.decompress(left, 1 << 20)
            left = d.unconsumed_tail
        return len(b) - at - len(d.unused_data) if d.eof else None
    except zlib.error:
        return None


def _zip(b: memoryview, at: int) -> int | None:
    raw = bytes(b[at:])
    i = raw.find(b"PK\5\6")
    while i >= 0:
        if i + 22 <= len(raw):
            size, start, note = struct.unpack_from("<IIH", raw, i + 12)
            if start + size == i and i + 22 + note <= len(raw) and raw[start : start + 4] == b"PK\1\2":
                return i + 22 + note
        i = raw.find(b"PK\5\6", i + 1)
    return None


def _typed(name: str, walk):
    return lambda b, at: (name, n) if (n := walk(b, at)) else None


# Published magic numbers.
SIGNATURES = {
    b"\x89PNG\r\n\x1a\n": _typed("image/png", _png),
    b"GIF87a": _typed("image/gif", _gif),
    b"GIF89a": _typed("image/gif", _gif),
    b"RIFF": _riff,
    b"\xff\xd8\xff": _typed("image/jpeg", _jpeg),
    b"BM": _typed("image/bmp", _bmp),
    b"%PDF-": _typed("application/pdf", _pdf),
    b"fLaC": _typed("audio/flac", _flac),
    b"\x1f\x8b\x08": _typed("application/gzip", _gzip),
    b"PK\x03\x04": _typed("application/zip", _zip),
}
_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        a = ahocorasick.Automaton()
        for magic, walk in SIGNATURES.items():
            a.add_word(magic.decode("latin-1"), (len(magic), walk))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def sniff(blob: bytes | None) -> tuple[str, list[tuple[str, int, int]]]:
    """The blob's true type, and (type, start, length) of confirmed media in it, outermost only."""
    blob = blob or b""
    view, found, free = memoryview(blob), [], 0
    for last, (size, walk) in _automaton().iter(blob.decode("latin-1")):
        at = last - size + 1
        if at >= free and (hit := walk(view, at)):
            found.append((hit[0], at, hit[1]))
            free = at + hit[1]
    whole = found[0][0] if found and found[0][1] == 0 and found[0][2] == len(blob) else UNKNOWN
    return whole, found


def sniff_media(df: DataFrame, id_col: str, blob_col: str, declared_col: str) -> DataFrame:
    """id, declared_type, media_type, corrected, and the carved media as an array of (type, start, length, data)."""
    ship(df.sparkSession)
    named = df.select(F.col(id_col).alias("id"), F.col(declared_col).cast("string").alias("declared_type"), F.col(blob_col).cast("binary").alias("__b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("data", pa.binary())]))
        for b in batches:
            types, carved = [], []
            for blob in b.column(2).to_pylist():
                whole, found = sniff(blob)
                types.append(whole)
                carved.append([{"type": t, "start": s, "length": n, "data": blob[s : s + n]} for t, s, n in found if not (s == 0 and n == len(blob))])
            wrong = [d != t for d, t in zip(b.column(1).to_pylist(), types)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(types, pa.string()), pa.array(wrong), pa.array(carved, kind)], names=["id", "declared_type", "media_type", "corrected", "carved"])

    return named.mapInArrow(lean(run), f"id {named.schema['id'].dataType.simpleString()}, declared_type string, media_type string, corrected boolean, carved array<struct<type:string,start:long,length:long,data:binary>>")


def as_wav(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono PCM; lossless."""
    pad = b"\0" * (len(samples) & 1)
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples))
    return b"RIFF" + struct.pack("<I", len(head) + len(samples) + len(pad)) + head + samples + pad


def wav_samples(wav: bytes) -> bytes:
    """The samples of a WAV file's data chunk."""
    i = 12
    while i + 8 <= len(wav):
        size = int.from_bytes(wav[i + 4 : i + 8], "little")
        if wav[i : i + 4] == b"data":
            return wav[i + 8 : i + 8 + size]
        i += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as an 8-bit WAV, padded with bytes 255 to full blocks.

    The declared type is deliberately that of raw bytes; sniffing has to find the true one.
    """
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            media = [as_wav(t + b"\xff" * ((-len(t)) % BLOCK if t else BLOCK)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def read_features(stored: DataFrame) -> DataFrame:
    """Sniffs each stored medium, decodes the samples its validator confirmed, and digests them."""

    def run(batches):
        for b in batches:
            out = []
            for media in b.column(2).to_pylist():
                kind, found = sniff(media)
                samples = wav_samples(media) if kind == "audio/wav" else b""
                x = np.frombuffer(samples, dtype=np.uint8)
                loud = int(np.abs(x.astype(np.int64) - 128).sum()) // max(1, len(x))
                turns = int(((x[1:] ^ x[:-1]) >> 7).sum()) if len(x) else 0
                feature = f"{kind};samples={len(x)};rate={RATE};level={loud};crossings={turns};parts={len(found)}"
                out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, UNKNOWN != kind))
            cols = list(zip(*out)) if out else [()] * 7
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "type_corrected"]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_bytes", *names])

    return stored.mapInArrow(lean(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, type_corrected boolean")
