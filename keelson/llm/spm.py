"""SentencePiece encoding and decoding with n-best segmentations.

All ways to spell a text with the model's pieces form a lattice whose edges carry the pieces'
scores. A forward Viterbi pass gives the best score from the start to every place. A-star search then runs
backward from the end; the Viterbi score of the rest is exact, so complete paths leave the queue
in order of score. Characters without a piece become bytes, at the least score less ten. What the forward pass finds
for a place depends on what is before it alone, so strings in sorted order share it as far as they begin alike.

A lattice falls apart wherever no piece holds the two neighbouring characters, so each part is
searched alone, remembered, and the best sums over parts are merged: of the parts' second choices only the
n - 1 cheapest can take part in the n best.

Cases. Null text: like the empty text, which has one segmentation, of no pieces. Ties in score: by
piece ids, parts from the left. Repeated rows: each encoded. Null doc_id: kept. Empty table: no rows. Very long
texts: time in proportion to their length. Only doc_id and text are read.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.workers import lean
from keelson.session import ship

SPACE = "▁"
BEST = 3
UNKNOWN_PENALTY = 10.0
NEVER = -1e8  # models give such scores to pieces that no merge makes; they are no measure of the rest
_MOST_KEPT = 400_000
_SLOTS, _ENTRIES, _POOL = 1 << 21, 2_000_000, 8_000_000
_KEYS = 3
_KEY_BYTES = 8 * _KEYS  # the last byte of a key holds the length
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_SPACE_BYTES = SPACE.encode()
_LONGEST_KEPT = 48
_RAW = "\0"  # before strings that are taken as they are
_LEAST, _NONE = float("-inf"), float("inf")
_MODELS: dict[tuple[str, int], "Pieces"] = {}


class Pieces:
    """A piece inventory with scores; ``vocabulary`` maps piece to (id, score), ``byte_ids`` byte to id."""

    def __init__(self, vocabulary: dict[str, tuple[int, float]], byte_ids: list[int], best: int = BEST, prefix: bool = True):
        self.vocabulary, self.byte_ids, self.best, self.prefix = vocabulary, byte_ids, best, prefix
        self.unknown = min((s for _, s in vocabulary.values() if s > NEVER), default=0.0) - UNKNOWN_PENALTY
        # Per piece its score, its id in bytes and whether longer pieces end with it; () for mere ends.
        ends = {p[k:] for p in vocabulary for k in range(1, len(p))}
        self.edges = dict.fromkeys(ends, ()) | {p: (s, i.to_bytes(4, "little"), p in ends) for p, (i, s) in vocabulary.items()}
        self.pairs = {p[i : i + 2] for p in vocabulary for i in range(len(p) - 1)}
        # Before a space mark after another character a lattice falls apart, unless some piece spans it.
        self.by_words = not any(p[1] == SPACE and p[0] != SPACE for p in self.pairs)
        self.slots = self.letters = None
        self.words: dict[str, tuple] = {}
        self.parts: dict[str, tuple] = {}
        # The last string searched and, for each of its places, the best score up to there and the edges into it.
        self.last, self.score, self.into = "", [0.0], [[]]
        self.spelling = {i: p.replace(SPACE, " ").encode() for p, (i, _) in vocabulary.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}

    @classmethod
    def load(cls, path: str, best: int = BEST) -> "Pieces":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usual, bytes_of = {}, [0] * 256
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                bytes_of[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                usual[sp.id_to_piece(i)] = (i, sp.get_score(i))
        return cls(usual, bytes_of, best)

    def search(self, s: str) -> list[tuple[float, bytes]]:
        """The ``best`` segmentations of one lattice: (score, ids as 32-bit bytes), best first."""
        n, into, best = len(s), self._forward(s), self.best
        # Of an edge counts what it loses against the best way to its end; a path's losses add up. Every
        # entry of the queue has a completion that loses no more, so entries that lose more than ``best``
        # others known so far are left out.
        queue: list[tuple[float, bytes, int]] = []
        out: list[tuple[float, bytes]] = []
        top, known, worst = self.score[n], [0.0], _NONE if best > 1 else 0.0

        def meet(more: float) -> float:
            known.append(more)
            known.sort()
            del known[best:]
            return known[-1] if len(known) == best else _NONE

        # Nothing comes before the best path while it is the only one that loses nothing.
        ids, j = b"", n
        while j and (len(into[j]) == 1 or into[j][1][0]):
            edges = into[j]
            for more, i, p in edges[1:]:
                if more > worst:
                    break
                worst = meet(more)
                queue.append((more, p + ids, i))
            _, j, p = edges[0]
            ids = p + ids
        queue = [q for q in queue if q[0] <= worst]
        queue.append((0.0, ids, j))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            loss, ids, j = pop(queue)
            if not j:
                out.append((top - loss, ids))
                if len(out) == best:
                    break
                continue
            edges = into[j]
            _, i, p = edges[0]
            push(queue, (loss, p + ids, i))
            for lost, i, p in edges[1:]:
                more = loss + lost
                if more > worst:
                    break
                worst = meet(more)
                push(queue, (more, p + ids, i))
        if n > _LONGEST_KEPT:
            self.last, self.score, self.into = "", [0.0], [[]]
        return out

    def _forward(self, s: str) -> list[list[tuple[float, int, bytes]]]:
        """For each place of a string the edges into it: (loss against the best way there, start, ids), least loss first."""
        get, score, into, k = self.edges.get, self.score, self.into, 0
        for x, y in zip(s, self.last):
            if x != y:
                break
            k += 1
        del score[k + 1 :], into[k + 1 :]
        for j in range(k + 1, len(s) + 1):
            i = j - 1
            sub = s[i]
            p = get(sub)
            if not p:
                deeper = p is not None
                p = (self.unknown, b"".join([self.byte_ids[b].to_bytes(4, "little") for b in sub.replace(SPACE, " ").encode("utf-8", "surrogatepass")]), deeper)
            w, ids, deeper = p
            full = score[i] + w
            ways = [(full, i, ids)]
            while deeper and i:
                i -= 1
                p = get(s[i:j])
                if p:
                    w, ids, deeper = p
                    way = score[i] + w
                    ways.append((way, i, ids))
                    if way > full:
                        full = way
                elif p is None:
                    break
            score.append(full)
            into.append(sorted([(full - way, i, ids) for way, i, ids in ways]) if len(ways) > 1 else [(0.0, i, ids) for _, i, ids in ways])
        self.last = s
        return into

    def _merge(self, choices: list[Sequence[tuple[float, bytes]]]) -> Sequence[tuple[float, bytes]]:
        """The best sums over a few parts in order."""
        now = choices[0]
        for more in choices[1:]:
            if len(more) == 1:
                b, y = more[0]
                now = [(a + b, x + y) for a, x in now]
            elif len(now) == 1:
                a, x = now[0]
                now = [(a + b, x + y) for b, y in more]
            else:
                now = sorted([(-a - b, x + y) for a, x in now for b, y in more])[: self.best]
                now = [(-c, z) for c, z in now]
        return now

    def word(self, w: str) -> tuple:
        """(best ids, best score, loss of the second choice, choices) of a string, part by part."""
        pairs, at, found, known = self.pairs, 0, [], self.parts
        ends = [i for i, p in enumerate(map(add, w, w[1:]), 1) if p not in pairs]
        ends.append(len(w))
        for i in ends:
            p = w[at:i]
            at = i
            got = known.get(p)
            if got is None:
                got = tuple(self.search(p))
                if len(p) <= _LONGEST_KEPT:
                    if len(known) >= _MOST_KEPT:
                        known.clear()
                    known[p] = got
            found.append(got)
        best = self._merge(found) if len(found) > 1 else found[0]
        return best[0][1], best[0][0], best[0][0] - best[1][0] if len(best) > 1 else _NONE, best

    def split(self, text: str) -> list[str]:
        """Strings whose lattices are independent: words without their space mark, or _RAW and the whole string."""
        if not text:
            return []
        if self.prefix and self.by_words and SPACE not in text and _RAW not in text:
            words = text.split(" ")
            if "" not in words:
                return words
        marked = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if not self.by_words:
            return [_RAW + marked]
        found = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked)
        return [_RAW + w for w in found]

    def encode(self, text: str | None) -> list[tuple[float, bytes]]:
        """The n best segmentations of the whole text: (score, ids as 32-bit bytes)."""
        words, known = self.split(text or ""), self.words
        if not words:
            return [(0.0, b"")]
        entries = list(map(known.get, words))
        if None in entries:
            if len(known) >= _MOST_KEPT:
                known.clear()
            for i in [i for i, e in enumerate(entries) if e is None]:
                w = words[i]
                e = known.get(w)
                if e is None:
                    e = self.word(w[1:] if w[0] == _RAW else SPACE + w)
                    if len(w) <= _LONGEST_KEPT:
                        known[w] = e
                entries[i] = e
        ids, scores, losses, _ = zip(*entries)
        total = sum(scores)
        # Of equal losses the leftmost count first.
        weakest: list[int] = []
        if self.best > 1:
            rest = list(losses)
            for _ in range(min(self.best - 1, len(rest))):
                weakest.append(rest.index(min(rest)))
                rest[weakest[-1]] = _NONE
            weakest = sorted({i for i in weakest if losses[i] < _NONE})
        combos = self._combined([(i, entries[i][3]) for i in weakest])
        out = []
        for loss, picks in combos:
            changed = [(i, k) for i, k in picks if k]
            if not changed:
                out.append((total - loss, b"".join(ids)))
                continue
            other = list(ids)
            for i, k in changed:
                other[i] = entries[i][3][k][1]
            out.append((total - loss, b"".join(other)))
        return out

    def _places(self, raw: list[bytes]):
        """Words of all texts at once: their start, size and key, and the first word of each text."""
        data = b" ".join(raw) + bytes(_KEY_BYTES + 8)
        buf = np.frombuffer(data, dtype=np.uint8)
        total = len(data) - _KEY_BYTES - 8
        starts = np.concatenate([[0], np.flatnonzero(buf[:total] == 32) + 1])
        sizes = np.append(starts[1:] - 1, total) - starts
        first = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])[:-1]]))
        view = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        keys = [view[starts + 8 * k] & _MASKS[np.clip(sizes - 8 * k, 0, 8)] for k in range(_KEYS)]
        keys[-1] |= np.minimum(sizes, 255).astype(np.uint64) << np.uint64(56)
        return data, starts, sizes, first, keys

    def encode_batch(self, texts: list[bytes | None]) -> list[list[tuple[float, bytes]]]:
        """encode() of many texts: words are looked up together, in a table that holds their very bytes and
        lengths as integers, so that a hit is exact; the last word met in a slot stays. Nothing here refers to
        itself, while what is remembered is large; so the collector of cycles, which would walk it again and again, waits."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode_batch(texts)
        finally:
            if collects:
                gc.enable()

    def _encode_batch(self, texts: list[bytes | None]) -> list[list[tuple[float, bytes]]]:
        out: list = [None] * len(texts)
        plain = []
        for k, t in enumerate(texts):
            if not t or not self.prefix or not self.by_words or b"  " in t or t[:1] == b" " or t[-1:] == b" " or _SPACE_BYTES in t:
                out[k] = self.encode(t.decode() if t else None)
            else:
                plain.append(k)
        if not plain:
            return out
        if self.slots is None:
            self.slots, self.slot_keys = np.zeros(_SLOTS, dtype=np.int32), np.zeros((_SLOTS, _KEYS), dtype=np.uint64)
            self.entry = {n: np.zeros(_ENTRIES, dtype=d) for n, d in (("place", np.int64), ("count", np.int64), ("score", np.float64), ("loss", np.float64))}
            self.pool, self.used, self.entries = np.zeros(_POOL, dtype=np.uint32), 0, 1
        data, starts, sizes, first, keys = self._places([texts[k] for k in plain])
        h = keys[0] * np.uint64(0x9E3779B97F4A7C15)
        for x in keys[1:]:
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x * np.uint64(0x94D049BB133111EB)
        slot = ((h ^ (h >> np.uint64(32))) & np.uint64(_SLOTS - 1)).astype(np.int64)
        short = sizes < _KEY_BYTES
        hit = short.copy()
        for k in range(_KEYS):
            hit &= self.slot_keys[slot, k] == keys[k]
        which = np.where(hit, self.slots[slot], 0)
        miss = np.flatnonzero(~hit)
        known: dict[bytes, int] = {}
        order = [known.setdefault(data[s : s + n], len(known)) for s, n in zip(starts[miss].tolist(), sizes[miss].tolist())]
        made = {w: self.word(SPACE + w.decode()) for w in sorted(known)}
        fresh = [made[w] for w in known]
        flat = np.frombuffer(b"".join([e[0] for e in fresh]), dtype=np.uint32)
        if self.used + len(flat) > _POOL or self.entries + len(fresh) > _ENTRIES:
            self.slot_keys[:] = 0
            self.used, self.entries = 0, 1
            if len(flat) > _POOL or len(fresh) + 1 > _ENTRIES:
                for k in plain:
                    out[k] = self.encode(texts[k].decode())
                return out
            if hit.any():  # what the table had is gone: begin again with it empty
                for k, got in zip(plain, self._encode_batch([texts[k] for k in plain])):
                    out[k] = got
                return out
        e0, n = self.entries, len(fresh)
        if n:
            count = np.array([len(e[0]) // 4 for e in fresh])
            self.pool[self.used : self.used + len(flat)] = flat
            self.entry["count"][e0 : e0 + n] = count
            self.entry["place"][e0 : e0 + n] = self.used + np.cumsum(count) - count
            self.entry["score"][e0 : e0 + n] = [e[1] for e in fresh]
            self.entry["loss"][e0 : e0 + n] = [e[2] for e in fresh]
            self.used, self.entries = self.used + len(flat), e0 + n
            which[miss] = e0 + np.array(order)
            keep = miss[short[miss]]
            _, last = np.unique(slot[keep][::-1], return_index=True)
            keep = keep[len(keep) - 1 - last]
            for k in range(_KEYS):
                self.slot_keys[slot[keep], k] = keys[k][keep]
            self.slots[slot[keep]] = which[keep]
        count, loss = self.entry["count"][which], self.entry["loss"][which]
        totals = np.add.reduceat(self.entry["score"][which], first).tolist()
        ends = np.cumsum(count)
        ids = self.pool[np.repeat(self.entry["place"][which] - (ends - count), count) + np.arange(int(ends[-1]))].tobytes()
        edge = np.append(first, len(starts)).tolist()
        for k, a, z, total in zip(plain, edge, edge[1:], totals):
            begin = int(ends[a - 1]) if a else 0
            whole = ids[4 * begin : 4 * int(ends[z - 1])]
            rest, weakest = loss[a:z].copy(), []
            for _ in range(min(self.best - 1, z - a)):
                i = int(rest.argmin())
                if rest[i] == _NONE:
                    break
                weakest.append(a + i)
                rest[i] = _NONE
            weakest.sort()
            choices = {i: self.word(SPACE + data[starts[i] : starts[i] + sizes[i]].decode())[3] for i in weakest}
            got = []
            for lost, picks in self._combined([(i, choices[i]) for i in weakest]):
                parts, at = [], 0
                for i, c in picks:
                    if c:
                        here = 4 * (int(ends[i] - count[i]) - begin)
                        parts += [whole[at:here], choices[i][c][1]]
                        at = here + 4 * int(count[i])
                got.append((total - lost, b"".join([*parts, whole[at:]]) if parts else whole))
            out[k] = got
        return out

    def _combined(self, weakest: list[tuple[int, list]]) -> list[tuple[float, tuple]]:
        """The ``best`` cheapest (loss, ((word, choice), ...)) over the words that lose least by another choice."""
        combos: list[tuple[float, tuple]] = [(0.0, ())]
        for i, choices in weakest:
            top = choices[0][0]
            combos = sorted([(c + top - s, p + ((i, k),)) for c, p in combos for k, (s, _) in enumerate(choices)])[: self.best]
        return combos

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.spelling.__getitem__, array("I", ids)))
        if self.prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")

    def decode_batch(self, many: list[bytes]) -> list[bytes]:
        """decode() of many id strings, as UTF-8."""
        if self.letters is None:
            top = max(self.spelling, default=0) + 1
            size = np.zeros(top, dtype=np.int64)
            for i, b in self.spelling.items():
                size[i] = len(b)
            self.letters = np.frombuffer(b"".join(self.spelling.get(i, b"") for i in range(top)), dtype=np.uint8), np.cumsum(size) - size, size
        letters, place, size = self.letters
        ids = np.frombuffer(b"".join(many), dtype=np.uint32)
        sizes = size[ids]
        ends = np.cumsum(sizes)
        flat = letters[np.repeat(place[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        out, at = [], 0
        cuts = np.concatenate([[0], ends])[np.cumsum([len(m) // 4 for m in many])].tolist() if many else []
        for z in cuts:
            out.append(flat[at + 1 : z] if self.prefix and flat[at : at + 1] == b" " and z > at else flat[at:z])
            at = z
        return out


def model(path: str, best: int = BEST) -> Pieces:
    if (path, best) not in _MODELS:
        _MODELS[path, best] = Pieces.load(path, best)
    return _MODELS[path, best]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def nbest(docs: DataFrame, best: int = BEST, path: str | None = None, emit: str = "ids") -> DataFrame:
    """doc_id, nbest: array of (score, n_pieces, ids or, with emit="digest", ids_crc32), and decoded_sha256 of the first."""
    ship(docs.sparkSession)
    path = path or default_path()
    last = ("ids", "array<int>", pa.list_(pa.int32())) if emit == "ids" else ("ids_crc32", "long", pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, best)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), (last[0], last[2])]))
        # The collector waits for the whole task, and leaves out what the worker remembers from then on.
        collects = gc.isenabled()
        gc.disable()
        try:
            for b in batches:
                found = m.encode_batch(b.column(1).cast(pa.binary()).to_pylist())
                rows = [[{"score": s, "n_pieces": len(i) // 4, last[0]: array("I", i).tolist() if emit == "ids" else zlib.crc32(i)} for s, i in got] for got in found]
                decoded = [hashlib.sha256(x).hexdigest() for x in m.decode_batch([got[0][1] for got in found])]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind), pa.array(decoded, pa.string())], names=["doc_id", "nbest", "decoded_sha256"])
        finally:
            gc.freeze()
            if collects:
                gc.enable()

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(lean(run), f"doc_id long, nbest array<struct<score:double,n_pieces:long,{last[0]}:{last[1]}>>, decoded_sha256 string")
