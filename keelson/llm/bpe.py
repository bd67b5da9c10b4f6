"""Exact whole-text BPE ids through the tokenizers library, with the ids of short chunks remembered.

A byte-level BPE never merges across pre-tokens, so a text may be cut where a pre-token surely starts and
each chunk encoded alone. That is so at a space that is followed by a non-space; behind a letter, before an ASCII
byte that is none; and behind a single line feed, before a letter. Letters are here those of ASCII and
Latin-1, others are never cut. Texts with white space after a space, or which contain an added token, are encoded whole.

Chunks of up to 23 bytes are looked up in a table that holds their very bytes and length as three
integers, so a hit is exact. All chunks of some megabytes of text are looked up at once with NumPy; a new chunk takes the place of
whatever was in its slot. Chunks that are not found are strung together and encoded in one go, those without a space before them
behind line feeds: as ids stand for whole bytes and no id reaches over a chunk's start, counting bytes tells which ids are whose.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

_SLOTS = 1 << 21
_POOL = 9_000_000
_WORDS = 3
_LONGEST = 8 * _WORDS - 1  # the last byte of a key holds the length
_TOGETHER = 4_000
_BYTES = 2 << 20
_CODERS: dict[str, "Coder"] = {}
# White space in UTF-8, by the first byte, and by all bytes as a little-endian integer.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WIDE = np.zeros(256, dtype=bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_WIDE_2 = np.array([0x85C2, 0xA0C2], dtype=np.uint64)
_WIDE_3 = np.array([int.from_bytes(chr(c).encode(), "little") for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)], dtype=np.uint64)
# Classes of ASCII bytes; Latin-1 letters have two bytes, the first of which is 0xC3 (0xC397 and 0xC3B7 are signs).
_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[[*range(65, 91), *range(97, 123)]] = True
_OTHER = ~_ALPHA & (np.arange(256) < 128)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


class Coder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        if size > 65_536:
            raise ValueError("ids are held in 16 bits; this vocabulary needs more")
        # One letter of the byte alphabet stands for one byte.
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self.keys = np.zeros((_SLOTS, _WORDS), dtype=np.uint64)
        self.places = np.zeros(_SLOTS, dtype=np.int32)
        self.counts = np.zeros(_SLOTS, dtype=np.uint16)
        self.pool = np.zeros(_POOL, dtype=np.uint16)
        self.used = 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(array("H", e.ids), dtype=np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks, and per chunk the place of its first one there and their number."""
        spaced, lined, alone = [], [], []
        for k, c in enumerate(chunks):
            if c[0] == 32:
                spaced.append(k)
            else:
                t = c.decode()
                (lined if t.split() == [t] else alone).append(k)
        flat, used = [], 0
        place, count = np.zeros(len(chunks), dtype=np.int64), np.zeros(len(chunks), dtype=np.int64)
        for kind, mark in ((spaced, b""), (lined, b"\n")):
            groups = [kind[at : at + _TOGETHER] for at in range(0, len(kind), _TOGETHER)]
            for some, ids in zip(groups, self._ids([b"".join([mark + chunks[k] for k in g]).decode() for g in groups])):
                sizes = np.fromiter((len(chunks[k]) for k in some), dtype=np.int64, count=len(some))
                ends = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])
                upto = np.cumsum(sizes + len(mark))
                lo, hi = np.searchsorted(ends, upto - sizes), np.searchsorted(ends, upto)
                if ends[-1] == upto[-1] and (ends[lo] == upto - sizes).all() and (ends[hi] == upto).all():
                    place[some], count[some] = used + lo, hi - lo
                    flat.append(ids)
                    used += len(ids)
                else:
                    alone += some
        for k, ids in zip(alone, self._ids([chunks[k].decode() for k in alone])):
            place[k], count[k] = used, len(ids)
            flat.append(ids)
            used += len(ids)
        return np.concatenate(flat), place, count

    def encode(self, texts: list[str | bytes | None]) -> list[np.ndarray]:
        """16-bit ids of every whole text; null is the empty text.

        Texts are taken about _BYTES at a time: the look-up of all chunks takes many times the bytes of the texts.
        """
        out, some, size = [], [], 0
        for t in texts:
            raw = t.encode() if isinstance(t, str) else t or b""
            if some and size + len(raw) > _BYTES:
                out += self._encode(some)
                some, size = [], 0
            some.append(raw)
            size += len(raw)
        return out + self._encode(some) if some else out

    def _encode(self, raw: list[bytes]) -> list[np.ndarray]:
        out = [np.zeros(0, dtype=np.uint16)] * len(raw)
        some = [k for k, r in enumerate(raw) if r]
        if not some:
            return out
        raw = [raw[k] for k in some]
        total = sum(map(len, raw))
        data = b"".join([*raw, bytes(_LONGEST + 9)])
        buf = np.frombuffer(data, dtype=np.uint8)
        begin = np.cumsum([0, *map(len, raw)])
        starts = np.flatnonzero(self._cuts(buf[:total], begin[:-1]))
        sizes = np.diff(starts, append=total)
        edge = np.searchsorted(starts, begin)
        first = edge[:-1]
        view = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        w = [view[starts + 8 * k] & _MASKS[np.clip(sizes - 8 * k, 0, 8)] for k in range(_WORDS)]
        w[-1] |= np.minimum(sizes, 255).astype(np.uint64) << np.uint64(56)
        # Spaces before white space, and last ones, make their text be encoded whole.
        after = buf[starts + 1]
        odd = (sizes == 1) | _BLANK[after]
        wide = np.flatnonzero(_WIDE[after])
        if len(wide):
            letter = w[0][wide] >> np.uint64(8)
            odd[wide] |= np.isin(letter & _MASKS[2], _WIDE_2) | np.isin(letter & _MASKS[3], _WIDE_3)
        odd &= buf[starts] == 32
        whole = np.logical_or.reduceat(odd, first)
        for k, r in enumerate(raw):
            if any(a in r for a in self.added):
                whole[k] = True
        usable = ~np.repeat(whole, np.diff(edge))
        h = w[0] * np.uint64(0x9E3779B97F4A7C15)
        for x in w[1:]:
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        hit = usable & (sizes <= _LONGEST)
        for k in range(_WORDS):
            hit &= self.keys[slot, k] == w[k]
        place, count = np.where(hit, self.places[slot], 0), np.where(hit, self.counts[slot], 0).astype(np.int64)
        source = self.pool
        miss = np.flatnonzero(usable & ~hit)
        if len(miss):
            known: dict[bytes, int] = {}
            which = [known.setdefault(data[s : s + n], len(known)) for s, n in zip(starts[miss].tolist(), sizes[miss].tolist())]
            flat, offset, n_ids = self._learn(list(known))
            offset, count[miss] = offset[which], n_ids[which]
            if self.used + len(flat) > _POOL:
                source = np.concatenate([self.pool[: self.used], flat])
            place[miss] = self.used + offset
            self._remember(miss, slot, w, sizes, flat, offset, count[miss])
        ends = np.cumsum(count)
        ids = source[np.repeat(place - (ends - count), count) + np.arange(int(ends[-1]))]
        cuts = np.concatenate([[0], ends])[edge].tolist()
        for k, a, z in zip(some, cuts, cuts[1:]):
            out[k] = ids[a:z]
        for k in np.flatnonzero(whole).tolist():
            out[some[k]] = self._ids([raw[k].decode()])[0]
        return out

    @staticmethod
    def _cuts(buf: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Where texts, and pre-tokens for sure, start. What stands before a text's start does no harm, as that is a cut anyway."""
        alpha = _ALPHA[buf]
        letter = alpha.copy()  # bytes that end one
        letter[1:] |= (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        cut = buf == 32
        cut[1:] |= letter[:-1] & _OTHER[buf[1:]]
        if len(buf) > 2:
            solid = letter | ((buf > 32) & (buf < 127))
            cut[2:] |= (buf[1:-1] == 10) & solid[:-2] & (alpha | (buf == 0xC3))[2:]
        cut[begin] = True
        return cut

    def _remember(self, miss, slot, w, sizes, flat, offset, count) -> None:
        if self.used + len(flat) > _POOL:
            self.keys[:] = 0
            self.used = 0
            if len(flat) > _POOL:
                return
        self.pool[self.used : self.used + len(flat)] = flat
        fit = (sizes[miss] <= _LONGEST) & (count < 65_536)
        keep, offset, count = miss[fit], offset[fit], count[fit]
        # Of chunks with one slot the last stays, all its fields alike.
        _, last = np.unique(slot[keep][::-1], return_index=True)
        last = len(keep) - 1 - last
        s = slot[keep[last]]
        for k in range(_WORDS):
            self.keys[s, k] = w[k][keep[last]]
        self.places[s] = self.used + offset[last]
        self.counts[s] = count[last]
        self.used += len(flat)


def coder(path: str) -> Coder:
    """One coder per worker process and vocabulary file."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
