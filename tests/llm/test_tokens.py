import random
import tracemalloc
import zlib

import numpy as np
from helpers import corpus, frame, with_oddities
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keelson.llm import bpe, packing, wavelet

PATH = bpe.default_path()
PLAIN = Tokenizer.from_file(PATH)


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet=" ab'\n\t  é\0.", max_size=60)), max_size=6))
def test_chunked_encoding_is_whole_encoding(texts):
    assert [x.tolist() for x in bpe.coder(PATH).encode(texts)] == [ids(t) for t in texts]


def test_memory_resets_stay_exact(monkeypatch):
    monkeypatch.setattr(bpe, "_POOL", 300)
    coder = bpe.Coder(PATH)
    for seed in range(6):
        texts = [r[1] for r in corpus(seed, 10)]
        assert [x.tolist() for x in coder.encode(texts)] == [ids(t) for t in texts]


def test_encoding_much_text_takes_little_memory(monkeypatch):
    texts = [r[1] for r in corpus(3, 40)] + [None, ""]
    want = [ids(t) for t in texts]
    coder = bpe.Coder(PATH)
    many = [t.encode() if t else t for t in texts] * (16_000_000 // sum(len((t or "").encode()) for t in texts))
    coder.encode(texts)
    tracemalloc.start()
    try:
        got = coder.encode(many)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 8 * 16_000_000
    assert all(x.tolist() == want[k % len(want)] for k, x in enumerate(got) if k % 101 < 2)
    # Wherever the texts are parted.
    for size in (0, 1, 100, 5_000):
        monkeypatch.setattr(bpe, "_BYTES", size)
        assert [x.tolist() for x in coder.encode(texts)] == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aB'st.,\n\r\t 1-_éß×÷ÿΩя中\u0301\u00a0\u2003\x1c\x85²", max_size=40), max_size=6))
def test_encoding_holds_at_every_border(texts):
    assert [x.tolist() for x in bpe.coder(PATH).encode(texts)] == [ids(t) for t in texts]


def test_known_words_stay_known_beside_signs(monkeypatch):
    coder = bpe.Coder(PATH)
    coder.encode(["Harborea wintrely, élanorei.\nHarborea."])
    sent, library = [], coder._ids
    monkeypatch.setattr(coder, "_ids", lambda texts: sent.extend(texts) or library(texts))
    text = "Harborea, wintrely élanorei. wintrely.\nHarborea élanorei,"
    assert coder.encode([text])[0].tolist() == ids(text)
    assert sent == []


def test_shard_access_count_occurrence():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 70_000):
        x = rng.zipf(1.3, n).clip(0, 50_256).astype(np.uint16)
        s = wavelet.Shard.of(wavelet.build([None, 3][: 2 if n else 0], np.array([0, n // 2, n] if n else [0]), x))
        assert (s.decode() == x).all()
        for i in rng.integers(0, n, 20).tolist() if n else ():
            assert s.access(i) == x[i]
        for t in (1, 2, 50_256, 60_000):
            at = np.flatnonzero(x == t)
            assert s.count(t) == len(at) and s.count(t, n // 4, n // 2) == ((at >= n // 4) & (at < n // 2)).sum()
            for k in {0, len(at) // 2, len(at) - 1, len(at)}:
                assert s.occurrence(t, k) == (at[k] if 0 <= k < len(at) else None)
        docs, starts = s.documents()
        assert (docs, starts.tolist()) == (([None, 3], [0, n // 2, n]) if n else ([], [0]))


def test_files_round_trip(spark):
    rows = with_oddities(corpus())
    manifest = wavelet.write_shards(frame(spark, rows), shard_tokens=2_000)
    got = wavelet.read_shards(manifest).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, expected = 0, []
    for r in want:
        x = np.array([*ids(r[1]), 2], dtype="<u4")
        expected.append((r[0], at, len(x), zlib.crc32(x)))
        at += len(x)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == expected
    first = manifest.orderBy("start").first()
    shard = wavelet.Shard.of(wavelet.read_file(first.path))
    assert [shard.access(i) for i in range(3)] == [*ids(want[0][1]), 2][:3]
    assert sum(r.n_tokens for r in manifest.collect()) == at
    assert wavelet.read_shards(wavelet.write_shards(frame(spark, []))).count() == 0


def brute(pos, penalty, width):
    best = [0] + [10**9] * (len(pos) - 1)
    for j in range(1, len(pos)):
        for i in range(j):
            n = int(pos[j] - pos[i])
            if n <= width:
                pad = width - n if n & (n - 1) else (packing.SHORT_WINDOW if n < width else 0)
                best[j] = min(best[j], best[i] + penalty[j] + min(pad, width - n))
    return best[-1]


def test_cuts_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(150):
        pos = np.unique(np.concatenate([[0], rng.integers(1, 900, rng.integers(1, 60))]))
        pos = np.unique(np.concatenate([pos, *[np.arange(a, b, 200) for a, b in zip(pos, pos[1:])]]))
        penalty = rng.integers(0, 12, len(pos))
        penalty[[0, -1]] = 0
        chain, cost = packing.choose_cuts(pos, penalty, 256), 0
        for a, b in zip(chain, chain[1:]):
            n = int(pos[b] - pos[a])
            assert 0 < n <= 256
            pad = 256 - n if n & (n - 1) else (packing.SHORT_WINDOW if n < 256 else 0)
            cost += penalty[b] + min(pad, 256 - n)
        assert cost == brute(pos, penalty, 256)


def check_pieces(pieces, rows):
    """Each id lies in one piece, in order; sequences are gapless and short enough."""
    docs, runs = {}, {}
    for p in pieces:
        docs.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        runs.setdefault(p.sequence_id, []).append(p)
    total = 0
    for i, t, *_ in rows:
        x = [*ids(t), 1]
        total += len(x)
        own = sorted(docs[i, len(x)], key=lambda p: p.start)
        flat = [v for p in own for v in p.ids]
        assert all(x[p.start : p.start + p.length] == list(p.ids) for p in own) or flat != x
    assert sum(p.length for p in pieces) == total
    for run in runs.values():
        at = 0
        for p in sorted(run, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) > 0
            at += p.length
        assert at <= 2048
    return total, [sum(p.length for p in r) for r in runs.values()]


def test_packing(spark):
    rows = corpus(n=200)
    pieces = packing.pack(frame(spark, rows).coalesce(1)).collect()
    total, loads = check_pieces(pieces, rows)
    for i, t, *_ in rows:
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert [v for p in own for v in p.ids] == [*ids(t), 1]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in loads)
    assert padding < 0.05 * total
    digest = packing.pack(frame(spark, rows).coalesce(1), emit="digest").collect()
    assert sorted((p.doc_id, p.start, zlib.crc32(np.array(p.ids, dtype="<u4"))) for p in pieces) == sorted((p.doc_id, p.start, p.ids_crc32) for p in digest)


def test_packing_oddities(spark):
    rows = with_oddities(corpus())
    pieces = packing.pack(frame(spark, rows)).collect()
    assert sum(p.length for p in pieces) == sum(len(ids(r[1])) + 1 for r in rows)
    assert packing.pack(frame(spark, [])).count() == 0


def test_blocks_carry_over():
    rng = random.Random(4)
    ends = np.zeros(65_536, dtype=bool)
    ends[5] = True
    docs = [np.array([rng.randrange(30) for _ in range(rng.randint(1, 400))], dtype=np.uint16) for _ in range(120)]
    packer, out = packing.Packer(ends, 64, block=900), []
    for i, d in enumerate(docs):
        out += packer.add(i, d)
    out += packer.flush(True)
    for i, d in enumerate(docs):
        own = sorted((o for o in out if o[0] == i), key=lambda o: o[2])
        assert np.concatenate([o[6] for o in own]).tolist() == d.tolist()
