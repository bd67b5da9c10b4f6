import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import corpus, frame, sentence, with_oddities

from keelson.llm import jaccard, sentence_spans, suffix


# --- sentence spans ------------------------------------------------------------------------------


def slow_spans(rows, run=sentence_spans.RUN, least=sentence_spans.MIN_WORDS):
    seen, spans = {}, []
    for i, t, *_ in rows:
        words = [t.encode()[a:z].lower().split() for a, z in sentence_spans.sentences(t.encode())] if t else []
        for k in range(len(words)):
            place = (i if i is not None else -(1 << 63), k)
            if len(words[k]) >= sentence_spans.ALONE:
                key = (b" ".join(words[k]),)
                spans.append((key, place, k + 1))
                seen[key] = min(seen.get(key, place), place)
            j = k + run
            if j > len(words):
                continue
            while sum(map(len, words[k:j])) < least and j < len(words):
                j += 1
            if sum(map(len, words[k:j])) >= least:
                key = tuple(b" ".join(w) for w in words[k:j])
                spans.append((key, place, j))
                seen[key] = min(seen.get(key, place), place)
    gone = {}
    for key, (i, k), j in spans:
        if (i, k) != seen[key]:
            gone.setdefault(i, set()).update(range(k, j))
    return gone


def test_sentence_spans_match_brute_force(spark):
    rows = corpus(n=90)
    want = slow_spans(rows)
    got = {r.doc_id: r for r in sentence_spans.drop_repeated_spans(frame(spark, rows)).collect()}
    assert len(got) == len(rows) and any(want.values())
    for i, t, *_ in rows:
        assert set(got[i].removed) == want.get(i, set())
        text, n, w = sentence_spans.cut_sentences(t, sorted(want.get(i, ())))
        assert (got[i].text, got[i].n_sentences, got[i].words_removed) == (text, n, w)


def test_shared_passage_stays_once(spark):
    rng = random.Random(2)
    passage = ". ".join(" ".join(f"p{rng.randrange(999)}" for _ in range(12)) for _ in range(6)) + "."
    rows = [(i, f"Own start number {i} here. {passage} Own end number {i} here.", *[None] * 7) for i in range(8)]
    got = {r.doc_id: r.text for r in sentence_spans.drop_repeated_spans(frame(spark, rows)).collect()}
    assert [passage in got[i] for i in range(8)] == [True, *[False] * 7]
    assert all(f"start number {i} " in got[i] and f"end number {i} " in got[i] for i in range(8))


def test_sentence_spans_oddities(spark):
    rows = with_oddities(corpus())
    got = sentence_spans.drop_repeated_spans(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert len({tuple(r.removed) for r in got if r.doc_id == rows[20][0]}) == 1
    assert sentence_spans.drop_repeated_spans(frame(spark, [])).count() == 0


def test_rows_that_share_an_id_are_apart(spark):
    rng = random.Random(6)
    passage, *own = [". ".join(" ".join(f"p{rng.randrange(9999)}" for _ in range(14)) for _ in range(3)) + "." for _ in range(5)]
    texts = [(None, f"{passage} {own[0]}"), (None, f"{passage} {own[1]}"), (None, f"{own[2]} {own[3]}"), (7, f"{own[2]} {passage}"), (7, f"{own[3]} {own[1]}")]
    got = sentence_spans.drop_repeated_spans(frame(spark, [(i, t, *[None] * 7) for i, t in texts])).collect()
    left = " ".join(r.text for r in got)
    assert [left.count(x) for x in (passage, *own)] == [1] * 5
    assert len(got) == 5 and sum(r.n_removed for r in got) == 15


def test_short_runs_tails_and_spliced_sentences_are_found(spark):
    rng = random.Random(9)
    some = lambda n: " ".join(f"p{rng.randrange(99999)}" for _ in range(n))
    tail = [some(n) + "." for n in (12, 4, 5)]
    short = [some(n) + "." for n in (3, 4)]
    spliced = [some(n) for n in (20, 17, 18)]
    texts = []
    for _ in range(2):
        texts.append(" ".join([*tail, some(9) + ".", some(9) + "."]))
        texts.append(" ".join([*short, some(9) + ".", some(9) + "."]))
        texts.append(f"{some(8)} {spliced[0]}. {spliced[1]}. {spliced[2]} {some(8)}.")
    got = {r.doc_id: r.removed for r in sentence_spans.drop_repeated_spans(frame(spark, [(i, t, *[None] * 7) for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(6)] == [[], [], [], [0, 1, 2], [0, 1], [1]]


# --- Jaccard join --------------------------------------------------------------------------------


def slow_components(rows, n, percent):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            i, u = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if u and 100 * i >= percent * u:
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return sorted((r[0] if r[0] is not None else -1, len(sets[k]), least.get(find(k), -1)) for k, r in enumerate(rows))


def near_copies(seed, groups=6, size=25, length=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(4, length))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
            rows.append((len(rows), rng.choice([str.upper, str])(" ".join(w)), *[None] * 7))
    return rows


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 90, 3)])
def test_components_match_brute_force(spark, n, percent, seed):
    rows = [*near_copies(seed), *[(1000 + r[0], *r[1:]) for r in corpus(seed)]]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows), n, percent).collect())
    assert got == slow_components(rows, n, percent)


def drifting(seed, size=40, length=70):
    """Each text is like the few before and after it only, so that most of a group are not like its pivot."""
    rng = random.Random(seed)
    w, rows = [f"w{rng.randrange(500)}" for _ in range(length)], []
    for k in range(size):
        w[(7 * k) % length] = f"n{k}"
        rows.append((5000 + (k * 17) % size, " ".join(w), *[None] * 7))
    return rows


@pytest.mark.parametrize(("members", "seed", "sent"), [(4, 7, 10**6), (2, 8, 0)])
def test_components_with_blocks_and_oddities(spark, monkeypatch, members, seed, sent):
    monkeypatch.setattr(jaccard, "MOST_KEYS_SENT", sent)
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", members)
    passes, links = [], jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda *x: passes.append(1) or links(*x))
    rows = with_oddities([*near_copies(seed, groups=3), *drifting(seed)])
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows), 3, 90).collect())
    assert got == slow_components(rows, 3, 90)
    assert len(passes) == 2  # some sets of large groups are not linked with their pivot
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard.jaccard_components(frame(spark, [(5, None, *[None] * 7), (6, " ", *[None] * 7)])).orderBy("doc_id").collect()] == [(5, 0, 5), (6, 0, 6)]


def test_copies_of_texts_travel_in_passes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 4)
    rows = [*near_copies(9, groups=4), *drifting(9)]
    sent, compare = [], jaccard._compare

    def counted(members, *x):
        sent.append(members.selectExpr("coalesce(sum(length(text)), 0)").first()[0])
        return compare(members, *x)

    monkeypatch.setattr(jaccard, "_compare", counted)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows), 3, 90).collect())
    assert got == slow_components(rows, 3, 90)
    whole = sum(len(r[1]) for r in rows)
    assert sum(sent) > 2 * whole and max(sent) < 2 * whole  # copies of many texts in all, of few at once


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(4)
    for percent in (80, 90):
        bands = jaccard.Bands(percent)
        for _ in range(400):
            x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 300))).astype(np.uint64) * np.uint64(2))
            n = len(x)
            r = int(rng.integers(0, n * (100 - percent) // 100 + 1))
            a = next(a for a in range(n, -1, -1) if a == 0 or 100 * (n - r) >= percent * (n + a))
            y = np.unique(np.concatenate([np.delete(x, rng.choice(n, r, replace=False)), rng.integers(0, 1 << 63, a).astype(np.uint64)]))
            if 100 * (n - r) >= percent * (n + a) and r + a:
                assert len(np.intersect1d(jaccard.signatures(x, bands), jaccard.signatures(y, bands)))


# --- suffix arrays -------------------------------------------------------------------------------


def test_two_stage_sorting_and_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(250):
        x = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 70)).astype(np.uint8)
        sa, raw = suffix.two_stage(x, 100), x.tobytes()
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        for a, b, n in zip(sa, sa[1:], suffix.common_prefixes(x, sa[:-1], sa[1:], 96)):
            assert raw[a : a + n] == raw[b : b + n] and raw[a + n : a + n + 1] != raw[b + n : b + n + 1]


def test_only_suffixes_that_are_asked_for_are_sorted():
    rng = np.random.default_rng(4)
    for _ in range(250):
        x = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 70)).astype(np.uint8)
        asked, raw = rng.random(len(x)) < rng.random(), x.tobytes()
        sa = suffix.two_stage(x, 100, asked)
        assert sa[asked[sa]].tolist() == sorted(np.flatnonzero(asked).tolist(), key=lambda i: raw[i:])
    prose = np.frombuffer(sentence(random.Random(4), 4000).encode(), np.uint8)
    assert len(suffix.two_stage(prose, 100, np.arange(len(prose)) < 1000)) < 1100


def slow_removed(rows, length):
    count = Counter()
    raw = [(t or "").encode() for _, t, *_ in rows]
    for x in raw:
        count.update(x[i : i + length] for i in range(len(x) - length + 1))
    out = []
    for (i, *_), x in zip(rows, raw):
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if count[x[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        left = bytes(b for b, g in zip(x, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((-1 if i is None else i, len(x), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "gram", "hot"), [(400, 64, 4000), (60, 8, 4000), (40, 8, 1), (40, 8, 0)])
def test_removed_bytes_match_brute_force(spark, monkeypatch, length, gram, hot):
    monkeypatch.setattr(suffix.repeated_ranges, "__defaults__", (suffix.LENGTH, None, suffix.GRAM, hot))
    monkeypatch.setattr(suffix, "SLOT", 8)
    rows = with_oddities(corpus(n=80))
    got = suffix.drop_repeats(frame(spark, rows), length, gram).collect()
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)
    assert have == slow_removed(rows, length)


def slow_later(rows, length):
    """Per row: the bytes in strings that come at an earlier (doc_id, null last, digest, position)."""
    none = (1 << 63) - 1
    keyed = [((none if i is None else i, hashlib.md5((t or "").encode()).digest()), (t or "").encode()) for i, t, *_ in rows]
    first = {}
    for key, x in keyed:
        for k in range(len(x) - length + 1):
            w = x[k : k + length]
            first[w] = min(first.get(w, (key, k)), (key, k))
    out = []
    for key, x in keyed:
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if first[x[k : k + length]] != (key, k):
                gone[k : k + length] = b"\1" * length
        out.append(gone)
    return out


@pytest.mark.parametrize(("length", "once", "gram", "hot"), [(400, 200, 64, 4000), (90, 40, 8, 4000), (90, 40, 8, 1), (60, 40, 8, 0)])
def test_first_copies_stay_beside_the_longer_length(spark, monkeypatch, length, once, gram, hot):
    monkeypatch.setattr(suffix.repeated_ranges, "__defaults__", (suffix.LENGTH, None, suffix.GRAM, hot))
    monkeypatch.setattr(suffix, "SLOT", 8)
    rows = with_oddities(corpus(n=80, seed=4))
    got = suffix.drop_repeats(frame(spark, rows), length, gram, once).collect()
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)
    assert have == slow_removed(rows, length)
    gone = slow_later(rows, once)
    plain = lambda i, *x: (-1 if i is None else i, *x)
    want = sorted(plain(r[0], len((r[1] or "").encode()), sum(g)) for r, g in zip(rows, gone))
    assert sorted(plain(r.doc_id, r.n_bytes, r.n_later) for r in got) == want and any(sum(g) for g in gone)
    left = sorted(plain(r[0], bytes(b for b, g in zip((r[1] or "").encode(), x) if not g).decode("utf-8", "ignore")) for r, x in zip(rows, gone))
    assert sorted(plain(r.doc_id, r.text) for r in suffix.cut_text(frame(spark, rows), once, gram).collect()) == left


def test_runs_of_one_byte_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 512)
    rng = random.Random(8)
    own = "".join(rng.choice("abcdef ") for _ in range(3000))
    rows = [(1, "=" * 900, *[None] * 7), (2, own[:1200] + "x", *[None] * 7), (3, "y" + own, *[None] * 7), (4, "ab" * 700, *[None] * 7)]
    got = suffix.drop_repeats(frame(spark, rows)).collect()
    have = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)
    assert have == slow_removed(rows, 400)
    assert suffix.drop_repeats(frame(spark, [])).count() == 0
    cut = {r.doc_id: r for r in suffix.cut_text(frame(spark, rows), 400).collect()}
    assert cut[2].text == rows[1][1] and not cut[2].was_cut and cut[3].text == "y" + own[1200:] and cut[3].n_chars == 1801
