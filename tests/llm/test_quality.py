import math
import random
import re

import pytest
from helpers import corpus, frame, with_oddities

from keelson.llm import quality


def slow_counts(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(ws) - 2):
        seen.setdefault(tuple(ws[i : i + 3]), []).append(i)
    hit = {i + s for at in seen.values() if len(at) > 1 for i in at for s in range(3)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit))


def test_counts_match_the_slow_way():
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("ab é\n\t\x0b#$ \x1c") for _ in range(rng.randint(0, 60)))
        assert quality.counts(t.encode())[:5] == slow_counts(t)


def test_rows_and_base_rule(spark):
    rows = with_oddities(corpus())
    got = quality.quality_rules(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    want = sorted((r[0] if r[0] is not None else -1, *slow_counts(r[1])) for r in rows)
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert have == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)  # nothing is certified without labels


def test_binomial_tail_is_exact():
    for n, x, p in ((5, 2, 0.3), (40, 0, 0.01), (100, 7, 0.05)):
        want = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1))
        assert quality.binomial_tail(n, x, p) == pytest.approx(want, rel=1e-9)
    assert quality.binomial_tail(0, 0, 0.1) == 1.0


def test_certified_cutoffs_keep_the_promise():
    """Over many draws, a cutoff that truly rejects more than the limit is rarely certified."""
    rng, level, share, wrong = random.Random(5), 0.05, 0.05, 0
    for _ in range(300):
        n = 400
        rejected = [sum(rng.random() < 0.06 for _ in range(n))] * len(quality.CUTOFFS)
        wrong += quality.certify(n, rejected, share, level) is not None
    assert wrong <= 300 * level * 1.5
    assert quality.certify(10_000, [0] * len(quality.CUTOFFS), share, level) == quality.CUTOFFS[-1]
    assert quality.certify(10, [0] * len(quality.CUTOFFS), share, level) is None


def test_labels_certify_and_reject(spark):
    rng = random.Random(9)
    good = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(80)), "en") for i in range(1500)]
    bad = [(5000 + i, " ".join(f"w{rng.randrange(10**6)}$$$" for _ in range(80)), "en") for i in range(40)]
    docs = spark.createDataFrame([*good, *bad], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(1500)] + [(5000 + i, 0) for i in range(40)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    assert all(got[i].kept for i in range(1500)) and not any(got[5000 + i].kept for i in range(40))
    assert got[5000].rejected_by == "symbols"
    left = quality.drop_rejected(docs, labels)
    assert left.columns == docs.columns and left.count() == 1500


def test_empty_table(spark):
    none = frame(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_rules(none, labels).count() == 0
    assert quality.drop_rejected(none, labels).columns == none.columns
