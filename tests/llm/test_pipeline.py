import random
import re
import time
from collections import Counter

import duckdb
import pytest
from helpers import corpus, sentence
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from keelson import session
from keelson.llm import bpe, oracles, queries


def tables(spark, folder, rows):
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages_in_turn(spark, tmp_path):
    rows = corpus(n=120)
    docs = tables(spark, tmp_path, rows)
    good = corpus_pipeline.keep_good(spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    kept = {r.doc_id: r for r in good.collect()}
    assert kept and all(len(r.text.split()) >= 50 for r in kept.values())
    assert all(tuple(kept[r[0]]) == r[:5] for r in rows if r[0] in kept)
    single = corpus_pipeline.keep_one_of_each(spark, good, str(tmp_path))
    assert {r.doc_id for r in single.collect()} == first_of_each([(r.doc_id, r.text) for r in kept.values()]) and single.count() < good.count()
    cut = corpus_pipeline.cut_repeats(spark, single, str(tmp_path))
    assert cut.columns == docs.columns
    want = without_later([(r.doc_id, r.text) for r in single.collect()])
    assert {r.doc_id: r.text for r in cut.collect()} == want and len(want) < single.count()
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(bpe.default_path())
    assert {p.doc_id for p in pieces} == set(want)
    for i, text in want.items():
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert [v for p in own for v in p.ids] == [*t.encode(text, add_special_tokens=False).ids, 1]


def first_of_each(rows):
    """Brute force: the least id of every component of texts whose five-word shingles are alike to 0.8."""
    sets = {}
    for i, text in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if least[j] < least[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                    least[i], changed = least[j], True
    return set(least.values())


def without_later(rows):
    """Brute force: texts without their 200-byte strings that come earlier too; texts that were cut keep 50 words or go."""
    first, n, out = {}, 200, {}
    raw = sorted((i, t.encode()) for i, t in rows)
    for i, x in raw:
        for k in range(len(x) - n + 1):
            first.setdefault(x[k : k + n], (i, k))
    for i, x in raw:
        gone = bytearray(len(x))
        for k in range(len(x) - n + 1):
            if first[x[k : k + n]] != (i, k):
                gone[k : k + n] = b"\1" * n
        left = bytes(b for b, g in zip(x, gone) if not g).decode("utf-8", "ignore")
        if not any(gone) or len(left.split()) >= 50:
            out[i] = left
    return out


def test_repeated_rows_and_null_ids_keep_one_row(spark, tmp_path):
    rng = random.Random(5)
    clean, bare, near, shared, other = (" ".join(sentence(rng) for _ in range(14)) for _ in range(5))
    # A repeated row, a text of null ids alone, a null-id near copy of a kept document, and one id with two texts.
    texts = [(1, clean), (1, clean), (1, clean), (None, bare), (None, bare), (2, near), (None, near + " One more word."), (3, shared), (3, other), (None, None), (4, "")]
    docs = tables(spark, tmp_path, [(i, t, "en", "s", len(t) if t else None) for i, t in texts])
    single = corpus_pipeline.keep_one_of_each(spark, docs, str(tmp_path))
    want = [(1, clean), (None, bare), (2, near), (3, shared), (3, other), (None, None), (4, "")]
    assert Counter((r.doc_id, r.text) for r in single.collect()) == Counter(want)
    assert single.columns == docs.columns and {r.n_chars for r in single.filter("doc_id = 1").collect()} == {len(clean)}
    left = corpus_pipeline.cut_repeats(spark, single, str(tmp_path)).collect()
    assert Counter(r.text for r in left if r.text) == Counter([clean, bare, near, shared, other])


def test_a_cut_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before, setting = files(), spark.conf.get(session.CLEANUP, None)
    grouped = spark.range(5000).groupBy((F.col("id") % 997).alias("k")).agg(F.sum("id").alias("s"))
    out = session.cut(grouped)
    for _ in range(50):  # they go in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    # What was cut and what comes of it can be read again and again.
    assert out.count() == grouped.count() == 997 and sorted(out.collect()) == sorted(grouped.collect())
    assert spark.conf.get(session.CLEANUP, None) == setting


def test_empty_documents(spark, tmp_path):
    tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op1_quality_rules", "op8_warc_revisits", "op9_chat_format"])
def test_sql_gives_the_same_rows(spark, name):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations"):
        db.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    rel = db.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, folder)
    order = sorted(got.columns)
    assert sorted(rel.columns) == order
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr) == sorted((tuple(r[rel.columns.index(c)] for c in order) for r in rel.fetchall()), key=repr)
    assert oracles.OP9
