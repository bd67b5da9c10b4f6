import gc
import hashlib
import random
import sys
from array import array
from datetime import datetime, timedelta

from helpers import corpus, frame, with_oddities
from pyspark.sql import functions as F

from keelson.llm import chat, spm, warc


def test_chats_come_back_exactly(spark):
    rng = random.Random(1)
    bits = ["<", "[", "\\", "<|end|>", "<|turn|>", "[INST]", "</s>", "<\\s>", "<|also|>", "a", "é", "\n", "INST]", "|end|>", "<<|says|>"]
    text = lambda: rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))])
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", None, "sys<|says|>"]), text(), 1) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(99, 0, "user", "</s>[INST] ok [/INST]", 1), (99, 1, "assistant", "</s>[INST] ok [/INST]", 1), (None, 1, "user", "x", 1), (98, None, "user", "x", 1), (98, None, "user", "x", 1)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    done = chat.format_chats(chats)
    got = {r.conv_id: r for r in chat.digests(chat.read_chats(done)).collect()}
    assert len(got) == len({r[0] for r in rows})
    for c, r in got.items():
        own = sorted(((t is not None, t or 0, chat_role or "", x or "") for cc, t, chat_role, x, _ in rows if cc == c))
        said = "".join(f"{role}\n{x}\n" for *_, role, x in own)
        loss = "".join(x for *_, role, x in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = done.filter("conv_id = 99").first()
    assert one.formatted.count("[INST]") == 0 and one.formatted.count(chat.TURN) == 2
    assert chat.digests(chat.read_chats(chat.format_chats(chats.limit(0)))).count() == 0


def test_adjacent_turns_of_a_role_share_a_block(spark):
    rows = [(1, k, r, str(k)) for k, r in enumerate(["user", "user", "assistant", "assistant", "user"])]
    f = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first().formatted
    assert f == "<|turn|>user<|says|>0<|also|>1<|end|><|turn|>assistant<|says|>2<|also|>3<|end|><|turn|>user<|says|>4<|end|>"


def test_canonical_urls(spark):
    same = ["HTTP://User@Example.COM:80//a/./b/?z=1&a=2#x", "http://example.com/a/b?a=2&z=1", "example.com/a/b?a=2&&z=1", " http://example.com/a/b/?a=2&z=1 "]
    df = spark.createDataFrame([(u,) for u in [*same, None, "https://example.com:443/"]], "u string")
    got = [r.c for r in df.select(warc.canonical_url(F.col("u")).alias("c")).collect()]
    assert got == ["http://example.com/a/b?a=2&z=1"] * 4 + [None, "https://example.com"]


def slow_revisits(rows):
    out = []
    for i, u, ts, kind, h in rows:
        if kind != "revisit":
            continue
        full = None if u is None or ts is None else max(((t, j, g) for j, v, t, k, g in rows if k == "response" and v is not None and t is not None and v.rstrip("/") == u.rstrip("/") and t < ts), key=lambda x: x[:2], default=None)
        low = lambda m: {k.lower(): v for k, v in (m or {}).items()}
        a, b = low(h), low(full[2]) if full else {}
        weak = lambda s: s.removeprefix("W/")
        if u is None or ts is None:
            what = "no_url" if u is None else "no_time"
        elif full is None:
            what = "no_response"
        elif "etag" in a and "etag" in b:
            what = "etag" if weak(a["etag"]) == weak(b["etag"]) else "mismatch"
        elif "last-modified" in a and "last-modified" in b:
            what = "last_modified" if a["last-modified"] == b["last-modified"] else "mismatch"
        else:
            what = "unvalidated"
        merged = b | {k: v for k, v in a.items() if k in warc.PERMITTED} if what in ("etag", "last_modified") else None
        out.append((i, full[1] if full else None, what, merged))
    return sorted(out, key=str)


def test_revisits_match_brute_force(spark):
    rng, zero = random.Random(6), datetime(2024, 1, 1)
    rows = []
    for i in range(300):
        h = {k: rng.choice("ab") for k in rng.sample(["ETag", "Last-Modified", "Date", "X-Own", "Vary"], rng.randint(0, 4))}
        if "ETag" in h and rng.random() < 0.3:
            h["ETag"] = "W/" + h["ETag"]
        ts = zero + timedelta(hours=rng.randrange(400)) if rng.random() > 0.03 else None
        rows.append((i, rng.choice(["http://a.com/x", "http://a.com/x/", "http://b.com", "http://c.com/q?a=1", None]), ts, rng.choice(["response", "revisit", "revisit"]), h if rng.random() > 0.05 else None))
    df = spark.createDataFrame(rows, "record_id long, url string, ts timestamp, kind string, headers map<string,string>")
    df = df.withColumn("span", F.lit("clash")).withColumn("outcome", F.lit(1))
    got = sorted(((r.record_id, r.response_id, r.outcome, r.headers) for r in warc.resolve_revisits(df).collect()), key=str)
    assert [x[:3] for x in got] == [x[:3] for x in slow_revisits(rows)]
    assert [x[3] and dict(sorted(x[3].items())) for x in got] == [x[3] and dict(sorted(x[3].items())) for x in slow_revisits(rows)]
    assert {x[2] for x in got} >= {"etag", "last_modified", "mismatch", "no_response", "no_url", "no_time", "unvalidated"}
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def every_segmentation(m, s):
    out = []

    def walk(i, score, ids):
        if i == len(s):
            out.append((score, array("I", ids).tobytes()))
            return
        single = False
        for j in range(i + 1, len(s) + 1):
            p = m.vocabulary.get(s[i:j])
            if p:
                walk(j, score + p[1], [*ids, p[0]])
                single |= j == i + 1
        if not single:
            walk(i + 1, score + m.unknown, [*ids, *(m.byte_ids[b] for b in s[i].replace(spm.SPACE, " ").encode())])

    walk(0, 0.0, [])
    return sorted(out, key=lambda x: (-x[0], x[1]))


def test_nbest_matches_every_segmentation():
    rng = random.Random(2)
    for _ in range(300):
        vocabulary = {}
        for k in range(rng.randint(2, 14)):
            vocabulary.setdefault("".join(rng.choice("ab▁c.") for _ in range(rng.randint(1, 3))), (300 + k, -rng.random() * 9 if rng.random() < 0.5 else -float(rng.randint(1, 5))))
        m = spm.Pieces(vocabulary, list(range(256)), best=rng.randint(1, 5))
        x = "".join(rng.choice("ab c.d\0") for _ in range(rng.randint(0, 9)))
        got = m.encode(x)
        want = every_segmentation(m, "▁" + x.replace(" ", "▁") if x else "")[: m.best]
        assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in want] and len({i for _, i in got}) == len(got)
        assert all(m.decode(i) == x for _, i in got)


def test_nbest_of_one_model_string_after_string():
    rng = random.Random(4)
    for _ in range(60):
        pieces = {"".join(rng.choice("ab▁c.") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 14))}
        # No two sums are alike.
        m = spm.Pieces({p: (300 + k, -1 - 0.37 * rng.random()) for k, p in enumerate(sorted(pieces))}, list(range(256)), best=rng.randint(1, 5))
        m.by_words = False
        texts = ["".join(rng.choice("ab c.d") for _ in range(rng.randint(1, 9))) for _ in range(8)]
        for x, got in [*((x, m.encode(x)) for x in texts), *((x, m.search("▁" + x.replace(" ", "▁"))) for x in texts + sorted(texts))]:
            want = every_segmentation(m, "▁" + x.replace(" ", "▁"))[: m.best]
            assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in want]


class Counted(dict):
    asked = 0

    def get(self, key):
        self.asked += 1
        return super().get(key)


def test_nbest_shares_what_words_begin_with():
    m = spm.Pieces({p: (300 + k, -float(k)) for k, p in enumerate(["a", "b", "ab", "ba", "aab", "▁a", "▁"])}, list(range(256)))
    m.edges = Counted(m.edges)
    words = ["abaabbaababaab" + x + y for x in "ab" for y in "ab"]
    got = m.encode_batch([" ".join([words[k] for k in (2, 0, 3, 1)]).encode()])
    alone = spm.Pieces(m.vocabulary, m.byte_ids)
    assert got == [alone.encode(" ".join([words[k] for k in (2, 0, 3, 1)]))]
    once = m.edges.asked
    m.last, m.edges.asked = "", 0
    m.score, m.into = [0.0], [[]]
    m.search("▁" + words[0])
    assert once < 2 * m.edges.asked


def test_nbest_waits_with_collecting_cycles():
    m, began = spm.model(spm.default_path()), []
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(200)).encode() for _ in range(20)]

    def note(phase, info):
        began.append(sys._getframe(1).f_code.co_filename == spm.__file__)

    gc.callbacks.append(note)
    try:
        m.encode_batch(texts)
    finally:
        gc.callbacks.remove(note)
    assert not any(began) and gc.isenabled()


def test_nbest_rows(spark):
    rows = with_oddities(corpus(n=20))
    got = spm.nbest(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    m = spm.model(spm.default_path())
    digests = {hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows}
    for r in got:
        assert r.decoded_sha256 in digests
        scores = [b.score for b in r.nbest]
        assert scores == sorted(scores, reverse=True)
        for b in r.nbest:
            assert b.n_pieces == len(b.ids) and hashlib.sha256(m.decode(array("I", b.ids).tobytes()).encode()).hexdigest() == r.decoded_sha256
    assert spm.nbest(frame(spark, [])).count() == 0
