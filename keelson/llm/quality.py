"""Quality rules with risk-controlled cutoffs.

Each rule scores a document from 0 to 1000, higher being worse, and rejects scores above a
cutoff. Labelled good documents that the base rule keeps are the holdout. In each group and
for each rule the cutoffs are tried in one fixed order, from the loosest to the tightest; a
cutoff is certified when the exact binomial tail P(Bin(n, share) <= rejected) is at most the
error level, which is the same as the one-sided Clopper-Pearson bound on its false-rejection
rate lying below ``share``. Trying stops at the first failure (fixed-sequence testing needs no
further correction); over groups and rules the level is divided (Bonferroni), and a group's
false-rejection limit is divided over its rules. So with confidence 1 - error no group loses
more than ``limit`` of its good documents. Groups with too few labels certify no cutoff and
reject nothing beyond the base rule.

Cases. Null or empty text: no words, base_failed. Null group: the group ''. Repeated rows:
judged one by one. Several labels for one id: good only if all say so. No labels: base rule only.
Other columns of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.workers import lean
from keelson.session import cut, ship

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MOST_REPEATED_PERCENT = 50
RULES = ("symbols", "dup_lines", "repeats", "capitals")
CUTOFFS = (900, 800, 700, 600, 500, 450, 400, 350, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 15, 10, 5)
LIMIT = 0.02
ERROR = 0.05
MOST_GROUPS_SENT = 10_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
_CAPITALS = bytes(range(65, 91))
_SYMBOLS = SYMBOLS.encode()
_BLANKS = b" \t\n\x0b\x0c\r"
_TAILS = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> int:
    """Positions in a 3-word window that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    m = len(seen)
    if m == n:
        return 0
    if m < 2_000_000:
        keys = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
    else:
        _, pair = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)
        keys = pair[:-1].astype(np.int64) * m + ids[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, dtype=bool)
    starts = np.zeros(n - 2, dtype=bool)
    starts[order[1:][same]] = True
    starts[order[:-1][same]] = True
    for shift in range(3):
        hit[shift : shift + n - 2] |= starts
    return int(hit.sum())


def counts(text: bytes | None) -> tuple[int, ...]:
    """The columns of COUNTS for one whole text."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    points = len(text) - (len(text) - len(text.translate(None, _TAILS)))
    blanks = len(text) - len(text.translate(None, _BLANKS))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), points - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), capitals


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [counts(x.as_buffer().to_pybytes() if x.is_valid else None) for x in b.column(b.num_columns - 1).cast(pa.binary())]
        cols = list(zip(*got)) if got else [()] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, pa.int64()) for c in cols)], names=[*b.schema.names[:-1], *COUNTS])


def count_words(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns plus COUNTS; one narrow pass over the texts."""
    ship(docs.sparkSession)
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return df.mapInArrow(lean(_count_batches), f"{fields}, {', '.join(f'{c} long' for c in COUNTS)}")


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def scores() -> dict[str, F.Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.floor(1000 * F.col(a) / F.col(b))).otherwise(F.lit(0)).cast("long")
    return dict(zip(RULES, (per("n_symbols", "word_chars"), per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words"), per("n_capitals", "word_chars"))))


def binomial_tail(n: int, x: int, share: float) -> float:
    """P(Bin(n, share) <= x), summed downward from x or, beyond the mean, upward from it: terms shrink and the rest is too small to count."""
    if n == 0 or x >= n:
        return 1.0
    above = x >= n * share
    k = x + 1 if above else x
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share))
    total, odds = 0.0, share / (1 - share)
    while term > total * 1e-17:
        total += term
        term *= odds * (n - k) / (k + 1) if above else k / odds / (n - k + 1)
        k += 1 if above else -1
    return min(1.0, 1.0 - total if above else total)


def certify(n: int, rejected: list[int], share: float, level: float) -> int | None:
    """The tightest certified cutoff; rejected[j] good documents fall to CUTOFFS[j]."""
    best = None
    for cutoff, x in zip(CUTOFFS, rejected):
        if x > n * share or binomial_tail(n, x, share) > level:
            break
        best = cutoff
    return best


def cutoffs(good: DataFrame, limit: float = LIMIT, error: float = ERROR) -> tuple[DataFrame, int]:
    """(grp, one cutoff column per rule) from the good holdout with COUNTS, and the number of groups.

    Only counts by group, rule and cutoff leave the executors' map side.
    """
    rule = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), s.alias("score")) for k, s in scores().items()]))
    falls = F.aggregate(F.array(*[F.lit(c) for c in CUTOFFS]), F.lit(0), lambda a, c: a + F.when(F.col("r.score") <= c, 1).otherwise(0))
    hist = cut(good.select("grp", rule.alias("r")).groupBy("grp", F.col("r.rule").alias("rule"), falls.alias("first")).agg(F.count("*").alias("n")))
    groups = hist.select("grp").distinct().count()
    share, level = limit / len(RULES), error / max(1, groups * len(RULES))

    def one(pdf):
        import pandas as pd

        out = {"grp": pdf["grp"].iloc[0]}
        for k in RULES:
            g = pdf[pdf["rule"] == k]
            by = np.zeros(len(CUTOFFS) + 1, dtype=np.int64)
            by[g["first"].to_numpy()] = g["n"].to_numpy()
            out[k] = certify(int(by.sum()), np.cumsum(by)[:-1].tolist(), share, level)
        return pd.DataFrame([out]).astype({k: "Int64" for k in RULES})

    return hist.groupBy("grp").applyInPandas(one, "grp string, " + ", ".join(f"{k} long" for k in RULES)), groups


def good_holdout(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    good = labels.groupBy(F.col(id_col).alias("__id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("__q")).filter("__q >= 1").select("__id")
    return counted.filter(~base_failed()).join(good, F.col(id_col) == F.col("__id"), "left_semi")


def judge(counted: DataFrame, bounds: DataFrame, n_groups: int) -> DataFrame:
    """counted (with grp) plus base_failed, rejected_by and kept."""
    small = bounds.select(F.col("grp").alias("__s"), *[F.col(k).alias(f"__{k}") for k in RULES])
    if n_groups <= MOST_GROUPS_SENT:
        small = F.broadcast(small)
    hit = [F.when(s > F.col(f"__{k}"), F.lit(k)) for k, s in scores().items()]
    got = counted.join(small, F.col("grp") == F.col("__s"), "left")
    got = got.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.concat_ws(",", *hit))
    return got.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == "")).drop("__s", *[f"__{k}" for k in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, group_by: str = "lang", limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """doc_id, grp, COUNTS, base_failed, rejected_by, kept: a row for each row of ``docs``."""
    named = docs.select("doc_id", F.coalesce(F.col(group_by), F.lit("")).alias("grp"), "text")
    counted = cut(count_words(named, ["doc_id", "grp"]))
    return judge(counted, *cutoffs(good_holdout(counted, labels), limit, error))


def drop_rejected(docs: DataFrame, labels: DataFrame, group_by: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged.

    Texts do not travel: they are counted once for the cutoffs and once, row by row, for the verdict.
    """
    named = docs.select("doc_id", F.coalesce(F.col(group_by), F.lit("")).alias("grp"), "text")
    bounds, groups = cutoffs(good_holdout(count_words(named, ["doc_id", "grp"]), labels))
    bounds = cut(bounds)
    columns = docs.columns
    whole = docs.select(F.coalesce(F.col(group_by), F.lit("")).alias("grp"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col("text").alias("__t"))
    return judge(count_words(whole, ["grp", "__row"], "__t"), bounds, groups).filter("kept").select("__row.*")
