"""The corpus pipeline: quality rules, near-duplicate removal, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
back as the next stage's documents. All stages but the last return the columns of documents; further columns are
not read, so their names cannot clash, and they end with the first stage. Each stage says what becomes of
nulls, empty texts, ties and repeated rows; of an empty table each makes an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import jaccard, packing, quality, suffix
from keelson.session import cut, fresh_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Bytes: nearly every run of more than 50 words of prose is longer, stock phrases are shorter.
PASSAGE = 200


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, null and empty texts with them; all other rows stay unchanged, repeated ones each."""
    return quality.drop_rejected(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8 or more) one row stays.

    It is the one with the least doc_id, null last, then the least digest of the text; of rows equal in both, the
    least by the other columns. Rows without a word all stay.
    """
    stays = cut(jaccard.one_per_component(docs, n=5, percent=80))
    rows = docs.select(*COLUMNS).withColumn("t", jaccard.digest())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("stay_id")) & (F.col("t") == F.col("stay_t"))
    once = rows.join(stays.filter("not repeated"), same, "left_semi").select(*COLUMNS)
    # Equal rows meet as one row per task, and only those that do repeat are shuffled for it.
    again = rows.join(stays.filter("repeated"), same, "left_semi").groupBy("doc_id", "t").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return once.unionByName(again.select("row.*"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of PASSAGE bytes stay where they come first (doc_id, null last, digest of the text, position) and are cut out elsewhere.

    Texts that were cut meet the base rule of the first stage again: those with too few words left go. Texts that
    were not cut all stay as they are, null and empty ones too (as empty). Rows equal in doc_id and text are one document.
    """
    left = suffix.cut_text(docs.select(*COLUMNS), PASSAGE)
    words = F.size(F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != ""))
    return left.filter(~F.col("was_cut") | (words >= quality.MIN_WORDS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids; a row per piece, with its ids. Null and empty texts are an end id; each row is a document, repeated or not."""
    return packing.pack(docs, emit="ids")


STAGES = [("quality_rules", keep_good), ("jaccard_join", keep_one_of_each), ("suffix_dedup", cut_repeats), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
