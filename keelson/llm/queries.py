"""The registered queries of this sub-package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import chat, jaccard, media, oracles, packing, quality, sentence_spans, spm, suffix, warc, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_features(media.store_texts(_table(spark, sf_dir, "documents")))


def op3_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_shards(wavelet.write_shards(_table(spark, sf_dir, "documents")))


def op4_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), emit="digest")


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.drop_repeated_spans(_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_later: bytes in 200-byte passages that come earlier too, so that passages below the 400 bytes show as well."""
    got = suffix.drop_repeats(_table(spark, sf_dir, "documents"), once=200)
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_later")


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.resolve_revisits(warc.captures(_table(spark, sf_dir, "pages")))
    said = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return got.select("record_id", "canonical_url", "response_id", "outcome", F.md5(said).alias("headers_md5"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.read_chats(chat.format_chats(chats)))


def op10_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spm.nbest(_table(spark, sf_dir, "documents"), emit="digest")
    first = F.col("nbest")[0]
    return got.select(
        "doc_id",
        F.size("nbest").cast("long").alias("n_best"),
        first["n_pieces"].alias("n_pieces"),
        first["score"].alias("score"),
        first["ids_crc32"].alias("ids_crc32"),
        F.transform("nbest", lambda x: x["score"]).alias("scores"),
        F.transform("nbest", lambda x: x["ids_crc32"]).alias("all_crc32"),
        "decoded_sha256",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_quality_rules, op2_media_sniffing, op3_wavelet_shards, op4_window_packing, op5_sentence_spans,
            op6_jaccard_join, op7_suffix_dedup, op8_warc_revisits, op9_chat_format, op10_nbest_pieces,
        )
    }


def oracle_sql() -> dict[str, str]:
    """The others are held against brute force in tests: SQL cannot express tokenizers, checksums, stored
    forms, exact set joins with spanning links, byte windows over a corpus or searches over lattices."""
    return {"op1_quality_rules": oracles.OP1, "op8_warc_revisits": oracles.OP8, "op9_chat_format": oracles.OP9}
