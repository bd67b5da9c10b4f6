"""Relational chat formatting: Spark expressions only.

Rows of a conversation are collected as (turn, role, text) structs and sorted; adjacent turns of
one role are merged into one block by array aggregation; blocks are concatenated. A block is
``<|turn|>role<|says|>text<|also|>text...<|end|>``. Control strings inside roles and texts get a backslash after
their first character (one more if some are there already), which is undone by taking one away, so
every text comes back exactly. The mask is a list of character spans, one per trained turn.

Cases. Null text or role: empty. Null turn: sorts first. Ties in turn: by role, then text; repeated
rows stay repeated. Null conv_id: one conversation. Empty table: no rows. Very long texts: kept
whole. Other columns are not read. A conversation is one row of the result by nature; a table whose
rows are mostly of one conversation still yields that one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# This template's control strings, then those of common chat templates.
TURN, SAYS, ALSO, END = "<|turn|>", "<|says|>", "<|also|>", "<|end|>"
OTHERS = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TAILS = r"\|turn\|>|\|says\|>|\|also\|>|\|end\|>|/?s>|/?INST\]|\|im_start\|>|\|im_end\|>|\|endoftext\|>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({TAILS})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({TAILS})", "$1$2$3")


def merged(turns: Column) -> Column:
    """Blocks (role, texts) of sorted turn structs; adjacent turns of one role share a block."""
    empty = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def add(blocks: Column, t: Column) -> Column:
        last = F.element_at(blocks, -1)
        alone = F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))
        joined = F.array(F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts")))
        same = (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == t["role"])
        return F.when(same, F.concat(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), joined)).otherwise(F.concat(blocks, alone))

    return F.aggregate(turns, empty, add)


def format_chats(chats: DataFrame, trained: str = TRAINED) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, length in code points from 0)."""
    text = lambda c: escape(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    blocks = sorted_turns.select("conv_id", merged(F.col("turns")).alias("blocks"))
    said = lambda b: F.concat(F.lit(TURN), b["role"], F.lit(SAYS), F.array_join(b["texts"], ALSO), F.lit(END))
    formatted = blocks.select("conv_id", "blocks", F.array_join(F.transform("blocks", said), "").alias("formatted"))

    def place(state: Column, b: Column) -> Column:
        first = state["at"] + F.length(F.concat(F.lit(TURN), b["role"], F.lit(SAYS)))
        walked = F.aggregate(
            b["texts"],
            F.struct(first.cast("int").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
            lambda s, t: F.struct((s["at"] + F.length(t) + len(ALSO)).cast("int").alias("at"), F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), F.length(t).alias("length")))).alias("spans")),
        )
        end = walked["at"] - len(ALSO) + len(END)
        return F.struct(end.cast("int").alias("at"), F.when(b["role"] == trained, F.concat(state["spans"], walked["spans"])).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return formatted.select("conv_id", "formatted", F.aggregate("blocks", start, place)["spans"].alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) and loss_text, from ``formatted`` and ``loss_spans`` alone."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>"), lambda x: x != "")

    def turns_of(block: Column) -> Column:
        parts = F.split(F.substring(block, len(TURN) + 1, 1 << 30), r"<\|says\|>")
        return F.transform(F.split(F.element_at(parts, 2), r"<\|also\|>"), lambda t: F.struct(unescape(F.element_at(parts, 1)).alias("role"), unescape(t).alias("text")))

    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"), F.array_join(masked, "").alias("loss_text"))


def digests(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
