"""Chat formatting: conversations to one marked-up text each, and back, by Spark expressions alone.

Template. A block holds adjacent turns of one role::

    <|role|>text<|next|>text<|end|>

In a text, a backslash becomes ``\\b`` and ``<|`` becomes ``\\m``; in a role, ``|>`` becomes ``\\c`` too. So neither can
hold a control string, and both are restored exactly. ``<|next|>`` parts turns that were merged into one block. The
loss mask is written beside the text: a span for each assistant turn, which holds its escaped text and no control string.

Defined results: null text counts as empty, null role as the empty role; a null turn comes first; equal turns are
ordered by role, then text; repeated rows are turns of their own; a row whose conversation id is null is a conversation
of its own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens.functions.arrays import running

OPEN, CLOSE, NEXT, END = "<|", "|>", "<|next|>", "<|end|>"
TRAINED = "assistant"


def _put(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return _put(_put(text, "\\", "\\b"), OPEN, "\\m")


def unescape(text: Column) -> Column:
    return _put(_put(text, "\\m", OPEN), "\\b", "\\")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, n_blocks, formatted, mask (array<struct<start,end>>, code points of formatted).

    A conversation is one output text, so its turns meet in one row; nothing wider is gathered.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.when(F.col(conv).isNull(), F.monotonically_increasing_id()).alias("lone"),
        F.struct(
            F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
        ).alias("t"),
    )
    gathered = rows.groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list("t")).alias("turns")).drop("lone")
    at = lambda i: F.try_element_at("turns", i)["role"]  # noqa: E731  1-based
    # Where the role changes a block begins; the turns up to the next such place are merged.
    begun = gathered.select("*", F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (at(F.greatest(i - 1, F.lit(1))) != at(i))).alias("begins"))
    after = lambda k: F.coalesce(F.try_element_at("begins", k + 2), F.size("turns") + 1)
    written = lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text"))
    blocked = begun.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.transform("begins", lambda b, k: F.transform(F.slice("turns", b, after(k) - b), written)).alias("blocks")
    )
    opening = lambda b: F.concat(F.lit(OPEN), _put(escape(b[0]["role"]), CLOSE, "\\c"), F.lit(CLOSE))
    merged = lambda b: F.concat(opening(b), F.array_join(F.transform(b, lambda t: t["text"]), NEXT), F.lit(END))
    # Before a text stand the control strings from the end of the text before it on.
    skipped = lambda b, k, i: F.when(i > 0, len(NEXT)).otherwise(F.length(opening(b)) + F.when(k > 0, len(END)).otherwise(0))
    laid = F.flatten(
        F.transform(
            "blocks",
            lambda b, k: F.transform(b, lambda t, i: F.struct(skipped(b, k, i).alias("skip"), F.length(t["text"]).alias("take"), (t["role"] == TRAINED).alias("trained"))),
        )
    )
    told = blocked.select("conv_id", "n_turns", F.size("blocks").cast("long").alias("n_blocks"), F.array_join(F.transform("blocks", merged), "").alias("formatted"), laid.alias("laid"))
    placed = told.select("*", F.transform("laid", lambda x: x["skip"] + x["take"]).alias("sizes")).select("*", running("sizes").alias("at"))
    span = lambda x, base: F.struct((base + x["skip"]).alias("start"), (base + x["skip"] + x["take"]).alias("end"), x["trained"].alias("trained"))
    mask = F.transform(F.filter(F.zip_with("laid", "at", span), lambda m: m["trained"]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    return placed.select("conv_id", "n_turns", "n_blocks", "formatted", mask.alias("mask"))


def read_chats(chats: DataFrame) -> DataFrame:
    """From (conv_id, formatted, mask): also turns array<struct<role,text>> and loss_text, the unescaped text under the mask."""
    blocks = F.transform(
        F.split(F.expr(f"left(formatted, length(formatted) - {len(END)})"), r"<\|end\|>"),
        lambda b: F.struct(
            unescape(_put(F.regexp_extract(b, r"(?s)^<\|(.*?)\|>", 1), "\\c", CLOSE)).alias("role"),
            F.split(F.regexp_replace(b, r"(?s)^<\|.*?\|>", ""), r"<\|next\|>").alias("texts"),
        ),
    )
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text"))),
        )
    )
    # A substring is counted from the text's start, so many spans are cut from an array of its characters.
    few = F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["end"] - m["start"])))
    many = F.transform("mask", lambda m: unescape(F.array_join(F.slice("chars", m["start"] + 1, m["end"] - m["start"]), "")))
    cut = chats.select("conv_id", "formatted", "mask", turns.alias("turns"), F.when(F.size("mask") > 64, F.split("formatted", "")).alias("chars"))
    return cut.select("conv_id", "formatted", "mask", "turns", F.array_join(F.when(F.col("chars").isNull(), few).otherwise(many), "").alias("loss_text"))
