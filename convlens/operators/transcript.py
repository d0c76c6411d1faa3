"""Conversations read back in order: bands, runs, segments, marks and statistics."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlens.lineage import stored
from convlens.plans import search

PAUSE_MS = 4 * 3_600_000
SMALL = 64  # drawn rows of a conversation that a query looks through one by one
FEW = 8  # terms of a query that it looks up there
# How a message begins that stands for a cut-off context, and the tools that ask the user.
COMPACTED = "(?i)This session is being continued from a previous conversation that ran out of context|The summary below covers the earlier portion of the conversation"
ASK_TOOLS = "request_user_input|AskUserQuestion"


def band(role: Column, kind: Column) -> Column:
    return (
        F.when(kind == "reasoning", "reasoning")
        .when(kind.isin("tool_call", "tool_result"), "tool")
        .when(role == "user", "user")
        .otherwise("agent")
    )


def drawn(kind: Column, is_error: Column) -> Column:
    """Results of tools that went well are not drawn."""
    return ~(kind == "tool_result") | F.coalesce(is_error, F.lit(False))


def read(messages: DataFrame, off_path: bool = False) -> DataFrame:
    """position (from 0), band and drawn for messages of each conversation in reading order: main threads first, by thread and seq."""
    rows = messages if off_path else messages.where("on_head_path")
    order = Window.partitionBy("conv_id").orderBy("is_sidechain", "thread_key", "seq", "id")
    return rows.withColumn("position", F.row_number().over(order) - 1).withColumn("band", band(F.col("role"), F.col("kind"))).withColumn("drawn", drawn(F.col("kind"), F.col("is_error")))


FOLDS = {"full": ["user", "agent"], "outline": []}  # bands that stand open


def folded(blocks: DataFrame, density: str = "full") -> DataFrame:
    """blocks with fold: expanded or collapsed, as a density has it for a band where the reader has not said otherwise."""
    return blocks.withColumn("fold", F.when(F.col("band").isin(FOLDS[density]), "expanded").otherwise("collapsed"))


def marked(blocks: DataFrame, shown: DataFrame, terms: DataFrame, spans: bool = True, small: int = SMALL) -> DataFrame:
    """(qid, id, mark_kind, words[, marks]): how many words of a drawn row a query marks, and their sorted (start, end); those on kinds that no search finds are unranked.

    shown: (qid, conv_id), the conversations that are open for a query; terms: search.marking_terms. Words are found once for each term of a message.
    A query of at most ``FEW`` terms meets each message of a conversation of at most ``small`` drawn rows and looks its terms up there; the others meet by
    term the messages that hold it, so that no query costs more than ``small`` times what it marks.
    """
    drawn_rows = blocks.where("drawn").select("conv_id", "id", (F.col("kind") == "reasoning").alias("unranked"), "text")
    texts = drawn_rows.distinct()  # a repeated row is marked once
    apart = stored(search.disjoint_terms(terms), "apart")
    numbered = stored(apart.select("term", "is_prefix").distinct().withColumn("term_id", F.monotonically_increasing_id()), "terms")
    own = apart.join(numbered, ["term", "is_prefix"]).groupBy("qid").agg(F.collect_list("term_id").alias("term_ids"))
    sizes = drawn_rows.groupBy("conv_id").agg((F.count("*") > small).alias("long"))
    value = "spans" if spans else "words"
    found = stored(search.term_spans(texts, numbered, spans).select("conv_id", "id", "unranked", "term_id", value).join(sizes, "conv_id"), "found")
    pairs = stored(shown.select("qid", "conv_id").distinct().join(own, "qid").join(sizes, "conv_id").withColumn("many", F.size("term_ids") > FEW), "pairs")
    held = F.map_from_entries(F.collect_list(F.struct("term_id", value))).alias("held")  # no more than a message has words
    met = pairs.where("not long and not many").join(found.where("not long").groupBy("conv_id", "id", "unranked").agg(held), "conv_id")
    values = [F.col("held")[F.get("term_ids", F.lit(i))] for i in range(FEW)]
    words = reduce(add, [F.coalesce(F.array_size(v) if spans else v, F.lit(0)) for v in values]).cast("long").alias("words")
    laid = [F.sort_array(F.flatten(F.array_compact(F.array(*values)))).alias("marks")] if spans else []
    short = met.select("qid", "id", "unranked", words, *laid).where("words > 0")
    by_term = pairs.where("long or many").select("qid", "conv_id", F.explode("term_ids").alias("term_id")).join(found, ["conv_id", "term_id"])
    gathered = [F.sort_array(F.flatten(F.collect_list("spans"))).alias("marks")] if spans else []
    out = short.unionByName(by_term.groupBy("qid", "id", "unranked").agg(F.sum(F.array_size("spans") if spans else "words").cast("long").alias("words"), *gathered))
    return out.select("qid", "id", F.when(F.col("unranked"), "unranked").otherwise("ranked").alias("mark_kind"), *out.columns[3:])


def kind_runs(blocks: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """conv_id, run, band, n: drawn rows in reading order, equal bands in a row as one run.

    groups: (conv_id, group_id, message_offset), by which conversations are read on as one, whose id then stands for theirs.
    """
    if groups is not None:
        read_on = blocks.join(groups.select("conv_id", "group_id", "message_offset"), "conv_id")
        blocks = read_on.withColumn("conv_id", F.col("group_id")).withColumn("position", F.col("position") + F.col("message_offset"))
    w = Window.partitionBy("conv_id").orderBy("position")
    flagged = blocks.where("drawn").withColumn("new", F.when(F.lag("band").over(w).eqNullSafe(F.col("band")), 0).otherwise(1))
    return flagged.withColumn("run", F.sum("new").over(w)).groupBy("conv_id", "run", "band").agg(F.count("*").alias("n"))


def summary(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("conv_id").agg(F.countDistinct("thread_key").alias("threads"), F.count("*").alias("total"), F.count_if("drawn").alias("drawn"))


def numbered(blocks: DataFrame) -> DataFrame:
    """blocks with segment (from 1), which a user's row or another thread begins, and the silence before each row."""
    w = Window.partitionBy("conv_id").orderBy("position")
    new = (F.col("band") == "user") | ~F.lag("thread_key").over(w).eqNullSafe(F.col("thread_key"))
    silence = F.col("ts_ms") - F.lag("ts_ms").over(w)
    return blocks.withColumn("new", new.cast("int")).withColumn("silence", silence).withColumn("segment", F.sum("new").over(w)).drop("new")


def segment_matches(blocks: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, conv_id, segment, matches): how many messages of a segment a query matches. hits: (qid, msg_id)."""
    placed = numbered(blocks).select(F.col("id").alias("msg_id"), "conv_id", "segment")
    return hits.select("qid", "msg_id").join(placed, "msg_id").groupBy("qid", "conv_id", "segment").agg(F.count("*").alias("matches"))


def segments(blocks: DataFrame) -> DataFrame:
    """Per segment: calls, failures, questions and the silence before it."""
    question = (F.col("band") == "agent") & F.rtrim("text").endswith("?")
    return numbered(blocks).groupBy("conv_id", "segment").agg(
        F.count("*").alias("messages"),
        F.count_if(F.col("kind") == "tool_call").alias("calls"),
        F.count_if("is_error").alias("failures"),
        F.count_if(question).alias("questions"),
        F.min_by("silence", "position").alias("silence_before"),
    )


def annotate(blocks: DataFrame, pause_ms: int = PAUSE_MS) -> DataFrame:
    """pause: silence beyond pause_ms since the last dated message; question: an agent's prose that ends in '?', or a call of a tool that asks the user,
    whose name is the text's first line; compacted: the text says that what went before was cut off."""
    before = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("ts_ms") - F.last("ts_ms", ignorenulls=True).over(before)
    text = F.coalesce("text", F.lit(""))
    asks = ((F.col("band") == "agent") & F.rtrim(text).endswith("?")) | ((F.col("kind") == "tool_call") & F.substring_index(text, "\n", 1).rlike(ASK_TOOLS))
    return blocks.withColumn("pause", F.coalesce(gap > pause_ms, F.lit(False))).withColumn("question", asks).withColumn("compacted", text.rlike(COMPACTED))


def downsample(blocks: DataFrame, width: int, rule: str = "priority") -> DataFrame:
    """At most ``width`` cells of equal count: band by priority (prose, reasoning, tool) or majority, and the largest log length.

    Where blocks have ``match`` or ``compacted``, a cell has it if any of its messages has.
    """
    flags = [F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in ("match", "compacted") if c in blocks.columns]
    sized = blocks.withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    cell = F.floor(F.col("position") * F.least("n", F.lit(width)) / F.col("n")).cast("int")
    rank = F.when(F.col("band").isin("user", "agent"), 3).when(F.col("band") == "reasoning", 2).otherwise(1)
    celled = sized.withColumn("cell", cell).withColumn("size", F.log10(F.length("text") + 1))
    if rule == "majority":
        votes = celled.groupBy("conv_id", "cell", "band").agg(F.count("*").alias("votes"), F.max("size").alias("size"), *flags)
        return votes.groupBy("conv_id", "cell").agg(F.max_by("band", F.struct("votes", "band")).alias("band"), F.max("size").alias("size"), *flags)
    return celled.groupBy("conv_id", "cell").agg(F.max_by("band", F.struct(rank, -F.col("position"))).alias("band"), F.max("size").alias("size"), *flags)
