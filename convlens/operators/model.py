"""The two normalized tables: merging what files repeat, rolling messages up, and walking the message DAG.

message: id, conv_id, parent_id, thread_key, is_sidechain, seq, role, kind, ts_ms, on_head_path, is_error, model, text.
conversation: id, source, native_id, title, title_origin, cwd, git_branch, model, surface, started_at, ended_at,
msg_count, prose_count, user_turns, thread_count, forked_from, head_id, deleted_upstream_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlens.functions.text import clip_bytes
from convlens.lineage import stored

TOOL_CLIP = 1024


def field_of(kind: Column, text: Column) -> Column:
    """Which postings a message belongs to: 'prose', 'tools' or none."""
    return F.when(kind == "prose", "prose").when(kind.isin("tool_call", "tool_result") & (F.coalesce(text, F.lit("")) != ""), "tools")


def clip_tool_text(messages: DataFrame, n: int = TOOL_CLIP) -> DataFrame:
    tool = F.col("kind").isin("tool_call", "tool_result")
    return messages.withColumn("text", F.when(tool, clip_bytes(F.col("text"), n)).otherwise(F.col("text")))


def merge_messages(messages: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """The first row per id in the given order, with ``copies``, the number of rows that had the id."""
    w = Window.partitionBy(key)
    numbered = messages.withColumn("__n", F.row_number().over(w.orderBy(*order))).withColumn("copies", F.count("*").over(w))
    return numbered.where("__n = 1").drop("__n")


def merge_conversations(rows: DataFrame, order: list[str], columns: list[str], key: str = "id") -> DataFrame:
    """One row per id; each column is its first non-null value in the given order, whatever row that stands in."""
    place = F.struct(*order)
    return rows.groupBy(key).agg(*[F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])


def titles(rows: DataFrame) -> DataFrame:
    """title and title_origin from the candidates custom, generated, first_user."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    origin = F.when(blank("custom").isNotNull(), "custom").when(blank("generated").isNotNull(), "generated").when(blank("first_user").isNotNull(), "first_user")
    return rows.withColumn("title", F.coalesce(blank("custom"), blank("generated"), blank("first_user"))).withColumn("title_origin", origin)


def rollup(messages: DataFrame) -> DataFrame:
    """Counts, span and last declared model of every conversation."""
    prose = F.col("kind") == "prose"
    named = F.when(F.col("model").isNotNull(), F.struct(F.coalesce("ts_ms", F.lit(-(2**63))).alias("ts"), F.col("seq"), F.col("id")))
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("msg_count"),
        F.count_if(prose).alias("prose_count"),
        F.count_if(prose & (F.col("role") == "user")).alias("user_turns"),
        F.countDistinct("thread_key").alias("thread_count"),
        F.min("ts_ms").alias("started_at"),
        F.max("ts_ms").alias("ended_at"),
        F.max_by("model", named).alias("model"),
    )


def build_report(messages: DataFrame, configured: DataFrame) -> DataFrame:
    """Per source: conversations, messages, prose, duplicates, bytes; configured sources without rows are told so."""
    seen = messages.groupBy("source").agg(
        F.countDistinct("conv_id").alias("conversations"),
        F.count("*").alias("messages"),
        F.count_if(F.col("kind") == "prose").alias("prose"),
        (F.count("*") - F.countDistinct("id")).alias("duplicates"),
        F.sum(F.octet_length("text")).cast("long").alias("text_bytes"),
    )
    joined = seen.join(configured.select("source", F.lit(True).alias("configured")), "source", "full_outer")
    zero = {c: 0 for c in ("conversations", "messages", "prose", "duplicates", "text_bytes")}
    reason = F.when(F.col("messages") > 0, "ok").otherwise("no rows")
    return joined.fillna(zero).withColumn("reason", reason).withColumn("configured", F.coalesce("configured", F.lit(False)))


# --- the DAG --------------------------------------------------------------------------------------------------------


def ancestors_of(edges: DataFrame, marked: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id) of ``marked`` and everything above. edges: (id, parent_id), one parent each.

    Pointer jumping: a round marks what lies 2^k steps above the marked, then doubles the pointers; depth d takes about
    log2(d) rounds, and each is written out.
    """
    up = stored(edges.where("parent_id is not null").select("id", F.col("parent_id").alias("up")), "up")
    found = stored(marked.select("id").distinct(), "marked")
    for _ in range(most_rounds):
        if up.isEmpty():
            return found
        found = stored(found.union(found.join(up, "id").select(F.col("up").alias("id"))).distinct(), "marked")
        up = stored(up.join(up.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")), "up")
    raise ValueError("the parent links hold a cycle")


def head_path(messages: DataFrame, heads: DataFrame | None = None, file: str | None = None) -> DataFrame:
    """messages with on_head_path: on the way up from the last message of a thread, or from the declared head in its thread.

    heads: (conv_id, head_id). ``file`` names a column that walks must not leave, where conversations come from several files.
    """
    scope = ["conv_id", *([file] if file else [])]
    threads = [*scope, "thread_key"]
    last = messages.groupBy(*threads).agg(F.max_by("id", F.struct("seq", F.lit(0))).alias("plain"), F.max("seq").alias("seq"))
    ties = messages.join(last.select(*threads, "seq"), [*threads, "seq"]).groupBy(*threads).agg(F.min("id").alias("leaf"))
    if heads is not None:
        declared = messages.join(heads.select("conv_id", F.col("head_id").alias("id")), ["conv_id", "id"]).groupBy(*threads).agg(F.min("id").alias("head"))
        ties = ties.join(declared, threads, "left").withColumn("leaf", F.coalesce("head", "leaf"))
    known = messages.select(*scope, F.col("id").alias("parent_id"))
    edges = messages.select(*scope, "id", "parent_id").join(known, [*scope, "parent_id"])
    on = ancestors_of(edges, ties.select(F.col("leaf").alias("id"))).withColumn("on_head_path", F.lit(True))
    return messages.drop("on_head_path").join(on, "id", "left").fillna({"on_head_path": False})


def reparent(nodes: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Emitted nodes with the nearest emitted ancestor as parent. nodes: id, parent_id, emitted."""
    emitted = nodes.where("emitted").select(F.col("id").alias("parent_id"))
    open_ = nodes.select("id", "parent_id", "emitted")
    skipped = stored(open_.where("not emitted").select(F.col("id").alias("parent_id"), F.col("parent_id").alias("next")), "skipped")
    current = stored(open_.where("emitted").select("id", "parent_id"), "nodes")
    for _ in range(most_rounds):
        # Every skipped parent gives way to what its link names; links over skipped nodes double each round.
        hop = skipped.withColumn("hit", F.lit(True))
        moved = current.join(hop, "parent_id", "left").select("id", F.when(F.col("hit"), F.col("next")).otherwise(F.col("parent_id")).alias("parent_id"))
        current = stored(moved, "nodes")
        if current.join(skipped, "parent_id", "left_semi").isEmpty():
            break
        after = skipped.select(F.col("parent_id").alias("next"), F.col("next").alias("after"), F.lit(True).alias("hit"))
        skipped = stored(skipped.join(after, "next", "left").select("parent_id", F.when(F.col("hit"), F.col("after")).otherwise(F.col("next")).alias("next")), "skipped")
    else:
        raise ValueError("the parent links hold a cycle")
    known = emitted.withColumn("known", F.lit(True))
    return current.join(known, "parent_id", "left").select("id", F.when(F.col("known"), F.col("parent_id")).alias("parent_id"))


def fork_tree(conversations: DataFrame, most_rounds: int = 64) -> DataFrame:
    """id, root, depth, family (size) along forked_from links; a link to an unknown conversation is none. A cycle of links is an error.

    Each round halves the way up, so whoever still has one after more rounds than a way of all conversations takes is on a cycle."""
    known = conversations.select(F.col("id").alias("forked_from"), F.lit(True).alias("known"))
    linked = conversations.select("id", "forked_from").join(known, "forked_from", "left")
    state = stored(linked.select("id", F.when(F.col("known"), F.col("forked_from")).alias("up")).withColumn("top", F.coalesce("up", "id")).withColumn("depth", F.col("up").isNotNull().cast("int")), "forks")
    rounds, most = 0, min(most_rounds, state.count().bit_length() + 1)
    while not state.where("up is not null").isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("depth").alias("depth2"))
        jumped = state.join(above, "up", "left")
        state = stored(jumped.select("id", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth")), "forks")
        if (rounds := rounds + 1) > most and not state.where("up is not null").isEmpty():
            raise ValueError("the fork links hold a cycle")
    return state.select("id", F.col("top").alias("root"), "depth").withColumn("family", F.count("*").over(Window.partitionBy("root")))


def branch_census(messages: DataFrame) -> DataFrame:
    """Of the whole table: nodes with several children, conversations that hold them, and messages off the head path."""
    forks = messages.where("parent_id is not null").groupBy("conv_id", "parent_id").count().where("count > 1")
    nodes = forks.agg(F.count("*").alias("branch_nodes"), F.countDistinct("conv_id").alias("branched_conversations"))
    return nodes.crossJoin(messages.agg(F.count_if(~F.col("on_head_path")).alias("off_path")))  # one row by one row
