"""The synthetic tables seen as conversations, messages, logs and queries, in Spark and in the same words in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START_MS = 1704067200000  # 2024-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DAG with edit branches, five kinds in turn, and a subagent thread of every fourth turn."""
    t, c = F.col("turn"), F.col("conv_id")
    k = (c + t) % 5
    kind = F.when(k <= 1, "prose").when(k == 2, "tool_call").when(k == 3, "tool_result").otherwise("reasoning")
    parent = t - F.when(t % 3 == 2, 2).otherwise(1)
    at = lambda x: F.concat_ws(":", c.cast("string"), x.cast("string"))
    return table(spark, sf_dir, "conversations").select(
        at(t).alias("id"),
        c.alias("conv_id"),
        F.when(parent >= 0, at(parent)).alias("parent_id"),
        F.when(t % 4 == 3, "sub").otherwise("main").alias("thread_key"),
        (t % 4 == 3).alias("is_sidechain"),
        t.cast("int").alias("seq"),
        "role",
        kind.alias("kind"),
        (F.lit(START_MS) + c * 21600000 + t * 60000).alias("ts_ms"),
        ((k == 3) & (t % 2 == 0)).alias("is_error"),
        F.when((F.col("role") == "assistant") & (t % 3 != 0), F.concat(F.lit("model-"), (t % 3).cast("string"))).alias("model"),
        (t % 7 != 5).alias("on_head_path"),
        "text",
    )


MESSAGES = f"""messages AS (
    SELECT conv_id || ':' || turn AS id, conv_id,
        CASE WHEN turn - CASE WHEN turn % 3 = 2 THEN 2 ELSE 1 END >= 0 THEN conv_id || ':' || (turn - CASE WHEN turn % 3 = 2 THEN 2 ELSE 1 END) END AS parent_id,
        CASE WHEN turn % 4 = 3 THEN 'sub' ELSE 'main' END AS thread_key, turn % 4 = 3 AS is_sidechain, turn::INT AS seq, role,
        CASE WHEN (conv_id + turn) % 5 <= 1 THEN 'prose' WHEN (conv_id + turn) % 5 = 2 THEN 'tool_call'
             WHEN (conv_id + turn) % 5 = 3 THEN 'tool_result' ELSE 'reasoning' END AS kind,
        {START_MS} + conv_id * 21600000 + turn * 60000 AS ts_ms, ((conv_id + turn) % 5 = 3 AND turn % 2 = 0) AS is_error,
        CASE WHEN role = 'assistant' AND turn % 3 <> 0 THEN 'model-' || (turn % 3) END AS model, turn % 7 <> 5 AS on_head_path, text
    FROM conversations)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as conversations of one message: id, source, cwd (by language), ended_at an hour apart; every 11th undated."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("id"), d.alias("conv_id"), "source", F.when(d % 9 != 0, F.concat(F.lit("/Home/"), "lang", F.lit("/p"), (d % 13).cast("string"))).alias("cwd"),
        F.when(d % 11 != 0, F.lit(START_MS) + d * 3600000).alias("ended_at"), "text", "n_chars",
    )


DOCUMENTS = f"""docs AS (
    SELECT doc_id AS id, doc_id AS conv_id, source, CASE WHEN doc_id % 9 <> 0 THEN '/Home/' || lang || '/p' || (doc_id % 13) END AS cwd,
        CASE WHEN doc_id % 11 <> 0 THEN {START_MS} + doc_id * 3600000 END AS ended_at, text, n_chars FROM documents)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: id, user_id, source, ts_ms, q (a growing prefix)."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("id"), "user_id", F.col("event_type").alias("source"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.substring(F.lit("search"), F.lit(1), (e % 7).cast("int")).alias("q"), "value",
    )


LOG = """log AS (
    SELECT event_id AS id, user_id, event_type AS source, epoch_us(ts) // 1000 AS ts_ms, substring('search', 1, (event_id % 7)::INT) AS q, value FROM events)"""
