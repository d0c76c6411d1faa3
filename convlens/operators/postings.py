"""Postings: words of messages by field, with counts, places and the statistics that ranking needs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlens.functions.stem import porter
from convlens.functions.text import tokenize
from convlens.operators.model import clip_tool_text, field_of


def words(messages: DataFrame) -> DataFrame:
    """(field, msg_id, position, term), reasoning and empty tool text left out, tool text clipped."""
    told = clip_tool_text(messages).withColumn("field", field_of(F.col("kind"), F.col("text"))).where("field is not null")
    return told.select("field", F.col("id").alias("msg_id"), F.posexplode(tokenize(F.col("text"))).alias("position", "term"))


def stem_terms(placed: DataFrame) -> DataFrame:
    """Terms stemmed; only the distinct vocabulary passes through Python."""

    @F.pandas_udf(T.StringType())
    def stem(terms: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in terms:
            yield some.map(porter)

    vocabulary = placed.select("term").distinct().withColumn("stemmed", stem("term"))
    return placed.join(vocabulary, "term").withColumn("term", F.col("stemmed")).drop("stemmed")


def build(messages: DataFrame, stemmed: bool = False) -> DataFrame:
    """(field, term, msg_id, tf, positions): one row for each term of a message."""
    placed = stem_terms(words(messages)) if stemmed else words(messages)
    return placed.groupBy("field", "term", "msg_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))


def doc_stats(postings: DataFrame) -> DataFrame:
    """(field, msg_id, length)"""
    return postings.groupBy("field", "msg_id").agg(F.sum("tf").alias("length"))


def term_stats(postings: DataFrame) -> DataFrame:
    """(field, term, df, cf)"""
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def field_stats(postings: DataFrame) -> DataFrame:
    """(field, messages, average_length)"""
    return doc_stats(postings).groupBy("field").agg(F.count("*").alias("messages"), F.avg("length").alias("average_length"))


def write(postings: DataFrame, path: str) -> None:
    """One folder per field, in ranges of (term, message): a common term goes to several tasks and files, and files lie in order of term."""
    postings.repartitionByRange("field", "term", "msg_id").sortWithinPartitions("field", "term", "msg_id").write.mode("overwrite").partitionBy("field").parquet(path)
