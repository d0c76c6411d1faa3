"""Counts of the whole corpus beside the state that a query's filters give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlens.operators import filters


def source_census(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("source").agg(F.count("*").alias("conversations"))


def source_coverage(conversations: DataFrame, configured: DataFrame) -> DataFrame:
    """Every source that is watched or present, with counts and a state; the side that misses counts as none."""
    joined = source_census(conversations).join(configured.select("source", F.lit(True).alias("watched")), "source", "full_outer")
    filled = joined.select("source", F.coalesce("conversations", F.lit(0)).alias("conversations"), F.coalesce("watched", F.lit(False)).alias("watched"))
    state = F.when(F.col("watched") & (F.col("conversations") > 0), "covered").when(F.col("watched"), "empty").otherwise("unwatched")
    return filled.withColumn("state", state)


def dir_census(conversations: DataFrame, limit: int | None = None) -> DataFrame:
    """Directories, busiest first, ties by name."""
    counts = conversations.where(F.coalesce("cwd", F.lit("")) != "").groupBy("cwd").agg(F.count("*").alias("conversations"))
    ordered = counts.orderBy(F.desc("conversations"), "cwd")
    return ordered if limit is None else ordered.limit(limit)


def dir_totals(conversations: DataFrame) -> DataFrame:
    named = F.nullif(F.col("cwd"), F.lit(""))
    return conversations.agg(F.countDistinct(named).alias("dirs"), F.count_if(named.isNull()).alias("without"))


def date_census(conversations: DataFrame, now_ms: int, tz: str = "UTC") -> DataFrame:
    """Today, the last 7 days, the last month and older than that, counted in one pass; spans overlap."""
    now = F.lit(now_ms).cast("long")
    edges = {"today": filters.day_start(now, tz), "week": filters.shift_days(now, F.lit(-7), tz), "month": filters.shift_months(now, F.lit(-1), tz)}
    at = F.col("ended_at")
    counts = conversations.agg(
        F.count_if((at >= edges["today"]) & (at < filters.shift_days(edges["today"], F.lit(1), tz))).alias("today"),
        F.count_if(at >= edges["week"]).alias("week"),
        F.count_if(at >= edges["month"]).alias("month"),
        F.count_if(at < edges["month"]).alias("older"),
    )
    return counts.selectExpr("stack(4, 'today', today, 'week', week, 'month', month, 'older', older) as (span, conversations)")


def rail(queries: DataFrame, census: DataFrame, value: str, most: int | None = None) -> DataFrame:
    """(qid, value, conversations, state) for each query and value: include, exclude (it wins) or off.

    queries: qid, include array<string>, exclude array<string>. A facet selects as its filter does: directories (``cwd``) that
    contain what is asked for, other values that equal it in lower case. A rail shows every value of its census, or the ``most`` frequent ones,
    ties by name; sources are as many as there are readers, and directories are limited by their caller.
    """
    selects = (lambda x: F.lower(F.col(value)).contains(F.lower(x))) if value == "cwd" else (lambda x: F.col(value) == F.lower(x))
    has = lambda side: F.exists(side, selects)
    state = F.when(has("exclude"), "exclude").when(has("include"), "include").otherwise("off")
    shown = census if most is None else F.broadcast(census.orderBy(F.desc("conversations"), value).limit(most))
    return queries.crossJoin(shown).select("qid", value, "conversations", state.alias("state"))


def directory_rail(queries: DataFrame, conversations: DataFrame, most: int = 12) -> DataFrame:
    """(qid, cwd, conversations, state) of the busiest directories."""
    return rail(queries, dir_census(conversations), "cwd", most)


def date_rail(queries: DataFrame, conversations: DataFrame, now_ms: int, tz: str = "UTC") -> DataFrame:
    """(qid, span, conversations, state) of the four spans of the date census; a span is on where a query names it."""
    return rail(queries, date_census(conversations, now_ms, tz), "span")


def composition(sets: DataFrame) -> DataFrame:
    """(set_id, source, n, place): sources of each set, largest first."""
    counts = sets.groupBy("set_id", "source").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("n"), "source")))
