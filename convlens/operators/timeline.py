"""Bars of whole civil days over a corpus: conversations, matches and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.operators.filters import local_time


def axis(rows: DataFrame, at: str = "ended_at", want: int = 180, tz: str = "UTC") -> tuple[str, int, int] | None:
    """First civil day, days and step of the axis, from one row of the corpus; none without dated rows."""
    day = F.to_date(local_time(F.col(at), tz))
    low, days = rows.agg(F.date_format(F.min(day), "yyyy-MM-dd"), F.datediff(F.max(day), F.min(day)) + 1).first()
    return None if low is None else (low, days, -(-days // want))


def build(rows: DataFrame, at: str = "ended_at", source: str = "source", want: int = 180, tz: str = "UTC") -> DataFrame:
    """(bucket, day, source, n), every bucket with at least one row; n is 0 and source null where nothing falls."""
    spark = rows.sparkSession
    found = axis(rows, at, want, tz)
    if found is None:
        return spark.createDataFrame([], "bucket int, day string, source string, n long")
    low, days, step = found
    bars = -(-days // step)
    counts = rows.where(F.col(at).isNotNull()).groupBy(_bucket(found, at, tz).alias("bucket"), F.col(source).alias("source")).agg(F.count("*").alias("n"))
    dense = spark.range(bars).select(F.col("id").cast("int").alias("bucket"), F.date_format(F.date_add(F.lit(low).cast("date"), (F.col("id") * step).cast("int")), "yyyy-MM-dd").alias("day"))
    return dense.join(counts, "bucket", "left").select("bucket", "day", "source", F.coalesce("n", F.lit(0)).alias("n"))


def _bucket(found: tuple[str, int, int], at: str, tz: str):
    low, days, step = found
    return F.least(F.floor(F.datediff(F.to_date(local_time(F.col(at), tz)), F.lit(low).cast("date")) / step), F.lit(-(-days // step) - 1)).cast("int")


def by_query(survivors: DataFrame, hits: DataFrame, conversations: DataFrame, at: str = "ended_at", want: int = 180, tz: str = "UTC") -> DataFrame:
    """(qid, bucket, source, conversations, matches) on the axis of all conversations; bars without any are not there.

    survivors: (qid, id, source, at, inside), what each query's filters keep with its date window left out, and whether that window
    holds it; hits: (qid, id), rows that a searchable query's words match.
    """
    found = axis(conversations, at, want, tz)
    dated = survivors.where(F.col(at).isNotNull())
    if found is None:
        return dated.select("qid", F.lit(0).alias("bucket"), "source", F.lit(0).cast("long").alias("conversations"), F.lit(0).cast("long").alias("matches")).limit(0)
    own = hits.select("qid", "id", F.lit(1).alias("hit")).distinct()
    joined = dated.join(own, ["qid", "id"], "left").withColumn("bucket", _bucket(found, at, tz))
    return joined.groupBy("qid", "bucket", "source").agg(F.count("*").alias("conversations"), F.count("hit").alias("matches"))


def query_totals(survivors: DataFrame, hits: DataFrame, searchable: DataFrame, at: str = "ended_at") -> DataFrame:
    """(qid, survivors, undated, in_range, total): ``total`` is what the query selects, window and words alike; without words, in_range.

    searchable: (qid) of queries with words to search.
    """
    own = hits.select("qid", "id", F.lit(1).alias("hit")).distinct()
    asks = searchable.select("qid", F.lit(True).alias("asks")).distinct()
    joined = survivors.join(own, ["qid", "id"], "left").join(asks, "qid", "left")
    return joined.groupBy("qid").agg(
        F.count("*").alias("survivors"), F.count_if(F.col(at).isNull()).alias("undated"), F.count_if("inside").alias("in_range"),
        F.count_if(F.col("inside") & (F.col("asks").isNull() | F.col("hit").isNotNull())).alias("total"),
    )


def selected(queries: DataFrame) -> DataFrame:
    """qid, from_ms, until_ms: the intersection of positive windows; negated ones do not count.

    queries: qid, windows array<struct<from_ms,until_ms,negated>>.
    """
    positive = F.filter("windows", lambda w: ~w["negated"])
    return queries.select("qid", F.array_max(F.transform(positive, lambda w: w["from_ms"])).alias("from_ms"), F.array_min(F.transform(positive, lambda w: w["until_ms"])).alias("until_ms"))
