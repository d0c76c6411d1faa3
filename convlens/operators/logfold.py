"""Search logs folded into needs: keystrokes absorbed, driven spans left out, picks counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNREAD_MS = 2_000
DAY_MS = 86_400_000


def merge_spans(spans: DataFrame, day_ms: int = DAY_MS) -> tuple[DataFrame, DataFrame]:
    """The union of half-open spans (from_ms, until_ms): (day) covered as a whole, and (day, from_ms, until_ms), disjoint, for the others.

    A span is told apart into the days that it covers and the pieces of days at its ends. Whole days come from a running count of
    spans that begin and end, over no more rows than there are days with such an edge; a day's pieces are merged by a running
    maximum of their ends, after those of one beginning became one.
    """
    real = spans.where("until_ms > from_ms").select(F.col("from_ms").cast("long"), F.col("until_ms").cast("long"))
    first, past = F.ceil(F.col("from_ms") / day_ms).cast("long"), F.floor(F.col("until_ms") / day_ms).cast("long")  # whole days, the end exclusive
    cut = real.withColumn("first", first).withColumn("past", past)
    edges = cut.where("past > first").select(F.explode(F.array(F.struct(F.col("first").alias("day"), F.lit(1).alias("step")), F.struct(F.col("past").alias("day"), F.lit(-1).alias("step")))).alias("e"))
    steps = edges.select("e.*").groupBy("day").agg(F.sum("step").alias("step"))
    by_day = Window.orderBy("day")  # a row for each day on which spans begin or end
    open_ = steps.withColumn("open", F.sum("step").over(by_day)).withColumn("next", F.lead("day").over(by_day)).where("open > 0")
    whole = open_.select(F.explode(F.sequence("day", F.col("next") - 1)).alias("day"))
    # What is left of a span before its first whole day and behind its last; a span within one day is one piece.
    inside = F.col("past") < F.col("first")
    at = lambda lo, hi: F.struct(F.floor(lo / day_ms).cast("long").alias("day"), lo.alias("from_ms"), hi.alias("until_ms"))
    pieces = F.when(inside, F.array(at(F.col("from_ms"), F.col("until_ms")))).otherwise(
        F.array(at(F.col("from_ms"), F.col("first") * day_ms), at(F.col("past") * day_ms, F.col("until_ms")))
    )
    parts = cut.select(F.explode(pieces).alias("p")).select("p.*").where("until_ms > from_ms").groupBy("day", "from_ms").agg(F.max("until_ms").alias("until_ms"))
    parts = parts.join(whole, "day", "left_anti")
    w = Window.partitionBy("day").orderBy("from_ms")
    before = F.max("until_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = parts.withColumn("new", F.when(F.col("from_ms") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return whole, marked.groupBy("day", "run").agg(F.min("from_ms").alias("from_ms"), F.max("until_ms").alias("until_ms")).drop("run")


def exclude_spans(log: DataFrame, spans: DataFrame, day_ms: int = DAY_MS) -> DataFrame:
    """Events outside all half-open spans (from_ms, until_ms), by equi-joins on the day with the spans' union. Undated events stay."""
    whole, pieces = merge_spans(spans, day_ms)
    own = log.withColumn("__day", F.floor(F.col("ts_ms") / day_ms).cast("long"))
    left = own.join(whole.withColumnRenamed("day", "__day"), "__day", "left_anti")
    on = (left["__day"] == pieces["day"]) & (left["ts_ms"] >= pieces["from_ms"]) & (left["ts_ms"] < pieces["until_ms"])
    return left.join(pieces, on, "left_anti").select(*log.columns)


def absorb(searches: DataFrame, keys: list[str], unread_ms: int = UNREAD_MS, tie: str = "id") -> DataFrame:
    """searches with ``absorbed``: the next event by time follows soon, under the same source filter, and goes on with this text.

    kind may be 'search' or 'pick'; picks are never absorbed, and a blank text never is.
    """
    w = Window.partitionBy(*keys).orderBy("ts_ms", tie)
    after = lambda c: F.lead(c).over(w)
    kind = F.col("kind") if "kind" in searches.columns else F.lit("search")
    soon = after("ts_ms") - F.col("ts_ms") <= unread_ms
    goes_on = after("q").startswith(F.col("q")) & (F.trim("q") != "")
    return searches.withColumn("absorbed", F.coalesce((kind == "search") & soon & after("source").eqNullSafe(F.col("source")) & goes_on, F.lit(False)))


def pick_rank(picks: DataFrame) -> DataFrame:
    """rank of conv_id in the shown list, from 1; null where it was not shown."""
    return picks.withColumn("rank", F.nullif(F.array_position("shown", F.col("conv_id")), F.lit(0)))


def needs(kept: DataFrame) -> DataFrame:
    """Per text: searches, last_ts, and picks as 'id×count' by count, then id; busiest needs first by place."""
    told = kept.where(F.trim(F.coalesce("q", F.lit(""))) != "")
    base = told.groupBy("q").agg(F.count_if(F.col("kind") == "search").alias("searches"), F.max("ts_ms").alias("last_ts"))
    picked = told.where("kind = 'pick'").groupBy("q", "conv_id").agg(F.count("*").alias("n"))
    listed = picked.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("conv_id")))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["conv_id"].cast("string"), F.lit("×"), (-x["n"]).cast("string"))), ",")
    return base.join(listed, "q", "left").select("q", "searches", "last_ts", F.coalesce(text, F.lit("")).alias("picks"))


def fold_totals(log: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: events, absorbed keystrokes, events in driven spans, browsed (blank) ones."""
    return kept.agg(F.count("*").alias("kept"), F.count_if("absorbed").alias("keystrokes"), F.count_if(F.trim(F.coalesce("q", F.lit(""))) == "").alias("browsed")).crossJoin(
        log.agg(F.count("*").alias("events"))
    ).withColumn("driven", F.col("events") - F.col("kept"))


def need_ranks(kept: DataFrame) -> DataFrame:
    """(q, conv_id, picks, ranks): of each need's picks how many there were, and the places at which the shown ones stood, in order.

    kept: events with kind, q, conv_id and ``shown``, the list that was on the screen.
    """
    picks = pick_rank(kept.where((F.col("kind") == "pick") & (F.trim(F.coalesce("q", F.lit(""))) != "")))
    return picks.groupBy("q", "conv_id").agg(F.count("*").alias("picks"), F.sort_array(F.collect_list("rank")).alias("ranks"))


def summary(log: DataFrame, spans: DataFrame, marked: DataFrame) -> DataFrame:
    """One row: what the fold gives and what it set aside. marked: events outside the driven spans, with ``absorbed``.

    searches in needs, judgements (texts and conversations picked for them, each once), answered (needs with a pick), keystrokes, driven, spans, browsed.
    """
    blank = F.trim(F.coalesce("q", F.lit(""))) == ""
    told = ~F.col("absorbed") & ~blank
    pick = F.when(told & (F.col("kind") == "pick"), F.struct("q", "conv_id"))
    counts = marked.agg(
        F.countDistinct(F.when(told, F.col("q"))).alias("needs"), F.countDistinct(pick).alias("judgements"), F.countDistinct(pick["q"]).alias("answered"),
        F.count_if("absorbed").alias("keystrokes"), F.count_if(blank).alias("browsed"), F.count("*").alias("kept"),
    )
    every = log.agg(F.count("*").alias("events")).crossJoin(spans.agg(F.count("*").alias("spans")))  # one row each
    return counts.crossJoin(every).select("needs", "judgements", "answered", "keystrokes", "browsed", (F.col("events") - F.col("kept")).alias("driven"), "spans")


def run(log: DataFrame, spans: DataFrame, keys: list[str], unread_ms: int = UNREAD_MS) -> DataFrame:
    """The whole fold: spans out, keystrokes absorbed, needs counted."""
    marked = absorb(exclude_spans(log, spans), keys, unread_ms)
    return needs(marked.where("not absorbed"))
