"""Rankings scored against graded judgements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_grades(judgements: DataFrame, order: list[str]) -> DataFrame:
    """One grade per (qid, conv_id): the last by the given order; grades out of 0..3 are no judgements."""
    return judgements.where("grade between 0 and 3").groupBy("qid", "conv_id").agg(F.max_by("grade", F.struct(*order)).alias("grade"))


def dangling(grades: DataFrame, conversations: DataFrame) -> DataFrame:
    return grades.join(conversations.select(F.col("id").alias("conv_id")), "conv_id", "left_anti")


def score(results: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """Per query: ndcg (null where no known grade gains), rr, exact1, hit1, hit5, shown, unjudged, missed.

    results: qid, rank (from 1), conv_id; the ideal comes from all known grades, cut at k.
    """
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    shown = results.where(F.col("rank") <= k).join(grades, ["qid", "conv_id"], "left")
    g = F.coalesce("grade", F.lit(0))
    own = shown.groupBy("qid").agg(
        F.sum(gain(g, F.col("rank"))).alias("dcg"),
        F.coalesce(F.max(F.when(g >= 2, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.coalesce(F.max(F.when(F.col("rank") == 1, g == 3)), F.lit(False)).alias("exact1"),
        F.coalesce(F.max(F.when(F.col("rank") == 1, g >= 2)), F.lit(False)).alias("hit1"),
        F.coalesce(F.max(F.when(F.col("rank") <= 5, g >= 2)), F.lit(False)).alias("hit5"),
        F.count("*").alias("shown"),
        F.count_if(F.col("grade").isNull()).alias("unjudged"),
    )
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "conv_id"))
    ideal = grades.withColumn("r", place).where(F.col("r") <= k).groupBy("qid").agg(F.sum(gain(F.col("grade"), F.col("r"))).alias("ideal"))
    lost = grades.where("grade >= 2").join(results.select("qid", "conv_id"), ["qid", "conv_id"], "left_anti").groupBy("qid").agg(F.count("*").alias("missed"))
    joined = own.join(ideal, "qid", "left").join(lost, "qid", "left")
    return joined.select("qid", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).alias("ndcg"), "rr", "exact1", "hit1", "hit5", "shown", "unjudged", F.coalesce("missed", F.lit(0)).alias("missed"))


def report(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over scorable queries (ndcg) and over all (a miss counts 0), and the share of shown rows that were judged."""
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return scores.groupBy(*(by or [])).agg(
        F.avg("ndcg").alias("mean_ndcg"), F.avg("rr").alias("mrr"), mean("hit1").alias("success1"), mean("hit5").alias("success5"), mean("exact1").alias("exact1"),
        F.count("ndcg").alias("scored"), F.count_if(F.col("ndcg").isNull()).alias("unscorable"),
        F.when(F.sum("shown") > 0, 1 - F.sum("unjudged") / F.sum("shown")).otherwise(1.0).alias("coverage"),
    )


def pool(variants: dict[str, DataFrame], k: int) -> DataFrame:
    """(qid, conv_id, variant): the union of several rankers' first k, each named by the first variant that has it."""
    each = [v.where(F.col("rank") <= k).select("qid", "conv_id", F.lit(i).alias("no"), F.lit(name).alias("variant")) for i, (name, v) in enumerate(variants.items())]
    return reduce(DataFrame.unionByName, each).groupBy("qid", "conv_id").agg(F.min_by("variant", "no").alias("variant"))


def pool_order(pooled: DataFrame, conversations: DataFrame, at: str = "ended_at") -> DataFrame:
    """pooled with ``place`` from 1 within a query: newest conversation first, undated ones last, ties by id."""
    dated = pooled.join(conversations.select(F.col("id").alias("conv_id"), F.col(at).alias("__at")), "conv_id", "left")
    return dated.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc_nulls_last("__at"), "conv_id"))).drop("__at")


def sweep(scored: DataFrame, grid: DataFrame, now_ms: int, grades: DataFrame, k: int = 10) -> DataFrame:
    """Reports over a small grid (decay, repeat_weight) in one job. scored: qid, conv_id, score, ts_ms, one row per matching message."""
    rows = scored.crossJoin(F.broadcast(grid))  # the grid is a handful of settings
    age = F.greatest(F.lit(0), F.lit(now_ms) - F.coalesce("ts_ms", F.lit(now_ms))) / (365 * 86_400_000)
    rows = rows.withColumn("s", F.col("score") / (1 + F.col("decay") * age))
    best, total = F.min("s"), F.sum("s")
    grouped = rows.groupBy("decay", "repeat_weight", "qid", "conv_id").agg((best + F.first("repeat_weight") * (total - best)).alias("s"))
    w = Window.partitionBy("decay", "repeat_weight", "qid").orderBy("s", "conv_id")
    top = grouped.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    named = top.select(F.concat_ws("|", "decay", "repeat_weight", "qid").alias("qid"), "rank", "conv_id", "decay", "repeat_weight")
    keys = named.select("qid", "decay", "repeat_weight").distinct()
    wide = grades.join(keys.select("qid", F.element_at(F.split("qid", r"\|"), 3).alias("own")), F.col("own") == grades["qid"].cast("string")).select(keys["qid"], "conv_id", "grade")
    return report(score(named.select("qid", "rank", "conv_id"), wide, k).join(keys, "qid"), ["decay", "repeat_weight"])
