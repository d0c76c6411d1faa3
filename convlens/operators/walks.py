"""Depth-first order of many forests at once, by joins that double their reach, whatever the size of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlens.lineage import stored


def cut_cycles(placed: DataFrame, scope: str) -> DataFrame:
    """placed (scope, node, up, ord) with ``up`` null where a walk begins: at nodes whose parent is unknown, and, among those that
    no such node leads to, at each that is smaller than all it descends from, round its cycle. began: 0, 1 or null.

    Ways up are halved each round, and the least node on the way is carried along. As long as a way ends, its nodes end one
    after the other, so a round that ends none has left only those on cycles or below them.
    """
    known = placed.select(scope, F.col("node").alias("up"), F.lit(True).alias("known"))
    linked = placed.join(known, [scope, "up"], "left").select(scope, "node", F.when(F.col("known"), F.col("up")).alias("up"), "ord")
    linked = stored(linked, "linked")
    state = linked.where("up is not null").select(scope, "node", F.col("up").alias("to"), F.col("up").alias("least"))
    state, left = stored(state, "ways"), None
    while (now := state.count()) and now != left:
        left = now
        state = stored(_halved(state, scope, keep_ended=False), "ways")
    if now:
        # Only cycles and what hangs from them: the way must go round once more than there are nodes.
        largest, reach = state.groupBy(scope).count().agg(F.max("count")).first()[0], 1
        state = stored(linked.join(state.select(scope, "node"), [scope, "node"], "left_semi").select(scope, "node", F.col("up").alias("to"), F.col("up").alias("least")), "ways")
        while reach <= largest:
            state, reach = stored(_halved(state, scope, keep_ended=True), "ways"), 2 * reach
    begins = state.where(F.col("node") <= F.col("least")).select(scope, "node", F.lit(True).alias("begins"))
    joined = linked.join(begins, [scope, "node"], "left")
    began = F.when(F.col("begins"), 1).when(F.col("up").isNull(), 0)
    return joined.select(scope, "node", F.when(began.isNull(), F.col("up")).alias("up"), F.when(began.isNull(), F.coalesce("ord", F.lit(0))).alias("ord"), began.alias("began"))


def _halved(state: DataFrame, scope: str, keep_ended: bool) -> DataFrame:
    """Each way goes on from where it led to; ways that have ended there are left out, or kept as they are."""
    on = state.select(scope, F.col("node").alias("to"), F.col("to").alias("far"), F.col("least").alias("low"))
    joined = state.join(on, [scope, "to"], "left" if keep_ended else "inner")
    return joined.select(scope, "node", F.coalesce("far", "to").alias("to"), F.least("least", "low").alias("least"))


def preorder(placed: DataFrame, scope: str) -> DataFrame:
    """(scope, node, up, walk): places in depth-first order from 0, parents before children, for every ``scope`` by itself.

    placed: scope, node (each once), up, ord. Children go by (ord, node); roots by node, then what no root reaches, as ``cut_cycles`` says. The
    tour enters and leaves each node; both steps name the one that follows, and the number of entries ahead of a step is summed
    while its link doubles in length, in about log2 of twice the largest forest's nodes rounds.
    """
    forest = stored(cut_cycles(placed, scope), "forest")
    siblings = Window.partitionBy(scope, "up", F.coalesce("began", F.lit(-1))).orderBy("ord", "node")
    own = forest.where("up is not null").select(scope, "node", "up", F.lead("node").over(siblings).alias("after"), F.row_number().over(siblings).alias("n"))
    # Roots follow one another over ranges of nothing but themselves: one row for each walk.
    roots = Window.partitionBy(scope).orderBy("began", "node")
    tops = forest.where("up is null").select(scope, "node", F.lit(None).cast("string").alias("up"), F.lead("node").over(roots).alias("after"), F.lit(0).alias("n"))
    nodes = stored(own.unionByName(tops), "nodes")
    first = nodes.where("n = 1").select(scope, F.col("up").alias("node"), F.col("node").alias("child"))
    enter = nodes.join(first, [scope, "node"], "left").select(
        scope, F.lit(0).alias("side"), "node", F.when(F.col("child").isNotNull(), 0).otherwise(1).alias("next_side"), F.coalesce("child", "node").alias("next"), F.lit(1).cast("long").alias("ahead")
    )
    leave = nodes.select(
        scope, F.lit(1).alias("side"), "node", F.when(F.col("after").isNotNull(), 0).when(F.col("up").isNotNull(), 1).alias("next_side"), F.coalesce("after", "up").alias("next"), F.lit(0).cast("long").alias("ahead")
    )
    tour = stored(enter.unionByName(leave), "tour")
    while not tour.where("next is not null").isEmpty():
        on = tour.select(scope, F.col("side").alias("next_side"), F.col("node").alias("next"), F.col("next_side").alias("far_side"), F.col("next").alias("far"), F.col("ahead").alias("more"))
        joined = tour.join(on, [scope, "next_side", "next"], "left")
        tour = stored(joined.select(scope, "side", "node", F.col("far_side").alias("next_side"), F.col("far").alias("next"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead")), "tour")
    sizes = nodes.groupBy(F.col(scope).alias("__scope")).agg(F.count("*").alias("size"))
    placed = tour.where("side = 0").join(nodes.select(scope, "node", "up"), [scope, "node"]).join(sizes, F.col(scope).eqNullSafe(F.col("__scope")))
    return placed.select(scope, "node", "up", (F.col("size") - F.col("ahead")).cast("int").alias("walk"))
