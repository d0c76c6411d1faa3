"""Connected components by rounds of joins, with each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.llm.shared import stored


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(a, b) links to (node, component), the component being its smallest node. Nodes without a link don't appear.

    Every round turns each node's links towards the smallest neighbour: first those to larger nodes, then those to smaller
    ones. Both steps keep what is connected and make stars, in about log(nodes) rounds, until nothing but stars is left.
    The smallest neighbours are written before links are joined to them, so that both sides of a join come from shuffles of
    their own and AQE can split the links of a node that has a great share of them.
    """
    links = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    for _ in range(most_rounds):
        both = links.select("a", "b", F.lit(1).alias("up")).union(links.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0)))
        least = stored(both.groupBy("a").agg(F.min("b").alias("low"), F.sum("up").alias("ups"), F.min("up").alias("all_up")).select("a", F.least("a", "low").alias("low"), "ups", "all_up"), "least")
        # Stars: a node has one link to a smaller one, and what it is linked to has none.
        if least.where("ups > 1 or (ups = 1 and all_up = 0)").isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(least.where("ups = 0").select(F.col("a").alias("node"), F.col("a").alias("component")))
        # Large star: larger neighbours go to the smallest neighbour of the node.
        large = stored(both.where("up = 0").select("a", "b").join(least.select("a", "low"), "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b"), "large")
        # Small star: the node and its smaller neighbours go to the smallest of them.
        low = stored(large.groupBy("a").agg(F.min("b").alias("low")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        links = stored(small.union(low.select("a", F.col("low").alias("b"))).distinct(), "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
