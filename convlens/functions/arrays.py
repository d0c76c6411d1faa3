"""Columns of arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def running(name: str, group: int = 128) -> Column:
    """For each of a column's array of integers the sum of those before it. The array must be a column: it is read once for each group.

    An array that grows by one is copied each time, so sums run within groups of numbers and over the groups' sums.
    """
    return _fold_before(name, group, lambda a, x: a + x)


def running_max(name: str, group: int = 128) -> Column:
    """For each of a column's array of integers the largest of those before it and 0, in the same way."""
    return _fold_before(name, group, lambda a, x: F.greatest(a, x))


def _fold_before(name: str, group: int, fold: Callable[[Column, Column], Column]) -> Column:
    begun = lambda a: F.aggregate(
        a,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda acc, x: F.struct(fold(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )
    numbers = F.col(name)
    last = F.ceil(F.size(numbers) / group).cast("int") - 1
    groups = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda g: F.slice(numbers, g * group + 1, group))).otherwise(
        F.expr("cast(array() as array<array<int>>)")
    )
    sums = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), fold))
    return F.flatten(F.zip_with(groups, begun(sums), lambda g, base: F.transform(begun(g), lambda x: fold(x, base))))
