"""Helpers of this subpackage's jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convlens.lineage import kept, scope, shared_dir, stored

__all__ = ["attach", "bounded_batches", "kept", "scope", "shared_dir", "stored", "table"]

BATCH_BYTES, UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Rows go to Python in batches of at most ``most`` bytes or one row, unless the session sets a bound of its own."""
    now = spark.conf.get(BATCH_BYTES, None)
    if now is not None and now.rstrip("b") == str(UNSET):
        spark.conf.set(BATCH_BYTES, f"{most}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; whoever reads one works in bounded batches."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Left join on null-safe keys that names no column twice: the keys of ``right`` are dropped."""
    renamed = right.select(*[right[k].alias(f"__right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = None
    for k in keys:
        same = left[k].eqNullSafe(renamed[f"__right_{k}"])
        on = same if on is None else on & same
    return left.join(renamed, on, "left").drop(*[f"__right_{k}" for k in keys])
