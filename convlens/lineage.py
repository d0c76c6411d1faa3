"""Cutting lineage: what must outlive a stage is written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}  # application to the folder made for it, on a local master alone
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; on a local master a folder of this machine where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="convlens-")
        root = _LOCAL[context.applicationId]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read from there. The files go when the scope ends in which they were written, or else with the driver."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    place, fs = _place(df.sparkSession, path)
    fs.deleteOnExit(place)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is ``stored`` within is deleted at its end, so a long session keeps no query's files. Whoever needs a result later writes it within a
    scope around this one, or to a place of their own, before the end. Scopes are of the driver's thread that opens them."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            place, fs = _place(spark, path)
            fs.delete(place, True)
            fs.cancelDeleteOnExit(place)


def kept(df: DataFrame, name: str) -> DataFrame:
    """As ``stored``, for the scope around the present one."""
    inner = _SCOPES.pop() if _SCOPES else None
    try:
        return stored(df, name)
    finally:
        if inner is not None:
            _SCOPES.append(inner)
