"""Event logs in JSON lines, read tolerantly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, line): place orders the lines of a file, over all its splits."""
    rows = spark.read.text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("place"),
        F.col("value").alias("line"),
    )


def read_events(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Events with file and place, and (file, unreadable) counts. Unreadable lines are counted, not fatal."""
    fields = T.StructType.fromDDL(schema)
    parsed = lines(spark, path).where(F.trim("line") != "").withColumn("e", F.from_json("line", T.StructType([*fields.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("e").isNull() | F.col("e._bad").isNotNull()
    return parsed.where(~bad).select("file", "place", *[f"e.`{f}`" for f in fields.names]), parsed.where(bad).groupBy("file").agg(F.count("*").alias("unreadable"))


def damaged_before_end(spark: SparkSession, path: str) -> DataFrame:
    """Files with an unreadable line that is not their last: a log that allows a cut-off last line alone."""
    rows = lines(spark, path).where(F.trim("line") != "").withColumn("bad", F.try_parse_json("line").isNull())
    last = rows.groupBy("file").agg(F.max("place").alias("last"))
    return rows.where("bad").join(last, "file").where("place < last").select("file").distinct()


def number(rows: DataFrame, by: str = "file") -> DataFrame:
    """line numbers from 0 within a file."""
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy(by).orderBy("place")) - 1)
