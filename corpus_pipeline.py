"""A training corpus from documents: good ones, one of each group of near-copies, without test items and secrets, as tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.llm import bpe, decontaminate, neardup, quality, secrets
from convlens.llm.queries import tokenizer_path
from convlens.llm.shared import bounded_batches, kept, scope, table


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier predicts to be good. A null text is judged as an empty one; rows without an id are judged too."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: of each group of rows the one with the smallest doc_id stays, a row without an id only
    if no other is in its group, and one of equal rows. Rows without words are no copies of each other."""
    bounded_batches(spark)
    return neardup.keep_one(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no test item is found, each judged by its own text whatever its id. Null and empty texts hold none."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with each secret replaced by its kind in brackets and n_chars counted anew. A null text stays null."""
    bounded_batches(spark)
    clean = secrets.redact(docs, secrets.scan_secrets(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids, decoded text and digests. A null text has no ids, a null doc_id stays null."""
    bounded_batches(spark)
    return bpe.encode_documents(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality", keep_good_documents),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: No SQL for a trained network, sketches or merges; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scope(spark):  # what a stage wrote on its way goes when its documents are there
            docs = kept(stage(spark, docs, sf_dir), name)
    return docs
