"""Derived tables on disk: each commit writes new folders and then one pointer, so a reader has all tables of a version or all of another.

A folder holds ``<version>/<table>/bucket=<n>`` and ``CURRENT``, a small JSON file: the version of the rules, which version each bucket of each table stands in,
and the ledger of what was taken in. It is written beside its place and moved there, after everything it names is whole. A
failed commit leaves folders that nothing names; ``vacuum`` removes those and the versions that only older pointers named.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 2
POINTER = "CURRENT"


class Conflict(RuntimeError):
    """Another commit came first; nothing was changed."""


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def pointer(spark: SparkSession, path: str) -> dict:
    """What is committed; an empty one where nothing is."""
    at, fs = _place(spark, f"{path}/{POINTER}")
    if not fs.exists(at):
        return {"rules": VERSION, "commit": None, "tables": {}, "schemas": {}, "ledger": {}}
    stream = fs.open(at)
    try:
        told = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    if told["rules"] != VERSION:
        raise ValueError(f"tables of version {told['rules']} are not those of version {VERSION}; build them again")
    return told


def _commit(spark: SparkSession, path: str, told: dict, seen: str | None) -> None:
    """The pointer in place of the one whose commit was ``seen``."""
    if pointer(spark, path)["commit"] != seen:
        raise Conflict(f"{path} was changed since it was read")
    jvm = spark.sparkContext._jvm
    beside, fs = _place(spark, f"{path}/.{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    to, _ = _place(spark, f"{path}/{POINTER}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri() if beside.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fs.makeQualified(beside), fs.makeQualified(to), over)


def _new_version() -> str:
    return f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def _buckets(spark: SparkSession, folder: str) -> list[str]:
    at, fs = _place(spark, folder)
    return [s.getPath().getName().split("=")[1] for s in fs.listStatus(at) if s.getPath().getName().startswith("bucket=")]


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> str:
    """A full rebuild of all tables in one commit; its version. The former one stays readable until the last step, and after a failure."""
    seen, version = pointer_or_new(spark, path), _new_version()
    for name, df in tables.items():
        df.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/{version}/{name}")
    where = {name: {b: version for b in _buckets(spark, f"{path}/{version}/{name}")} for name in tables}
    _commit(spark, path, {"rules": VERSION, "commit": version, "tables": where, "schemas": {n: df.schema.json() for n, df in tables.items()}, "ledger": {}}, seen["commit"])
    return version


def pointer_or_new(spark: SparkSession, path: str) -> dict:
    """The pointer, or an empty one in place of other rules' tables, which a rebuild replaces."""
    try:
        return pointer(spark, path)
    except ValueError:
        at, fs = _place(spark, f"{path}/{POINTER}")
        fs.delete(at, False)
        return pointer(spark, path)


def laid_out(messages: DataFrame) -> DataFrame:
    """Messages in ranges of conversations, in reading order; a large conversation is several ranges."""
    order = ["conv_id", "is_sidechain", "thread_key", "seq"]
    return messages.repartitionByRange(*order).sortWithinPartitions(*order)


def write(conversations: DataFrame, messages: DataFrame, path: str) -> str:
    """Both tables in one commit."""
    return publish(conversations.sparkSession, path, {"conversation": conversations, "message": laid_out(messages)})


def load(spark: SparkSession, path: str, name: str, told: dict | None = None, buckets: set[str] | None = None) -> DataFrame:
    """A table as ``told`` (by default the present pointer) has it."""
    told = told or pointer(spark, path)
    schema = T.StructType.fromJson(json.loads(told["schemas"][name]))
    dirs = [f"{path}/{version}/{name}/bucket={b}" for b, version in told["tables"][name].items() if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*dirs) if dirs else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Conversations and messages of one version."""
    told = pointer(spark, path)
    if told["commit"] is None:
        raise ValueError(f"nothing was built at {path}")
    return load(spark, path, "conversation", told), load(spark, path, "message", told)


def upsert(spark: SparkSession, path: str, rows: dict[str, DataFrame], ledger: str, entry: int, by: str = "file", buckets: int = 64) -> bool:
    """Rows of some files in place of what the tables held of these files, once for each (ledger, entry); False if it was taken in before.

    Entries of a ledger come in order. Rows are dealt to buckets by ``by``, and only buckets that such a file falls to are
    written anew, so a small delivery costs no rebuild. All tables and the ledger change in one commit.
    """
    seen = pointer(spark, path)
    if entry <= seen["ledger"].get(ledger, -1):
        return False
    version = _new_version()
    at = F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")
    told = {**seen, "commit": version, "ledger": {**seen["ledger"], ledger: entry}, "tables": dict(seen["tables"]), "schemas": dict(seen["schemas"])}
    for name, df in rows.items():
        taken = df.select(by).distinct()
        touched = {str(r[0]) for r in taken.select(at).distinct().collect()}  # no more than there are buckets
        merged = df
        if name in seen["tables"]:
            merged = load(spark, path, name, seen, touched).join(taken, by, "left_anti").unionByName(df)
        merged.withColumn("bucket", at).repartition("bucket", by).write.partitionBy("bucket").parquet(f"{path}/{version}/{name}")
        there = set(_buckets(spark, f"{path}/{version}/{name}"))
        kept = {b: v for b, v in seen["tables"].get(name, {}).items() if b not in touched}
        told["tables"][name] = kept | {b: version for b in there}
        told["schemas"][name] = df.schema.json()
    _commit(spark, path, told, seen["commit"])
    return True


def vacuum(spark: SparkSession, path: str, older_than_s: float = 7 * 86_400) -> list[str]:
    """Removes versions that the pointer does not name and that are older than any reader; their names."""
    named = {v for t in pointer(spark, path)["tables"].values() for v in t.values()}
    at, fs = _place(spark, path)
    edge, gone = (time.time() - older_than_s) * 1000, []
    for s in fs.listStatus(at):
        name = s.getPath().getName()
        if name.startswith("v") and name not in named and s.getModificationTime() < edge:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return gone
