"""An archive's change log and listings: current state, differences, staleness, coverage."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlens.lineage import stored

PREFIX_BYTES = 65_536
DAY_MS = 86_400_000


def current(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of every key by the given order, with all its columns."""
    rest = [c for c in events.columns if c not in keys]
    last = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.select(*keys, "last.*")


def fingerprint(files: DataFrame, content: str = "content") -> DataFrame:
    """prefix_len and prefix_hash of the first 64 KiB."""
    n = F.least(F.length(content), F.lit(PREFIX_BYTES))
    return files.withColumn("prefix_len", n.cast("long")).withColumn("prefix_hash", F.sha2(F.substring(content, 1, PREFIX_BYTES), 256))


def metadata_diff(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Full outer join of a listing and the manifest's live state on (source, path): both sides' columns and ``change``,
    'same' where size and time agree, 'new', 'vanished', else 'look': only those need their content read."""
    old = manifest.where("op <> 'vanished'").select("source", "path", F.col("size").alias("old_size"), F.col("mtime_ms").alias("old_mtime_ms"), "prefix_hash", "prefix_len")
    joined = listing.select("source", "path", "size", "mtime_ms").join(old, ["source", "path"], "full_outer")
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime_ms") == F.col("old_mtime_ms"))
    change = F.when(F.col("size").isNull(), "vanished").when(F.col("old_size").isNull(), "new").when(same, "same").when(F.col("size") < F.col("old_size"), "rewritten").otherwise("look")
    return joined.withColumn("change", change)


def open_head(path: str, n: int) -> bytes:
    """The first ``n`` bytes of a file, by a range read from wherever the path's scheme says."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme in ("", "file") or "/" in scheme:
        own, at = fs.LocalFileSystem(), "/" + (rest if scheme == "file" else path).lstrip("/")
    else:
        own, at = fs.FileSystem.from_uri(quote(path, safe=":/"))
    with own.open_input_file(at) as f:
        return f.read(n)


HEADS = "source string, path string, head_len long, head_hash string, recorded_hash string, bytes_read long, error string"


def read_heads(rows: DataFrame, head: Callable[[str, int], bytes] = open_head, most: int = PREFIX_BYTES) -> DataFrame:
    """Per row (source, path, prefix_len or null): the hash of the file's first ``most`` bytes, and of as many as were recorded, from one read.

    Only the files of these rows are opened, each for its head alone. A file that cannot be read has an ``error`` and no hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    data, error = head(r["path"], most), None
                except OSError as x:
                    data, error = None, str(x)
                told = data is not None
                old = r["prefix_len"]
                recorded = hashlib.sha256(data[:old]).hexdigest() if told and old is not None and len(data) >= old else None
                out.append((r["source"], r["path"], len(data) if told else None, hashlib.sha256(data).hexdigest() if told else None, recorded, len(data) if told else 0, error))
            names = [part.split()[0] for part in HEADS.split(", ")]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)], names=names)

    return rows.select("source", "path", "prefix_len").mapInArrow(run, HEADS)


def scan(listing: DataFrame, manifest: DataFrame, head: Callable[[str, int], bytes] = open_head) -> DataFrame:
    """(source, path, size, mtime_ms, old_size, change, prefix_len, prefix_hash, bytes_read) of every file listed or known.

    listing: source, path, size, mtime_ms; manifest: the live state (op, source, path, size, mtime_ms, prefix_hash, prefix_len). Where size and time are as they
    were nothing is opened. change: same, new, appended, rewritten, vanished, or unreadable, which is looked at again by the next scan.
    """
    first = stored(metadata_diff(listing, manifest), "metadata")
    heads = stored(read_heads(first.where("change not in ('same', 'vanished')"), head), "heads")
    joined = first.drop("prefix_len").withColumnRenamed("prefix_hash", "old_hash").join(heads, ["source", "path"], "left")
    held = F.col("recorded_hash") == F.col("old_hash")
    change = (
        F.when(F.col("error").isNotNull(), "unreadable")
        .when(F.col("change") != "look", F.col("change"))
        .when(F.coalesce(held, F.lit(False)), F.when(F.col("size") == F.col("old_size"), "same").otherwise("appended"))
        .otherwise("rewritten")
    )
    return joined.select(
        "source", "path", "size", "mtime_ms", "old_size", change.alias("change"), F.col("head_len").alias("prefix_len"), F.col("head_hash").alias("prefix_hash"), F.coalesce("bytes_read", F.lit(0)).alias("bytes_read")
    )


EVENTS = "ts long, source string, path string, op string, size long, mtime_ms long, prefix_len long, prefix_hash string"


def scan_events(changes: DataFrame, now_ms: int) -> DataFrame:
    """Manifest events of a scan: what is new, appended to or rewritten with its fingerprint, and what vanished."""
    gone = F.col("change") == "vanished"
    told = changes.where(F.col("change").isin("new", "appended", "rewritten", "vanished"))
    fields = [F.when(~gone, F.col(c)).alias(c) for c in ("size", "mtime_ms", "prefix_len", "prefix_hash")]
    return told.select(F.lit(now_ms).cast("long").alias("ts"), "source", "path", F.col("change").alias("op"), *fields)


def append_scan(events: DataFrame, log: str, scan_id: str) -> bool:
    """A scan's events added to the log as one, by month; False, and nothing added, where the log has the scan already.

    They are written beside the log and moved into it, so a scan is there as a whole or not at all.
    """
    spark = events.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(f"{log}/scan={scan_id}")
    fs = to.getFileSystem(conf)
    if fs.exists(to):
        return False
    beside = jvm.org.apache.hadoop.fs.Path(f"{log}/_adding-{uuid.uuid4().hex}")
    append_events(events, beside.toString())
    fs.mkdirs(beside)
    if not fs.exists(to) and fs.rename(beside, to):
        return True
    fs.delete(beside, True)
    return False


def manifest_events(spark: SparkSession, log: str) -> DataFrame:
    """All events of the log with ``scan`` and ``period``; none where there is no log yet."""
    schema = T.StructType.fromDDL(EVENTS + ", scan string, period string")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{log}/scan=*")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", log).json(f"{log}/scan=*")


def rescan(listing: DataFrame, log: str, scan_id: str, now_ms: int, head: Callable[[str, int], bytes] = open_head) -> DataFrame:
    """The closed loop: the log's state, what has changed since, and that appended to the log. Gives the changes, as ``scan`` does."""
    state = current(manifest_events(listing.sparkSession, log), ["source", "path"], ["ts", "scan"])
    changes = stored(scan(listing, state, head), "changes")
    append_scan(scan_events(changes, now_ms), log, scan_id)
    return changes


def occupancy(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Per source what it holds and how it changed: files, apparent and allocated bytes (whole blocks of 4 KiB where the listing has no allocated_bytes), bytes to capture.

    files: source, path, size[, allocated_bytes]; changes: source, path, change, size, old_size.
    """
    taken = F.col("allocated_bytes") if "allocated_bytes" in files.columns else F.ceil(F.col("size") / 4096) * 4096
    held = files.groupBy("source").agg(F.count("*").alias("files"), F.sum("size").alias("apparent_bytes"), F.sum(taken).cast("long").alias("allocated_bytes"))
    return held.join(change_summary(changes), "source", "full_outer").fillna(0)


def change_summary(changes: DataFrame) -> DataFrame:
    """Per source: counts by change and bytes to capture."""
    kinds = ["new", "appended", "rewritten", "vanished", "same"]
    return changes.groupBy("source").agg(
        *[F.count_if(F.col("change") == k).alias(k) for k in kinds],
        F.coalesce(F.sum(F.when(F.col("change").isin("new", "rewritten"), F.col("size")).when(F.col("change") == "appended", F.col("size") - F.col("old_size"))), F.lit(0)).alias("capture_bytes"),
    )


def versions(events: DataFrame) -> DataFrame:
    """Versions of every path: a rewritten one keeps its predecessor, an appended one replaces it. valid_from, valid_until, is_current."""
    from pyspark.sql import Window

    w = Window.partitionBy("source", "path").orderBy("ts", "seq")
    kept = events.withColumn("__next_op", F.lead("op").over(w)).where(~F.coalesce(F.col("__next_op") == "appended", F.lit(False)))
    later = F.lead("ts").over(w)
    return kept.where("op <> 'vanished'").withColumn("valid_from", F.col("ts")).join(
        kept.withColumn("valid_until", later).select("source", "path", "seq", "valid_until"), ["source", "path", "seq"]
    ).withColumn("is_current", F.col("valid_until").isNull()).drop("__next_op")


def tombstones(state: DataFrame, files: DataFrame) -> DataFrame:
    """(conv_id, deleted_at): conversations all of whose files are vanished. files: (conv_id, source, path)."""
    joined = files.join(state.select("source", "path", "op", "ts"), ["source", "path"])
    gone = joined.groupBy("conv_id").agg(F.min((F.col("op") == "vanished").cast("int")).alias("all_gone"), F.max("ts").alias("deleted_at"))
    return gone.where("all_gone = 1").select("conv_id", "deleted_at")


def staleness(state: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    """Sources whose newest live bytes are older than ``days``: source, newest_ms, stale_days, worst first by order of output columns."""
    newest = state.where("op <> 'vanished'").groupBy("source").agg(F.max("mtime_ms").alias("newest_ms"))
    age = F.floor((F.lit(now_ms) - F.col("newest_ms")) / DAY_MS)
    return newest.withColumn("stale_days", age).where(F.col("stale_days") > days)


def coverage_gaps(known: DataFrame, claimed: DataFrame) -> DataFrame:
    """Known locations whose id and path are both unclaimed: two anti joins, each on equality."""
    return known.join(claimed.select("id").distinct(), "id", "left_anti").join(claimed.select("path").distinct(), "path", "left_anti")


def table_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change: 'missing' on the right, 'added' there, or 'changed' in any other column."""
    others = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.struct(*others).alias("l"), F.lit(True).alias("in_left"))
    b = right.select(*keys, F.struct(*others).alias("r"), F.lit(True).alias("in_right"))
    change = F.when(F.col("in_right").isNull(), "missing").when(F.col("in_left").isNull(), "added").when(~F.col("l").eqNullSafe(F.col("r")), "changed")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change")).where("change is not null")


def files(spark, root: str, glob: str = "*") -> DataFrame:
    """path, size, mtime_ms of every file below root that is not empty, as Spark lists them; the content stays unread until it is selected."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return rows.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), "content")


def select_globs(rows: DataFrame, globs: list[str], path: str = "path") -> DataFrame:
    """Rows whose path matches any glob; no glob means all, a bad one is skipped."""
    import fnmatch

    good = [fnmatch.translate(g).removesuffix(r"\z").removesuffix(r"\Z") + "$" for g in globs if g.count("[") == g.count("]")]
    if not globs:
        return rows
    return rows.where(reduce(lambda a, b: a | b, [F.rlike(path, F.lit(g)) for g in good], F.lit(False)))


def append_events(events: DataFrame, path: str) -> None:
    """Events appended under a folder for the month of each one's own time."""
    events.withColumn("period", F.date_format(F.timestamp_millis("ts"), "yyyy-MM")).write.mode("append").partitionBy("period").json(path)
