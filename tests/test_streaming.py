"""Streams over files against their batch forms."""

import shutil

from convlens.streaming import jobs
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def split(spark, tmp_path, n=4):
    """The events in several files, with one of them delivered twice."""
    rows = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartitionByRange(n, "ts").write.parquet(f"{tmp_path}/in")
    files = sorted((tmp_path / "in").glob("part-*.parquet"))
    shutil.copy(files[0], tmp_path / "in" / "part-again.parquet")
    return rows, spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")


def result(spark, tmp_path, stream, mode="append"):
    jobs.to_table(stream, f"{tmp_path}/out", f"{tmp_path}/cp", mode)
    return spark.read.parquet(f"{tmp_path}/out")


def test_rows_come_once(spark, tmp_path):
    rows, stream = split(spark, tmp_path)
    out = result(spark, tmp_path, jobs.append_once(stream, "event_id", "ts", "3650 days"))
    assert out.count() == rows.count() == out.select("event_id").distinct().count()


def test_streamed_sittings_are_those_of_the_batch(spark, tmp_path):
    rows, _ = split(spark, tmp_path)
    closing = rows.limit(1).withColumn("ts", F.lit("2040-01-01 00:00:00").cast("timestamp")).withColumn("user_id", F.lit(-1).cast("long"))
    rows.union(closing).write.parquet(f"{tmp_path}/once")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/once")
    out = result(spark, tmp_path, jobs.sittings(stream, ["user_id"], "ts", 30, "3650 days"))
    from convlens.operators import sittings

    batch = sittings.gap_islands(rows.withColumn("ms", F.unix_micros("ts")), ["user_id"], "ms", "event_id", 30 * 60_000_000)
    want = batch.groupBy("user_id", "island").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events")).drop("island")
    assert sorted(map(tuple, out.where("user_id >= 0").select("user_id", "started", "ended", "events").collect())) == sorted(map(tuple, want.collect()))


def test_streamed_counts(spark, tmp_path):
    rows, _ = split(spark, tmp_path)
    seen = {}

    def keep(df, _):
        for r in df.collect():
            seen[r["day"], r["event_type"]] = r["n"]

    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in").where(~F.input_file_name().contains("again"))
    jobs.each_batch(jobs.census(stream, "ts", "event_type", "3650 days"), keep, f"{tmp_path}/cp")
    want = {(r[0], r[1]): r[2] for r in rows.groupBy(F.date_trunc("day", "ts"), "event_type").count().collect()}
    assert seen == want


def test_latest_state_ignores_the_order_of_arrival(spark, tmp_path):
    rows, stream = split(spark, tmp_path)
    cols = {"user_id": "long", "ms": "long", "event_id": "long", "event_type": "string"}
    pick = lambda df: df.select("user_id", F.unix_millis("ts").alias("ms"), "event_id", "event_type")
    seen = {}

    def keep(df, _):
        for r in df.collect():
            seen[r["user_id"]] = (r["ms"], r["event_id"], r["event_type"])

    jobs.each_batch(jobs.latest_state(pick(stream), ["user_id"], ["ms", "event_id"], cols), keep, f"{tmp_path}/cp")
    want = {r["user_id"]: (r["m"]["ms"], r["m"]["event_id"], r["m"]["event_type"]) for r in pick(rows).groupBy("user_id").agg(F.max(F.struct("ms", "event_id", "event_type")).alias("m")).collect()}
    assert seen == want


def test_streamed_absorption_is_that_of_the_batch(spark, tmp_path):
    from convlens.operators import logfold

    rows = spark.read.parquet(f"{DATA}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    log = rows.select("user_id", F.col("event_id").alias("id"), "at", F.unix_millis("at").alias("ts_ms"), F.substring(F.lit("search"), F.lit(1), (F.col("event_id") % 7).cast("int")).alias("q"), F.col("event_type").alias("source"))
    log.coalesce(1).write.parquet(f"{tmp_path}/log")
    late = spark.createDataFrame([(-1, -1, 4_000_000_000_000, "end", "x")], "user_id long, id long, ts_ms long, q string, source string").withColumn("at", F.timestamp_millis("ts_ms"))
    late.select(log.columns).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    out = result(spark, tmp_path, jobs.absorbed(stream, "user_id", "1 second", 6 * 3_600_000))
    want = logfold.absorb(log, ["user_id"], 6 * 3_600_000).where("not absorbed").select("id")
    assert sorted(r["id"] for r in out.where("id >= 0").select("id").collect()) == sorted(r["id"] for r in want.collect())


def test_absorption_of_null_texts_and_late_events(spark, tmp_path):
    schema = "user_id long, id long, ts_ms long, q string, source string"
    batches = [
        [(1, 1, 1_000, "se", "a"), (1, 2, 2_000, None, "a"), (2, 10, 5_000, "search", "a")],
        [(1, 3, 3_000, "sea", "a"), (2, 9, 4_000, "sea", "a"), (2, 8, 4_500, "other", "a")],
        [(9, 99, 4_000_000_000_000, "end", "x")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_millis("ts_ms")).coalesce(1).write.parquet(f"{tmp_path}/log/b{i}")
    stream = spark.readStream.schema(schema + ", at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/log")
    out = {r["id"] for r in result(spark, tmp_path, jobs.absorbed(stream, "user_id", "1 hour", 6 * 3_600_000)).collect()}
    # 9 goes on to 10, which came before it; 8 does not; nothing goes on from a null text.
    assert out == {1, 2, 3, 8, 10}


def test_live_state_is_that_of_the_batch_and_forgets(spark, tmp_path):
    """Keys that fell silent leave the state, late rows are counted, and the newest row of every key is that of the batch without them."""
    schema = "user long, at timestamp, n long, v string"
    hour = 3_600_000
    said = lambda *r: [(u, h * hour, n, v) for u, h, n, v in r]
    batches = [
        said(*[(u, 1, u, "a") for u in range(50)]),
        said((1, 3, 100, "b"), (2, 2, 101, "c"), (2, 2, 99, "older")),
        said((100, 30, 200, "far")),
        said((101, 31, 201, "on"), (5, 1, 999, "late"), (6, 2, 998, "late")),
        said((102, 32, 202, "end")),
    ]
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "user long, ms long, n long, v string").select("user", F.timestamp_millis("ms").alias("at"), "n", "v")
        frame.coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen = {}

    def keep(df, _):
        for r in df.collect():
            seen[r["user"]] = (r["n"], r["v"])

    own = stream.withColumn("ms", F.unix_millis("at"))
    live = jobs.latest_live(own, ["user"], ["ms", "n"], {"user": "long", "ms": "long", "n": "long", "v": "string"}, "at", "1 hour", 4 * hour)
    query = jobs.each_batch(live, keep, f"{tmp_path}/cp")
    want = {u: (u, "a") for u in range(50)} | {1: (100, "b"), 2: (101, "c"), 100: (200, "far"), 101: (201, "on"), 102: (202, "end")}
    assert seen == want
    assert jobs.late_rows(query) == 2
    rows = jobs.state_rows(query)
    assert max(rows) >= 50 and rows[-1] <= 10


def test_absorption_counts_late_events(spark, tmp_path):
    schema = "user_id long, id long, ts_ms long, q string, source string"
    for i, rows in enumerate([[(1, 1, 10_000_000, "se", "a")], [(2, 2, 20_000_000, "x", "a")], [(1, 3, 1_000, "late", "a"), (3, 4, 21_000_000, "y", "a")]]):
        spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_millis("ts_ms")).coalesce(1).write.parquet(f"{tmp_path}/log/b{i}")
    stream = spark.readStream.schema(schema + ", at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/log")
    query = jobs.to_table(jobs.absorbed(stream, "user_id", "1 second", 1_000), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert jobs.late_rows(query) == 1
    assert 3 not in {r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}


def test_streamed_ingest_is_the_batch_under_replay(spark, tmp_path):
    """Files in several deliveries, one under two names, one that grows, and a batch that is replayed: the tables are those of one batch read."""
    import json

    from convlens.operators import model
    from convlens.sources import tables, transcripts

    def session(name, n, own):
        told = [{"type": "user" if i % 2 == 0 else "assistant", "uuid": f"{own}-{i}", "parentUuid": f"{own}-{i - 1}" if i else None, "sessionId": own, "timestamp": f"2026-01-01T00:00:{i:02d}Z", "message": {"role": "user" if i % 2 == 0 else "assistant", "content": f"said {i} in {own}"}} for i in range(n)]
        (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, told)))

    (tmp_path / "in").mkdir()
    path, cp = f"{tmp_path}/tables", f"{tmp_path}/cp"
    run = lambda: jobs.ingest(spark, f"{tmp_path}/in", path, cp, transcripts.session_jsonl, files_at_once=2, buckets=4)
    for i in range(3):
        session(f"s{i}.jsonl", 4 + i, f"own{i}")
    assert run() == 2
    session("t0.jsonl", 6, "own0")  # the same session under another name, gone on
    session("s9.jsonl", 3, "own9")
    assert run() == 1
    assert run() == 0
    told = tables.pointer(spark, path)
    last = told["ledger"]["ingest"]
    assert not jobs.take_in(spark, [f"{tmp_path}/in/s9.jsonl"], path, transcripts.session_jsonl, "ingest", last, 4)
    assert tables.pointer(spark, path) == told

    convs, msgs = jobs.ingested(spark, path)
    heads, rows = transcripts.session_jsonl(spark, f"{tmp_path}/in")
    columns = [c for c in heads.columns if c not in ("conv_id", "file")]
    want_convs, want = model.merge_conversations(heads, ["file"], columns, "conv_id"), model.merge_messages(rows, ["file", "seq"])
    told = lambda df: sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)
    assert told(msgs) == told(want) and msgs.count() == 6 + 5 + 6 + 3
    assert told(convs) == told(want_convs) and convs.count() == 4
