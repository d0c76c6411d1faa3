"""Queries of the catalog over what is built, archived and marked: builds that count, occupancy, annotations, rejected filters, pools in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlens.lineage import shared_dir
from convlens.operators import archive, evaluate, projects, sittings, transcript
from convlens.plans import build, search
from convlens.plans.catalog import BLOCKS, GAP_MS, LISTED, NOW, RESULTS, _blocks, _records, _results, query
from convlens.plans.views import DOCUMENTS, LOG, MESSAGES, documents, messages, table

READ_BY = ["src0", "src1", "src2", "src9"]


@query(f"""WITH {MESSAGES}, s AS (SELECT *, 'src' || (conv_id % 3) AS source FROM messages), h AS (SELECT DISTINCT source, conv_id, 'f' || conv_id % 7 AS file FROM s UNION ALL SELECT DISTINCT source, conv_id, 'g' || conv_id % 5 FROM s WHERE conv_id % 4 = 0),
    r AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE seq % 2 = 0), m AS (SELECT source, id, any_value(kind) AS kind, any_value(text) AS text, count(*) AS copies FROM r GROUP BY source, id)
    SELECT n.source, coalesce(files, 0) AS files, coalesce(conversations, 0) AS conversations, coalesce(objects - conversations, 0) AS merged, coalesce(messages, 0) AS messages, coalesce(prose, 0) AS prose, coalesce(duplicates, 0)::BIGINT AS duplicates, coalesce(text_bytes, 0)::BIGINT AS text_bytes,
    CASE WHEN messages > 0 THEN 'ok' ELSE 'no rows' END AS reason FROM (SELECT unnest(['src0', 'src1', 'src2', 'src9']) AS source) n
    LEFT JOIN (SELECT source, count(DISTINCT file) AS files, count(*) AS objects, count(DISTINCT conv_id) AS conversations FROM h GROUP BY source) a ON a.source = n.source
    LEFT JOIN (SELECT source, count(*) AS messages, count(*) FILTER (kind = 'prose') AS prose, sum(copies - 1) AS duplicates, sum(strlen(text)) AS text_bytes FROM m GROUP BY source) b ON b.source = n.source""")
def built_tables(spark, sf_dir):
    """Three readers and one that finds nothing: every second message comes twice, every fourth conversation in a second file."""
    rows, c = messages(spark, sf_dir), F.col("conv_id")
    tag = lambda x, n: F.concat(F.lit(x), (c % n).cast("string"))
    convs = rows.select("conv_id").distinct()
    heads = convs.withColumn("file", tag("f", 7)).unionByName(convs.where(c % 4 == 0).withColumn("file", tag("g", 5))).withColumn("title", F.col("file"))
    twice = rows.withColumn("file", F.lit("a")).unionByName(rows.where("seq % 2 = 0").withColumn("file", F.lit("b")))
    own = lambda df, name: df.where(tag("src", 3) == name)
    return build.build_tables({n: (own(heads, n), own(twice, n)) for n in READ_BY}, ["title"], shared_dir(spark, "built"))


@query(f"""WITH {LISTED}, d AS (SELECT coalesce(o.source, n.source) AS source, CASE WHEN n.path IS NULL THEN 'vanished' WHEN o.path IS NULL THEN 'new' WHEN o.size = n.size AND o.mtime_ms = n.mtime_ms THEN 'same' WHEN n.size < o.size THEN 'rewritten' ELSE 'look' END AS change, n.size FROM old o FULL JOIN new_ n ON o.source = n.source AND o.path = n.path),
    h AS (SELECT source, count(*) AS files, sum(size)::BIGINT AS apparent_bytes, sum(ceil(size / 4096.0) * 4096)::BIGINT AS allocated_bytes FROM new_ GROUP BY source)
    SELECT d.source, any_value(files) AS files, any_value(apparent_bytes) AS apparent_bytes, any_value(allocated_bytes) AS allocated_bytes, count(*) FILTER (change = 'new') AS "new", 0::BIGINT AS appended, count(*) FILTER (change = 'rewritten') AS rewritten,
    count(*) FILTER (change = 'vanished') AS vanished, count(*) FILTER (change = 'same') AS same, coalesce(sum(size) FILTER (change IN ('new', 'rewritten')), 0)::BIGINT AS capture_bytes FROM d JOIN h ON h.source = d.source GROUP BY d.source""")
def archive_occupancy(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(key, F.col("o_orderpriority").alias("source"), F.concat(F.lit("o"), key.cast("string")).alias("path"), "o_custkey")
    old = orders.where(key % 5 != 0).select("source", "path", F.col("o_custkey").alias("size"), (key * 10).alias("mtime_ms"), F.lit("new").alias("op"), F.lit(None).cast("string").alias("prefix_hash"), F.lit(None).cast("long").alias("prefix_len"))
    now = orders.where(key % 4 != 0).select("source", "path", (F.col("o_custkey") - F.when(key % 7 == 0, 1).otherwise(0)).alias("size"), (key * 10 + F.when(key % 3 == 0, 5).otherwise(0)).alias("mtime_ms"))
    return archive.occupancy(now, archive.metadata_diff(now, old))


SAID = f"""{BLOCKS}, said AS (SELECT * REPLACE (CASE WHEN kind = 'tool_call' AND seq % 3 = 0 THEN 'AskUserQuestion' || chr(10) || text WHEN band = 'user' AND conv_id % 4 = 0 THEN 'the summary below covers the earlier portion of the conversation ' || text ELSE text END AS text) FROM blocks),
    noted AS (SELECT *, coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY conv_id ORDER BY position) > 120000, false) AS pause, (band = 'agent' AND rtrim(text) LIKE '%?') OR (kind = 'tool_call' AND starts_with(text, 'AskUserQuestion')) AS question,
    contains(text, 'the summary below covers the earlier portion of the conversation') AS compacted FROM said)"""


def _noted(spark, sf_dir):
    ask = F.concat(F.lit("AskUserQuestion\n"), F.col("text"))
    cut = F.concat(F.lit("the summary below covers the earlier portion of the conversation "), F.col("text"))
    text = F.when((F.col("kind") == "tool_call") & (F.col("seq") % 3 == 0), ask).when((F.col("band") == "user") & (F.col("conv_id") % 4 == 0), cut).otherwise(F.col("text"))
    return transcript.annotate(_blocks(spark, sf_dir).withColumn("text", text), 120_000)


@query(f"WITH {SAID} SELECT conv_id, count(*) AS messages, count(*) FILTER (is_error) AS failures, count(*) FILTER (question) AS questions, count(*) FILTER (pause) AS pauses, count(*) FILTER (compacted) AS compactions FROM noted GROUP BY conv_id")
def annotated_conversations(spark, sf_dir):
    return projects.group_stats(_noted(spark, sf_dir), ["conv_id"])


@query(f"""WITH {SAID}, c AS (SELECT *, floor(position * least(n, 5) / n)::INT AS cell, CASE WHEN band IN ('user', 'agent') THEN 3 WHEN band = 'reasoning' THEN 2 ELSE 1 END AS rank FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM noted))
    SELECT conv_id, cell, arg_max(band, rank * 100000 - position) AS band, bool_or(question) AS match, bool_or(compacted) AS compacted FROM c GROUP BY ALL""")
def marked_shape(spark, sf_dir):
    """Cells with what is marked in them: messages that ask stand for those that match."""
    return transcript.downsample(_noted(spark, sf_dir).withColumn("match", F.col("question")), 5).drop("size")


@query(f"""WITH i AS (SELECT item_id AS qid, 'src' || item_id % 25 AS source, CASE WHEN item_id % 3 > 0 THEN '/p' || item_id ELSE ' ' END AS dir, CASE item_id % 4 WHEN 0 THEN 'nope' WHEN 1 THEN '2024-02-30' WHEN 2 THEN 'day:3' ELSE '2024-02-02..2024-01-01' END AS spec FROM benchmark),
    bad AS (SELECT qid, source AS token FROM i WHERE source NOT IN (SELECT source FROM documents) UNION ALL SELECT qid, 'dir:' FROM i WHERE trim(dir) = '' UNION ALL SELECT qid, 'date:' || spec FROM i WHERE spec <> 'day:3')
    SELECT i.qid, coalesce(string_agg(token, ',' ORDER BY token), '') AS rejected FROM i LEFT JOIN bad ON bad.qid = i.qid GROUP BY i.qid""")
def rejected_filters(spark, sf_dir):
    i = F.col("item_id")
    spec = F.when(i % 4 == 0, "nope").when(i % 4 == 1, "2024-02-30").when(i % 4 == 2, "day:3").otherwise("2024-02-02..2024-01-01")
    named = table(spark, sf_dir, "benchmark").select(
        i.alias("qid"), F.lit("words").alias("q"), F.array(F.concat(F.lit("src"), (i % 25).cast("string"))).alias("sources"), F.array(F.when(i % 3 > 0, F.concat(F.lit("/p"), i.cast("string"))).otherwise(" ")).alias("dirs"), F.array(spec).alias("dates")
    )
    asks = search.prepare_queries(named, table(spark, sf_dir, "documents").select("source"), NOW)
    return asks.select("qid", F.array_join("rejected", ",").alias("rejected"))


@query(f"""WITH {RESULTS}, {DOCUMENTS}, u AS (SELECT qid, conv_id FROM results WHERE rank <= 10) SELECT u.qid, u.conv_id, row_number() OVER (PARTITION BY u.qid ORDER BY ended_at DESC NULLS LAST, u.conv_id)::INT AS place FROM u LEFT JOIN docs ON docs.id = u.conv_id""")
def pooled_in_order(spark, sf_dir):
    pooled = evaluate.pool({"longest": _results(spark, sf_dir)}, 10)
    return evaluate.pool_order(pooled, documents(spark, sf_dir)).select("qid", "conv_id", "place")


@query(f"""WITH {LOG}, o AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms, id) < {GAP_MS} THEN 0 ELSE 1 END AS opens FROM log WHERE source <> 'view'),
    i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts_ms, id) AS island FROM o),
    m AS (SELECT id, first_value(id) OVER w AS sitting_id, row_number() OVER w AS position, count(*) OVER (PARTITION BY user_id, island) AS members FROM i WINDOW w AS (PARTITION BY user_id, island ORDER BY ts_ms, id)),
    asked AS (SELECT arg_max(id, ts_ms::HUGEINT * 100000000000 + id) AS id FROM log GROUP BY user_id),
    a AS (SELECT asked.id, coalesce(m.sitting_id, asked.id) AS sitting_id FROM asked LEFT JOIN m ON m.id = asked.id AND members > 1)
    SELECT a.id, a.sitting_id, coalesce(m.id, a.id) AS member, coalesce(position, 1)::INT AS position FROM a LEFT JOIN m ON m.sitting_id = a.sitting_id AND members > 1""")
def resolved_sittings(spark, sf_dir):
    """The sitting of each user's latest record, told in full, where views are not on the list of what is folded: a latest view stands alone."""
    rows = _records(spark, sf_dir)
    folded = rows.where("source <> 'view'").select("source").distinct()
    members = sittings.build(rows, ["user_id"], "ts_ms", gap_ms=GAP_MS, allow=folded)
    latest = rows.groupBy("user_id").agg(F.max_by("id", F.struct("ts_ms", "id")).alias("id"))
    return sittings.resolve(members, latest)
