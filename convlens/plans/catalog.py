"""Every operator applied to the synthetic tables, each with SQL that must give the same rows.

``QUERIES`` holds (spark, sf_dir) -> DataFrame; ``SQL`` the equivalents over views of the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.functions.text import MARKED, PLAIN, clip_bytes, html_to_text, tokenize
from convlens.lineage import stored
from convlens.operators import archive, evaluate, explain, facets, filters, logfold, model, postings, projects, sittings, timeline, transcript
from convlens.plans import search
from convlens.plans.views import DOCUMENTS, LOG, MESSAGES, START_MS, documents, log, messages, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NOW = START_MS + 400 * 86_400_000
#: Seed words of topics, among the commonest short words of the texts.
SEEDS = [("english", "the"), ("english", "with"), ("french", "les"), ("french", "une"), ("german", "und"), ("german", "mit"), ("spanish", "los"), ("spanish", "una")]
SEED_SQL = "seeds(topic, term) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SEEDS) + ")"
GAP_MS = 30 * 60_000


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# --- model ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {MESSAGES} SELECT conv_id, count(*) AS msg_count, count(*) FILTER (kind = 'prose') AS prose_count,
    count(*) FILTER (kind = 'prose' AND role = 'user') AS user_turns, count(DISTINCT thread_key) AS thread_count, min(ts_ms) AS started_at, max(ts_ms) AS ended_at,
    arg_max(model, ts_ms * 100000 + seq) FILTER (model IS NOT NULL) AS model FROM messages GROUP BY conv_id""")
def conversation_rollup(spark, sf_dir):
    return model.rollup(messages(spark, sf_dir))


@query(f"""WITH RECURSIVE {MESSAGES}, leaves AS (SELECT id FROM messages QUALIFY row_number() OVER (PARTITION BY conv_id, thread_key ORDER BY seq DESC, id) = 1),
    up AS (SELECT id FROM leaves UNION SELECT m.parent_id FROM messages m JOIN up ON m.id = up.id WHERE m.parent_id IS NOT NULL)
    SELECT id, conv_id, id IN (SELECT id FROM up) AS on_head_path FROM messages""")
def head_path(spark, sf_dir):
    return model.head_path(messages(spark, sf_dir)).select("id", "conv_id", "on_head_path")


@query(f"""WITH RECURSIVE {MESSAGES}, walk AS (SELECT id, parent_id AS at FROM messages WHERE kind <> 'reasoning' AND kind <> 'tool_result'
    UNION ALL SELECT w.id, m.parent_id FROM walk w JOIN messages m ON m.id = w.at WHERE m.kind IN ('reasoning', 'tool_result'))
    SELECT w.id, w.at AS parent_id FROM walk w LEFT JOIN messages m ON m.id = w.at WHERE w.at IS NULL OR m.kind NOT IN ('reasoning', 'tool_result')""")
def reparented(spark, sf_dir):
    return model.reparent(messages(spark, sf_dir).select("id", "parent_id", (~F.col("kind").isin("reasoning", "tool_result")).alias("emitted")))


@query(f"""WITH {MESSAGES}, both_ AS (SELECT *, 1 AS file FROM messages UNION ALL SELECT * REPLACE (upper(text) AS text), 2 FROM messages WHERE seq % 2 = 0)
    SELECT id, text, copies FROM (SELECT *, count(*) OVER (PARTITION BY id) AS copies, row_number() OVER (PARTITION BY id ORDER BY file, seq) AS n FROM both_) WHERE n = 1""")
def merged_messages(spark, sf_dir):
    rows = messages(spark, sf_dir).withColumn("file", F.lit(1))
    again = rows.where("seq % 2 = 0").withColumn("text", F.upper("text")).withColumn("file", F.lit(2))
    return model.merge_messages(rows.union(again), ["file", "seq"]).select("id", "text", "copies")


@query(f"""WITH {DOCUMENTS}, rows_ AS (SELECT id % 200 AS id, id AS ord, cwd, CASE WHEN id % 3 = 0 THEN source END AS surface, CASE WHEN id % 5 = 0 THEN left(text, 20) END AS title FROM docs)
    SELECT id, arg_min(cwd, ord) FILTER (cwd IS NOT NULL) AS cwd, arg_min(surface, ord) FILTER (surface IS NOT NULL) AS surface, arg_min(title, ord) FILTER (title IS NOT NULL) AS title FROM rows_ GROUP BY id""")
def merged_conversations(spark, sf_dir):
    rows = documents(spark, sf_dir).select(
        (F.col("id") % 200).alias("id"), F.col("id").alias("ord"), "cwd", F.when(F.col("id") % 3 == 0, F.col("source")).alias("surface"), F.when(F.col("id") % 5 == 0, F.substring("text", 1, 20)).alias("title")
    )
    return model.merge_conversations(rows, ["ord"], ["cwd", "surface", "title"])


@query(f"""WITH {MESSAGES}, c AS (SELECT conv_id, max(CASE WHEN seq = 2 THEN left(text, 10) END) AS custom, max(CASE WHEN seq = 1 AND conv_id % 2 = 0 THEN left(text, 12) END) AS generated, max(CASE WHEN seq = 0 THEN left(text, 14) END) AS first_user FROM messages GROUP BY 1)
    SELECT conv_id, coalesce(nullif(trim(custom), ''), nullif(trim(generated), ''), nullif(trim(first_user), '')) AS title,
    CASE WHEN nullif(trim(custom), '') IS NOT NULL THEN 'custom' WHEN nullif(trim(generated), '') IS NOT NULL THEN 'generated' WHEN nullif(trim(first_user), '') IS NOT NULL THEN 'first_user' END AS title_origin FROM c""")
def title_fold(spark, sf_dir):
    at = lambda n, k, also=F.lit(True): F.max(F.when((F.col("seq") == n) & also, F.substring("text", 1, k)))
    rows = messages(spark, sf_dir).groupBy("conv_id").agg(at(2, 10).alias("custom"), at(1, 12, F.col("conv_id") % 2 == 0).alias("generated"), at(0, 14).alias("first_user"))
    return model.titles(rows).select("conv_id", "title", "title_origin")


@query(f"""WITH {MESSAGES}, s AS (SELECT *, 'src' || (conv_id % 3) AS source FROM messages), seen AS (SELECT source, count(DISTINCT conv_id) AS conversations, count(*) AS messages, count(*) FILTER (kind = 'prose') AS prose,
    count(*) - count(DISTINCT id) AS duplicates, sum(strlen(text))::BIGINT AS text_bytes FROM s GROUP BY source), conf(source) AS (VALUES ('src0'), ('src1'), ('src9'))
    SELECT coalesce(seen.source, conf.source) AS source, coalesce(conversations, 0) AS conversations, coalesce(messages, 0) AS messages, coalesce(prose, 0) AS prose, coalesce(duplicates, 0) AS duplicates, coalesce(text_bytes, 0) AS text_bytes,
    conf.source IS NOT NULL AS configured, CASE WHEN coalesce(messages, 0) > 0 THEN 'ok' ELSE 'no rows' END AS reason FROM seen FULL JOIN conf ON seen.source = conf.source""")
def build_report(spark, sf_dir):
    rows = messages(spark, sf_dir).withColumn("source", F.concat(F.lit("src"), (F.col("conv_id") % 3).cast("string")))
    return model.build_report(rows, spark.createDataFrame([("src0",), ("src1",), ("src9",)], "source string"))


@query(f"""WITH {MESSAGES}, f AS (SELECT conv_id, parent_id, count(*) AS n FROM messages WHERE parent_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
    SELECT (SELECT count(*) FROM f) AS branch_nodes, (SELECT count(DISTINCT conv_id) FROM f) AS branched_conversations, (SELECT count(*) FROM messages WHERE NOT on_head_path) AS off_path""")
def branch_census(spark, sf_dir):
    return model.branch_census(messages(spark, sf_dir))


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey // 7 * 7 // 2 END AS raw FROM customer),
    l AS (SELECT id, CASE WHEN raw IN (SELECT id FROM c) AND raw < id THEN raw END AS up FROM c),
    w AS (SELECT id, id AS root, up, 0 AS depth FROM l UNION ALL SELECT w.id, l.id, l.up, w.depth + 1 FROM w JOIN l ON l.id = w.up)
    SELECT id, root, depth, count(*) OVER (PARTITION BY root) AS family FROM w WHERE up IS NULL""")
def fork_lineage(spark, sf_dir):
    key = F.col("c_custkey")
    raw = F.when(key % 7 != 0, F.floor(F.floor(key / 7) * 7 / 2))
    rows = table(spark, sf_dir, "customer").select(key.alias("id"), F.when(raw < key, raw).alias("forked_from"))
    return model.fork_tree(rows)


@query("""WITH b AS (SELECT doc_id, strlen(text) AS n, encode(text) AS e FROM documents),
    cut AS (SELECT doc_id, n, CASE WHEN n <= 1024 THEN n ELSE (SELECT max(k) FROM range(1021, 1025) t(k) WHERE NOT (hex(e[k + 1:k + 1]) BETWEEN '80' AND 'BF')) END AS kept FROM b)
    SELECT doc_id, kept::INT AS kept_bytes, (n - kept)::INT AS dropped FROM cut""")
def clipped_text(spark, sf_dir):
    clipped = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n"), clip_bytes(F.col("text"), 1024, "|%d").alias("c"))
    dropped = F.when(F.col("n") <= 1024, 0).otherwise(F.expr("try_cast(substring_index(c, '|', -1) as int)"))
    return clipped.select("doc_id", (F.col("n") - dropped).alias("kept_bytes"), dropped.alias("dropped"))


# --- postings and search --------------------------------------------------------------------------------------------

TOKENS = rf"regexp_extract_all(translate(lower(text), '{MARKED}', '{PLAIN}'), '[\p{{L}}\p{{N}}]+')"
POSTINGS = f"""prose AS (SELECT id, unnest({TOKENS}) AS term FROM messages WHERE kind = 'prose'),
    post AS (SELECT id AS msg_id, term, count(*) AS tf FROM prose GROUP BY ALL), len AS (SELECT msg_id, sum(tf)::BIGINT AS length FROM post GROUP BY 1),
    st AS (SELECT count(*) AS n, avg(length) AS a FROM len)"""
#: Queries from the benchmark: every two words in a row of every item, each fifth with its second word as a prefix, and an empty one.
ASKED = f"""asked AS (SELECT item_id + i * 100000 AS qid, i, CASE WHEN i + 1 < len(ws) THEN [ws[i + 1], ws[i + 2]] ELSE [] END AS terms FROM (SELECT item_id, ws, unnest(range(0, len(ws))) AS i FROM (SELECT item_id, {TOKENS} AS ws FROM benchmark))),
    qt AS (SELECT qid, unnest(terms) AS term, generate_subscripts(terms, 1) = 2 AND i % 5 = 0 AS is_prefix FROM asked)"""
MATCHED = f"""hits AS (SELECT q.term, q.is_prefix, p.msg_id, sum(p.tf)::BIGINT AS tf FROM (SELECT DISTINCT term, is_prefix FROM qt) q JOIN post p ON p.term = q.term OR (q.is_prefix AND starts_with(p.term, q.term)) GROUP BY ALL),
    df AS (SELECT term, is_prefix, count(*) AS df FROM hits GROUP BY ALL),
    w AS (SELECT h.term, h.is_prefix, h.msg_id, -(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / a))) AS weight
        FROM hits h JOIN df ON df.term = h.term AND df.is_prefix = h.is_prefix JOIN len ON len.msg_id = h.msg_id CROSS JOIN st),
    want AS (SELECT qid, term, is_prefix, count(*) AS times FROM qt GROUP BY ALL), need AS (SELECT qid, count(*) AS need FROM want GROUP BY qid),
    matches AS (SELECT want.qid, w.msg_id, sum(weight * times) AS score FROM want JOIN w ON w.term = want.term AND w.is_prefix = want.is_prefix JOIN need ON need.qid = want.qid GROUP BY want.qid, w.msg_id, need HAVING count(*) = need)"""
DECAYED = f"""scored AS (SELECT qid, m.conv_id, m.seq, msg_id, score / (1 + 0.3 * greatest(0, {NOW} - ts_ms) / {365 * 86400000}.0) AS score FROM matches JOIN messages m ON m.id = msg_id WHERE on_head_path)"""
SEARCH = f"WITH {MESSAGES}, {POSTINGS}, {ASKED}, {MATCHED}, {DECAYED}"
GROUPED = """g AS (SELECT qid, conv_id AS row_id, min(score) + 0.25 * (sum(score) - min(score)) AS score, count(*) AS match_count, string_agg(seq, ',' ORDER BY seq) AS positions FROM scored GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9), row_id) AS rank FROM g)"""


def asked(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", tokenize(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    each = words.select("item_id", "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - 1)).alias("i"))
    two = F.concat(F.array_join(F.slice("ws", F.col("i") + 1, 2), " "), F.when(F.col("i") % 5 == 0, "").otherwise(" "))
    return search.prepare_queries(each.select((F.col("item_id") + F.col("i").cast("long") * 100_000).alias("qid"), F.when(F.col("i") + 1 < F.size("ws"), two).otherwise("").alias("q")))


def indexed(spark, sf_dir, stemmed=False):
    """Postings of all messages, written once for the several joins of a search."""
    return stored(postings.build(messages(spark, sf_dir), stemmed), "postings")


def found(spark, sf_dir, limit=20):
    hits = search.match(asked(spark, sf_dir), indexed(spark, sf_dir))
    return search.grouped(hits, messages(spark, sf_dir), NOW, limit)


@query(SEARCH + f", {GROUPED} SELECT qid, rank::INT AS rank, row_id, score, match_count, positions FROM ranked WHERE rank <= 20")
def grouped_search(spark, sf_dir):
    return found(spark, sf_dir).select("qid", "rank", "row_id", "score", "match_count", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query(SEARCH + " SELECT qid, msg_id, conv_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9), msg_id) AS rank FROM scored) WHERE rank <= 50")
def flat_search(spark, sf_dir):
    rows = messages(spark, sf_dir)
    hits = search.match(asked(spark, sf_dir), indexed(spark, sf_dir))
    return search.flat(hits, rows, NOW, 50)


@query(SEARCH + " SELECT qid, count(DISTINCT conv_id) AS total, least(count(DISTINCT conv_id), 20) AS shown FROM scored GROUP BY qid")
def search_totals(spark, sf_dir):
    rows = messages(spark, sf_dir)
    return search.totals(search.match(asked(spark, sf_dir), indexed(spark, sf_dir)), rows, 20).select("qid", "total", "shown")


@query(SEARCH + f""", {GROUPED}, sizes AS (SELECT conv_id, count(*) AS n FROM messages GROUP BY 1), cells AS (SELECT s.qid, s.conv_id AS row_id, least(floor(s.seq * 10 / n), 9)::INT AS cell, count(*) AS c
    FROM scored s JOIN ranked r ON r.qid = s.qid AND r.row_id = s.conv_id JOIN sizes ON sizes.conv_id = s.conv_id WHERE rank <= 20 GROUP BY ALL) SELECT qid, row_id, cell, CASE WHEN c = 1 THEN 1 WHEN c <= 3 THEN 2 ELSE 3 END AS level FROM cells""")
def match_histogram(spark, sf_dir):
    sizes = model.rollup(messages(spark, sf_dir)).select("conv_id", "msg_count")
    return search.match_histogram(found(spark, sf_dir), sizes)


@query(SEARCH + f""", {GROUPED}, h AS (SELECT qid, CASE WHEN row_id % 4 <> 0 THEN 'axis' || (row_id % 4) END AS value, min(rank) AS first_rank, count(*) AS rows FROM ranked WHERE rank <= 20 GROUP BY ALL)
    SELECT qid, value, first_rank::INT AS first_rank, rows, row_number() OVER (PARTITION BY qid ORDER BY value IS NULL, first_rank)::INT AS place FROM h""")
def results_by_axis(spark, sf_dir):
    axis = messages(spark, sf_dir).select(F.col("conv_id").alias("id")).distinct().withColumn("value", F.when(F.col("id") % 4 != 0, F.concat(F.lit("axis"), (F.col("id") % 4).cast("string"))))
    return search.group_by_axis(found(spark, sf_dir), axis)


@query(f"WITH {MESSAGES}, {POSTINGS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term")
def term_statistics(spark, sf_dir):
    return postings.term_stats(postings.build(messages(spark, sf_dir)).where("field = 'prose'")).select("term", "df", "cf")


@query(f"WITH p AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), t AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL) SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS length, max(tf) AS most FROM t GROUP BY doc_id")
def document_postings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("prose").alias("kind"), "text")
    return postings.build(docs).groupBy(F.col("msg_id").alias("doc_id")).agg(F.count("*").alias("terms"), F.sum("tf").alias("length"), F.max("tf").alias("most"))


# --- filters and facets ---------------------------------------------------------------------------------------------


@query(f"""WITH {DOCUMENTS} SELECT id FROM docs WHERE source IN ('src1', 'src2', 'src3') AND source <> 'src3' AND (lower(coalesce(cwd, '')) LIKE '%langen%' OR lower(coalesce(cwd, '')) LIKE '%/p1%')
    AND lower(coalesce(cwd, '')) NOT LIKE '%p12%' AND ended_at >= {START_MS} AND NOT coalesce(ended_at >= {START_MS + 10 * 86400000} AND ended_at < {START_MS + 20 * 86400000}, false)""".replace("'%langen%'", "'%/home/lang%'"))
def filtered_documents(spark, sf_dir):
    rows = documents(spark, sf_dir)
    rows = rows.where(filters.by_source(["src1", "src2", "src3"], ["src3"])).where(filters.by_substring(["/home/LANG", "/p1"], ["P12"]))
    return rows.where(filters.by_windows([(START_MS, None, False), (START_MS + 10 * 86_400_000, START_MS + 20 * 86_400_000, True)])).select("id")


@query(f"""WITH {DOCUMENTS}, c AS (SELECT source, count(*) AS conversations FROM docs GROUP BY source), w AS (SELECT DISTINCT 'src' || (o_custkey % 25) AS source FROM orders)
    SELECT coalesce(c.source, w.source) AS source, coalesce(conversations, 0) AS conversations, w.source IS NOT NULL AS watched,
    CASE WHEN w.source IS NOT NULL AND conversations > 0 THEN 'covered' WHEN w.source IS NOT NULL THEN 'empty' ELSE 'unwatched' END AS state FROM c FULL JOIN w ON c.source = w.source""")
def source_coverage(spark, sf_dir):
    watched = table(spark, sf_dir, "orders").select(F.concat(F.lit("src"), (F.col("o_custkey") % 25).cast("string")).alias("source")).distinct()
    return facets.source_coverage(documents(spark, sf_dir), watched)


@query(f"WITH {DOCUMENTS} SELECT cwd, count(*) AS conversations FROM docs WHERE coalesce(cwd, '') <> '' GROUP BY cwd")
def dir_census(spark, sf_dir):
    return facets.dir_census(documents(spark, sf_dir))


@query(f"WITH {DOCUMENTS} SELECT count(DISTINCT nullif(cwd, '')) AS dirs, count(*) FILTER (coalesce(cwd, '') = '') AS without FROM docs")
def dir_totals(spark, sf_dir):
    return facets.dir_totals(documents(spark, sf_dir))


CENSUS_NOW = START_MS + 40 * 86_400_000 + 3_600_000


@query(f"""WITH {LOG}, e AS (SELECT epoch_ms(date_trunc('day', make_timestamp({CENSUS_NOW} * 1000))) AS d, {CENSUS_NOW} - 7 * 86400000 AS w, epoch_ms(make_timestamp({CENSUS_NOW} * 1000) - INTERVAL 1 MONTH) AS m),
    c AS (SELECT count(*) FILTER (ts_ms >= d AND ts_ms < d + 86400000) AS today, count(*) FILTER (ts_ms >= w) AS week, count(*) FILTER (ts_ms >= m) AS month, count(*) FILTER (ts_ms < m) AS older FROM log, e)
    UNPIVOT c ON today, week, month, older INTO NAME span VALUE conversations""")
def date_census(spark, sf_dir):
    return facets.date_census(log(spark, sf_dir).withColumnRenamed("ts_ms", "ended_at"), CENSUS_NOW)


@query(f"""WITH {DOCUMENTS}, c AS (SELECT source, count(*) AS conversations FROM docs GROUP BY source), q AS (SELECT item_id AS qid, 'SRC' || (item_id % 20) AS inc, 'src' || (item_id % 7) AS exc FROM benchmark)
    SELECT qid, source, conversations, CASE WHEN source = lower(exc) THEN 'exclude' WHEN source = lower(inc) THEN 'include' ELSE 'off' END AS state FROM q CROSS JOIN c""")
def facet_rail(spark, sf_dir):
    qid = F.col("item_id")
    asks = table(spark, sf_dir, "benchmark").select(qid.alias("qid"), F.array(F.concat(F.lit("SRC"), (qid % 20).cast("string"))).alias("include"), F.array(F.concat(F.lit("src"), (qid % 7).cast("string"))).alias("exclude"))
    return facets.rail(asks, facets.source_census(documents(spark, sf_dir)), "source")


TIMELINE = """a AS (SELECT min(ts_ms) AS lo0, date_diff('day', make_timestamp(min(ts_ms) * 1000)::DATE, make_timestamp(max(ts_ms) * 1000)::DATE) + 1 AS days, make_timestamp(min(ts_ms) * 1000)::DATE AS lo FROM t),
    s AS (SELECT lo, days, ceil(days / 180.0)::INT AS step FROM a), b AS (SELECT ceil(days / step::DOUBLE)::INT AS bars, lo, step FROM s)"""


@query(f"""WITH t AS (SELECT epoch_us(o_orderdate) // 1000 AS ts_ms, o_orderpriority AS source FROM orders), {TIMELINE},
    c AS (SELECT least(floor(date_diff('day', lo, make_timestamp(ts_ms * 1000)::DATE) / step), bars - 1)::INT AS bucket, source, count(*) AS n FROM t, b GROUP BY ALL)
    SELECT i::INT AS bucket, strftime(lo + (i * step)::INT, '%Y-%m-%d') AS day, source, coalesce(n, 0) AS n FROM b, range(0, (SELECT bars FROM b)) r(i) LEFT JOIN c ON c.bucket = i""")
def order_timeline(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ended_at"), F.col("o_orderpriority").alias("source"))
    return timeline.build(rows)


@query(f"""WITH {LOG}, t AS (SELECT * FROM log), {TIMELINE}, c AS (SELECT least(floor(date_diff('day', lo, make_timestamp(ts_ms * 1000)::DATE) / step), bars - 1)::INT AS bucket, source, count(*) AS n FROM t, b GROUP BY ALL)
    SELECT i::INT AS bucket, strftime(lo + (i * step)::INT, '%Y-%m-%d') AS day, source, coalesce(n, 0) AS n FROM b, range(0, (SELECT bars FROM b)) r(i) LEFT JOIN c ON c.bucket = i""")
def event_timeline(spark, sf_dir):
    return timeline.build(log(spark, sf_dir).withColumnRenamed("ts_ms", "ended_at"))


@query(f"""WITH q AS (SELECT item_id AS qid, {START_MS} + item_id * 1000 AS f1, {START_MS} + item_id * 5000 AS u1, {START_MS} + item_id * 2000 AS f2 FROM benchmark)
    SELECT qid, greatest(f1, f2) AS from_ms, u1 AS until_ms FROM q""")
def selected_window(spark, sf_dir):
    qid = F.col("item_id")
    window = lambda a, b, neg: F.struct(a.cast("long").alias("from_ms"), b.cast("long").alias("until_ms"), F.lit(neg).alias("negated"))
    at = lambda k: F.lit(START_MS) + qid * k
    rows = table(spark, sf_dir, "benchmark").select(qid.alias("qid"), F.array(window(at(1000), at(5000), False), window(at(2000), F.lit(None), False), window(at(4000), at(4500), True)).alias("windows"))
    return timeline.selected(rows)


# --- sittings -------------------------------------------------------------------------------------------------------

ISLANDS = f"""{LOG}, f AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w < {GAP_MS} THEN 0 ELSE 1 END AS opens FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, id)),
    i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts_ms, id)::BIGINT AS island FROM f)"""


def _records(spark, sf_dir):
    return log(spark, sf_dir).withColumn("msg_count", F.col("id") % 5 + 1)


@query(f"""WITH {ISLANDS}, m AS (SELECT *, id % 5 + 1 AS msg_count FROM i) SELECT * EXCLUDE (opens, island, source, q, value) FROM (SELECT *, first_value(id) OVER w AS sitting_id, count(*) OVER (PARTITION BY user_id, island) AS members, row_number() OVER w AS position,
    coalesce(sum(msg_count) OVER (PARTITION BY user_id, island ORDER BY ts_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS message_offset FROM m WINDOW w AS (PARTITION BY user_id, island ORDER BY ts_ms, id)) WHERE members > 1""")
def sitting_members(spark, sf_dir):
    return sittings.build(_records(spark, sf_dir), ["user_id"], "ts_ms", gap_ms=GAP_MS)


@query(f"""WITH {ISLANDS} SELECT min_by(id, ts_ms::HUGEINT * 10000000 + id) AS sitting_id, max(ts_ms) AS ts_ms, sum(id % 5 + 1)::BIGINT AS msg_count, count(*) AS members FROM i GROUP BY user_id, island HAVING count(*) > 1""")
def sitting_totals(spark, sf_dir):
    return sittings.totals(sittings.build(_records(spark, sf_dir), ["user_id"], "ts_ms", gap_ms=GAP_MS), "ts_ms")


@query(f"""WITH {ISLANDS} SELECT id, first_value(id) OVER w AS group_id, coalesce(sum(id % 5 + 1) OVER (PARTITION BY user_id, island ORDER BY ts_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS message_offset,
    row_number() OVER w = 1 AS opens FROM i WINDOW w AS (PARTITION BY user_id, island ORDER BY ts_ms, id)""")
def sittings_attached(spark, sf_dir):
    rows = _records(spark, sf_dir)
    return sittings.attach(rows, sittings.build(rows, ["user_id"], "ts_ms", gap_ms=GAP_MS)).select("id", "group_id", "message_offset", "opens")


@query(f"""WITH {LOG}, f AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w < 3600000 THEN 0 ELSE 1 END AS opens FROM log WINDOW w AS (PARTITION BY source ORDER BY ts_ms, id)) SELECT source, id, sum(opens) OVER (PARTITION BY source ORDER BY ts_ms, id)::BIGINT AS island FROM f""")
def wide_islands(spark, sf_dir):
    return sittings.gap_islands_wide(log(spark, sf_dir), ["source"], "ts_ms", "id", 3_600_000).select("source", "id", "island")


@query(f"""WITH {LOG}, f AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w <= 259200000 THEN 0 ELSE 1 END AS opens FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, id)), i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts_ms, id)::BIGINT AS island FROM f)
    SELECT user_id, island, min(ts_ms) AS started, max(ts_ms) AS ended, count(*) AS size FROM i GROUP BY ALL HAVING count(*) >= 2""")
def lineages(spark, sf_dir):
    return sittings.lineages(log(spark, sf_dir), "user_id", "ts_ms", "id")


@query(f"""WITH RECURSIVE {LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, id) AS n FROM log),
    w AS (SELECT user_id, n, ts_ms, source, ts_ms AS started FROM o WHERE n = 1 UNION ALL
        SELECT o.user_id, o.n, o.ts_ms, o.source, CASE WHEN o.ts_ms - w.ts_ms > 43200000 OR o.ts_ms - w.started > 86400000 THEN o.ts_ms ELSE w.started END FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)
    SELECT user_id, started, max(ts_ms) AS ended, count(*) AS items, count(DISTINCT source) AS sources FROM w GROUP BY ALL""")
def bounded_sessions(spark, sf_dir):
    return sittings.bounded_sessions(log(spark, sf_dir), ["user_id"], "ts_ms", "id", 43_200_000, 86_400_000)


# --- transcripts ----------------------------------------------------------------------------------------------------

BLOCKS = f"""{MESSAGES}, blocks AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY is_sidechain, thread_key, seq, id) - 1 AS position,
    CASE WHEN kind = 'reasoning' THEN 'reasoning' WHEN kind IN ('tool_call', 'tool_result') THEN 'tool' WHEN role = 'user' THEN 'user' ELSE 'agent' END AS band, kind <> 'tool_result' OR is_error AS drawn FROM messages WHERE on_head_path)"""


def _blocks(spark, sf_dir):
    return transcript.read(messages(spark, sf_dir))


@query(f"WITH {BLOCKS} SELECT id, conv_id, position::INT AS position, band, drawn FROM blocks")
def transcript_read(spark, sf_dir):
    return _blocks(spark, sf_dir).select("id", "conv_id", "position", "band", "drawn")


@query(f"""WITH {BLOCKS}, f AS (SELECT *, CASE WHEN lag(band) OVER (PARTITION BY conv_id ORDER BY position) = band THEN 0 ELSE 1 END AS new FROM blocks WHERE drawn),
    r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY position)::BIGINT AS run FROM f) SELECT conv_id, run, band, count(*) AS n FROM r GROUP BY ALL""")
def kind_runs(spark, sf_dir):
    return transcript.kind_runs(_blocks(spark, sf_dir))


@query(f"WITH {BLOCKS} SELECT conv_id, count(DISTINCT thread_key) AS threads, count(*) AS total, count(*) FILTER (drawn) AS drawn FROM blocks GROUP BY conv_id")
def transcript_summary(spark, sf_dir):
    return transcript.summary(_blocks(spark, sf_dir))


@query(f"""WITH {BLOCKS}, f AS (SELECT *, ts_ms - lag(ts_ms) OVER w AS silence, (band = 'user' OR lag(thread_key) OVER w IS DISTINCT FROM thread_key)::INT AS new FROM blocks WINDOW w AS (PARTITION BY conv_id ORDER BY position)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY position)::BIGINT AS segment FROM f) SELECT conv_id, segment, count(*) AS messages, count(*) FILTER (kind = 'tool_call') AS calls, count(*) FILTER (is_error) AS failures,
    count(*) FILTER (band = 'agent' AND rtrim(text) LIKE '%?') AS questions, max(CASE WHEN k = 1 THEN silence END) AS silence_before FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, segment ORDER BY position) AS k FROM s) GROUP BY ALL""")
def segments(spark, sf_dir):
    return transcript.segments(_blocks(spark, sf_dir))


@query(f"WITH {BLOCKS}, f AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY conv_id ORDER BY position) AS gap FROM blocks) SELECT conv_id % 10 AS project, count(*) AS messages, count(*) FILTER (is_error) AS failures, count(*) FILTER (band = 'agent' AND rtrim(text) LIKE '%?') AS questions, count(*) FILTER (gap > 120000) AS pauses FROM f GROUP BY 1")
def group_statistics(spark, sf_dir):
    return projects.group_stats(transcript.annotate(_blocks(spark, sf_dir), 120_000).withColumn("project", F.col("conv_id") % 10), ["project"]).drop("compactions")


@query(f"""WITH {BLOCKS}, c AS (SELECT *, floor(position * least(n, 4) / n)::INT AS cell, CASE WHEN band IN ('user', 'agent') THEN 3 WHEN band = 'reasoning' THEN 2 ELSE 1 END AS rank FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM blocks))
    SELECT conv_id, cell, arg_max(band, rank * 100000 - position) AS band, round(max(log10(length(text) + 1)), 6) AS size FROM c GROUP BY ALL""")
def shape_cells(spark, sf_dir):
    return transcript.downsample(_blocks(spark, sf_dir), 4).withColumn("size", r6("size"))


# --- logs and evaluation --------------------------------------------------------------------------------------------

UNREAD = 6 * 3_600_000
#: Driven spans that overlap one another: one of each order, 20 to 24 minutes from a full hour of a day on.
SPAN_SQL = f"spans AS (SELECT f AS from_ms, f + 1200000 + k % 5 * 60000 AS until_ms FROM (SELECT o_orderkey AS k, {START_MS} + o_orderkey % 400 * 86400000 + o_custkey % 24 * 3600000 AS f FROM orders))"
KEEPING = f"""kept AS (SELECT *, CASE WHEN id % 4 = 3 THEN 'pick' ELSE 'search' END AS kind, id % 10 AS conv_id FROM log l WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE l.ts_ms >= from_ms AND l.ts_ms < until_ms)),
    ab AS (SELECT *, coalesce(kind = 'search' AND lead(ts_ms) OVER w - ts_ms <= {UNREAD} AND lead(source) OVER w IS NOT DISTINCT FROM source AND starts_with(lead(q) OVER w, q) AND trim(q) <> '', false) AS absorbed FROM kept WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, id))"""
KEPT = f"{LOG}, {SPAN_SQL}, {KEEPING}"
#: As KEPT, with two hours from the first of a day on, the same for many orders.
KEPT_ALL = f"{LOG}, spans AS (SELECT DISTINCT {START_MS} + o_orderkey % 400 * 86400000 AS from_ms, {START_MS} + o_orderkey % 400 * 86400000 + 7200000 AS until_ms FROM orders), {KEEPING}"
NEEDS = """n AS (SELECT q, count(*) FILTER (kind = 'search') AS searches, max(ts_ms) AS last_ts FROM ab WHERE NOT absorbed AND trim(q) <> '' GROUP BY q), p AS (SELECT q, conv_id, count(*) AS n FROM ab WHERE NOT absorbed AND kind = 'pick' AND trim(q) <> '' GROUP BY ALL)
    SELECT n.q, searches, last_ts, coalesce((SELECT string_agg(conv_id || '×' || n, ',' ORDER BY n DESC, conv_id) FROM p WHERE p.q = n.q), '') AS picks FROM n"""
NEED_TOTALS = "SELECT count(*) AS kept, count(*) FILTER (absorbed) AS keystrokes, count(*) FILTER (trim(q) = '') AS browsed, (SELECT count(*) FROM log) AS events, (SELECT count(*) FROM log) - count(*) AS driven FROM ab"


def _log(spark, sf_dir):
    kinds = F.when(F.col("id") % 4 == 3, "pick").otherwise("search")
    return log(spark, sf_dir).withColumn("kind", kinds).withColumn("conv_id", F.col("id") % 10)


def _spans(spark, sf_dir, long=False):
    """A span of each order: those of KEPT, or the long ones of KEPT_ALL."""
    key = F.col("o_orderkey")
    day = F.lit(START_MS) + key % 400 * 86_400_000
    start = day if long else day + F.col("o_custkey") % 24 * 3_600_000
    return table(spark, sf_dir, "orders").select(start.alias("from_ms"), (start + (F.lit(7_200_000) if long else 1_200_000 + key % 5 * 60_000)).alias("until_ms"))


def _absorbed(spark, sf_dir, long=False):
    return logfold.absorb(logfold.exclude_spans(_log(spark, sf_dir), _spans(spark, sf_dir, long)), ["user_id"], UNREAD)


@query(f"WITH {KEPT} SELECT id, absorbed FROM ab")
def absorbed_keystrokes(spark, sf_dir):
    return _absorbed(spark, sf_dir).select("id", "absorbed")


@query(f"WITH {KEPT_ALL} SELECT id, absorbed FROM ab")
def absorbed_keystrokes_all_spans(spark, sf_dir):
    return _absorbed(spark, sf_dir, True).select("id", "absorbed")


@query(f"WITH {KEPT}, {NEEDS}")
def needs(spark, sf_dir):
    return logfold.run(_log(spark, sf_dir), _spans(spark, sf_dir), ["user_id"], UNREAD)


@query(f"WITH {KEPT_ALL}, {NEEDS}")
def needs_all_spans(spark, sf_dir):
    return logfold.run(_log(spark, sf_dir), _spans(spark, sf_dir, True), ["user_id"], UNREAD)


@query(f"WITH {KEPT} {NEED_TOTALS}")
def need_totals(spark, sf_dir):
    return logfold.fold_totals(_log(spark, sf_dir), _absorbed(spark, sf_dir))


@query(f"WITH {KEPT_ALL} {NEED_TOTALS}")
def need_totals_all_spans(spark, sf_dir):
    return logfold.fold_totals(_log(spark, sf_dir), _absorbed(spark, sf_dir, True))


GRADES = "grades AS (SELECT doc_id % 40 AS qid, doc_id AS conv_id, quality * 2 + 1 - toxic AS grade FROM labels)"
RESULTS = "results AS (SELECT qid, conv_id, row_number() OVER (PARTITION BY qid ORDER BY n_chars DESC, conv_id)::INT AS rank FROM (SELECT doc_id % 40 AS qid, doc_id AS conv_id, n_chars FROM documents))"
SCORED = f"""{GRADES}, {RESULTS}, own AS (SELECT r.qid, sum((pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS dcg, coalesce(max(CASE WHEN grade >= 2 THEN 1.0 / rank END), 0) AS rr, coalesce(bool_or(rank = 1 AND grade = 3), false) AS exact1,
    coalesce(bool_or(rank = 1 AND grade >= 2), false) AS hit1, coalesce(bool_or(rank <= 5 AND grade >= 2), false) AS hit5, count(*) AS shown, count(*) FILTER (grade IS NULL) AS unjudged FROM results r LEFT JOIN grades g ON g.qid = r.qid AND g.conv_id = r.conv_id WHERE rank <= 10 GROUP BY r.qid),
    ideal AS (SELECT qid, sum((pow(2, grade) - 1) / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, conv_id) AS r FROM grades) WHERE r <= 10 GROUP BY qid),
    lost AS (SELECT qid, count(*) AS missed FROM grades g WHERE grade >= 2 AND NOT EXISTS (SELECT 1 FROM results r WHERE r.qid = g.qid AND r.conv_id = g.conv_id) GROUP BY qid),
    scores AS (SELECT own.qid, CASE WHEN ideal > 0 THEN dcg / ideal END AS ndcg, rr, exact1, hit1, hit5, shown, unjudged, coalesce(missed, 0) AS missed FROM own LEFT JOIN ideal USING (qid) LEFT JOIN lost USING (qid))"""


def _grades(spark, sf_dir):
    grade = F.col("quality") * 2 + 1 - F.col("toxic")
    return table(spark, sf_dir, "labels").select((F.col("doc_id") % 40).alias("qid"), F.col("doc_id").alias("conv_id"), grade.alias("grade"))


def _results(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("qid"), F.col("doc_id").alias("conv_id"), "n_chars")
    return search.ranked(rows, 2**31 - 1, [F.desc("n_chars"), "conv_id"]).select("qid", "conv_id", "rank")


@query(f"WITH {SCORED} SELECT * REPLACE (round(ndcg, 6) AS ndcg, round(rr, 6) AS rr) FROM scores")
def query_scores(spark, sf_dir):
    return evaluate.score(_results(spark, sf_dir), _grades(spark, sf_dir)).withColumn("ndcg", r6("ndcg")).withColumn("rr", r6("rr"))


@query(f"""WITH {SCORED} SELECT round(avg(ndcg), 6) AS mean_ndcg, round(avg(rr), 6) AS mrr, round(avg(hit1::INT), 6) AS success1, round(avg(hit5::INT), 6) AS success5, round(avg(exact1::INT), 6) AS exact1, count(ndcg) AS scored, count(*) - count(ndcg) AS unscorable,
    round(1 - sum(unjudged) / sum(shown), 6) AS coverage FROM scores""")
def set_report(spark, sf_dir):
    out = evaluate.report(evaluate.score(_results(spark, sf_dir), _grades(spark, sf_dir)))
    return out.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(f"WITH {GRADES} SELECT qid, conv_id, grade FROM grades g WHERE conv_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)")
def dangling_grades(spark, sf_dir):
    return evaluate.dangling(_grades(spark, sf_dir), table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"))).select("qid", "conv_id", "grade")


@query(f"""WITH {RESULTS}, alt AS (SELECT qid, conv_id, row_number() OVER (PARTITION BY qid ORDER BY n_chars, conv_id) AS rank FROM (SELECT doc_id % 40 AS qid, doc_id AS conv_id, n_chars FROM documents)),
    u AS (SELECT qid, conv_id, 0 AS no, 'longest' AS variant FROM results WHERE rank <= 10 UNION ALL SELECT qid, conv_id, 1, 'shortest' FROM alt WHERE rank <= 10) SELECT qid, conv_id, arg_min(variant, no) AS variant FROM u GROUP BY ALL""")
def pooled_results(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("qid"), F.col("doc_id").alias("conv_id"), "n_chars")
    return evaluate.pool({"longest": _results(spark, sf_dir), "shortest": search.ranked(rows, 10, ["n_chars", "conv_id"])}, 10)


GRID = [(d, w) for d in (0.0, 0.3, 1.0) for w in (0.0, 0.25)]


@query(
    f"""WITH {GRADES}, grid(decay, repeat_weight) AS (VALUES {", ".join(f"({d}::DOUBLE, {w}::DOUBLE)" for d, w in GRID)}), s AS (SELECT doc_id % 40 AS qid, doc_id // 3 AS conv_id, -(1 + n_chars % 97)::DOUBLE AS score, {START_MS} + doc_id * 3600000 AS ts_ms FROM documents),
    d AS (SELECT decay, repeat_weight, qid, conv_id, score / (1 + decay * greatest(0, {NOW} - ts_ms) / {365 * 86400000}.0) AS x FROM s, grid), g AS (SELECT decay, repeat_weight, qid, conv_id, min(x) + repeat_weight * (sum(x) - min(x)) AS x FROM d GROUP BY decay, repeat_weight, qid, conv_id),
    results AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY decay, repeat_weight, qid ORDER BY x, conv_id) AS rank FROM g) WHERE rank <= 10),
    own AS (SELECT r.decay, r.repeat_weight, r.qid, sum((pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS dcg, coalesce(max(CASE WHEN grade >= 2 THEN 1.0 / rank END), 0) AS rr FROM results r LEFT JOIN grades g ON g.qid = r.qid AND g.conv_id = r.conv_id GROUP BY ALL),
    ideal AS (SELECT qid, sum((pow(2, grade) - 1) / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, conv_id) AS r FROM grades) WHERE r <= 10 GROUP BY qid)
    SELECT decay, repeat_weight, round(avg(CASE WHEN ideal > 0 THEN dcg / ideal END), 4) AS mean_ndcg, round(avg(rr), 4) AS mrr FROM own LEFT JOIN ideal USING (qid) GROUP BY ALL"""
)
def parameter_sweep(spark, sf_dir):
    d = F.col("doc_id")
    scored = table(spark, sf_dir, "documents").select((d % 40).alias("qid"), F.floor(d / 3).alias("conv_id"), (-(1 + F.col("n_chars") % 97)).cast("double").alias("score"), (F.lit(START_MS) + d * 3_600_000).alias("ts_ms"))
    grid = spark.createDataFrame(GRID, "decay double, repeat_weight double")
    out = evaluate.sweep(scored, grid, NOW, _grades(spark, sf_dir))
    return out.select("decay", "repeat_weight", F.round("mean_ndcg", 4).alias("mean_ndcg"), F.round("mrr", 4).alias("mrr"))


#: Every match by decayed score, off-path ones too.
EVERY_RANK = f"""every_rank AS (SELECT qid, conv_id, msg_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9), msg_id) AS rank FROM
    (SELECT qid, conv_id, msg_id, score / (1 + 0.3 * greatest(0, {NOW} - ts_ms) / {365 * 86400000}.0) AS score FROM matches JOIN messages m ON m.id = msg_id))"""
VERDICTS = EVERY_RANK + """, cnt AS (SELECT conv_id, count(*) AS messages, count(*) FILTER (kind = 'prose') AS prose, count(*) FILTER (kind IN ('prose', 'tool_call', 'tool_result')) AS indexed, count(*) FILTER (NOT on_head_path) AS off_path FROM messages GROUP BY 1),
    th AS (SELECT p.qid, p.conv_id, count(DISTINCT t) FILTER (kind = 'prose') AS ti, count(DISTINCT t) AS ta FROM pairs p JOIN (SELECT qid, unnest(terms) AS t FROM asked) a ON a.qid = p.qid JOIN messages m ON m.conv_id = p.conv_id WHERE kind IN ('prose', 'reasoning') AND contains(lower(text), t) GROUP BY ALL),
    bs AS (SELECT qid, conv_id, min(rank)::INT AS best_rank, min(score) AS best FROM every_rank WHERE rank <= 500 GROUP BY ALL)
    SELECT p.qid, p.conv_id, coalesce(messages, 0) AS messages, coalesce(prose, 0) AS prose, coalesce(indexed, 0) AS indexed, coalesce(off_path, 0) AS off_path, coalesce(ta, 0) AS terms_any, best_rank, best,
    CASE WHEN cnt.conv_id IS NULL THEN 'missing' WHEN p.conv_id % 5 = 0 THEN 'filtered out' WHEN coalesce(prose, 0) = 0 THEN 'no indexed prose' WHEN len(terms) = 0 THEN 'filters only'
        WHEN coalesce(ta, 0) > 0 AND coalesce(ti, 0) = 0 THEN 'only in unindexed kind' WHEN coalesce(ta, 0) = 0 THEN 'no term anywhere' WHEN best IS NULL THEN 'present but unmatched' WHEN coalesce(off_path, 0) > 0 THEN 'ranked, off path too' ELSE 'ranked' END AS verdict
    FROM pairs p LEFT JOIN cnt ON cnt.conv_id = p.conv_id LEFT JOIN th ON th.qid = p.qid AND th.conv_id = p.conv_id LEFT JOIN bs ON bs.qid = p.qid AND bs.conv_id = p.conv_id JOIN asked ON asked.qid = p.qid"""


def _explained(spark, sf_dir, pairs):
    """pairs: (prepared queries, messages, matches) -> the (qid, conv_id) asked about."""
    rows, asks = messages(spark, sf_dir), asked(spark, sf_dir)
    found = stored(search.match(asks, indexed(spark, sf_dir)), "matches")
    pairs = pairs(asks, rows, found)
    convs = rows.select(F.col("conv_id").alias("id")).distinct()
    return explain.run(pairs, asks, convs, rows, found, pairs.where("conv_id % 5 <> 0"), NOW)


@query(SEARCH + f""", pairs AS (SELECT qid, c AS conv_id FROM (SELECT DISTINCT qid FROM asked), (SELECT conv_id AS c FROM messages UNION SELECT -1)),
    {VERDICTS}""")
def explained_pairs(spark, sf_dir):
    """Each query with every conversation, and one unknown conversation for each query."""
    rows, asks = messages(spark, sf_dir), asked(spark, sf_dir)
    found = stored(search.match(asks, indexed(spark, sf_dir)), "matches")
    convs = rows.select("conv_id").distinct()
    everything = convs.union(spark.range(1).select(F.lit(-1).cast("long"))).distinct()
    return explain.every(everything, asks, convs.withColumnRenamed("conv_id", "id"), rows, found, everything.where("conv_id % 5 <> 0"), NOW)


@query(SEARCH + f""", {GRADES}, pairs AS (SELECT qid, conv_id FROM grades UNION SELECT x.qid, m.conv_id FROM matches x JOIN messages m ON m.id = x.msg_id UNION SELECT qid, -1 FROM asked),
    {VERDICTS}""")
def explained_known_pairs(spark, sf_dir):
    """Every graded pair, every pair of a query with a conversation that it matches, and one unknown conversation for each query."""

    def pairs(asks, rows, found):
        graded = _grades(spark, sf_dir).join(asks.select("qid"), "qid", "left_semi").select("qid", "conv_id")
        matched = found.join(rows.select(F.col("id").alias("msg_id"), "conv_id"), "msg_id").select("qid", "conv_id")
        return graded.union(matched).union(asks.select("qid", F.lit(-1).cast("long"))).distinct()

    return _explained(spark, sf_dir, pairs)


# --- archive --------------------------------------------------------------------------------------------------------

MANIFEST = """ev AS (SELECT event_id AS seq, 's' || (user_id % 5) AS source, 'p' || (event_id % 700) AS path, epoch_us(ts) // 1000 AS ts, CASE WHEN event_id % 9 = 0 THEN 'vanished' WHEN event_id % 4 = 0 THEN 'appended' WHEN event_id % 5 = 0 THEN 'rewritten' ELSE 'new' END AS op, event_id % 1000 AS size, epoch_us(ts) // 1000 - 1000 AS mtime_ms FROM events),
    cur AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY source, path ORDER BY ts DESC, seq DESC) = 1)"""


def _manifest(spark, sf_dir):
    e = F.col("event_id")
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    op = F.when(e % 9 == 0, "vanished").when(e % 4 == 0, "appended").when(e % 5 == 0, "rewritten").otherwise("new")
    return table(spark, sf_dir, "events").select(
        e.alias("seq"), F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("source"), F.concat(F.lit("p"), (e % 700).cast("string")).alias("path"), ts.alias("ts"), op.alias("op"), (e % 1000).alias("size"), (ts - 1000).alias("mtime_ms")
    )


def _state(spark, sf_dir):
    return archive.current(_manifest(spark, sf_dir), ["source", "path"], ["ts", "seq"])


@query(f"WITH {MANIFEST} SELECT source, path, seq, ts, op, size, mtime_ms FROM cur")
def archive_state(spark, sf_dir):
    return _state(spark, sf_dir)


@query(f"WITH {MANIFEST}, n AS (SELECT source, max(mtime_ms) AS newest_ms FROM cur WHERE op <> 'vanished' GROUP BY source) SELECT source, newest_ms, floor(({NOW * 2} - newest_ms) / 86400000)::BIGINT AS stale_days FROM n WHERE floor(({NOW * 2} - newest_ms) / 86400000) > 7")
def archive_staleness(spark, sf_dir):
    return archive.staleness(_state(spark, sf_dir), NOW * 2)


@query(f"""WITH {MANIFEST}, k AS (SELECT *, lead(op) OVER (PARTITION BY source, path ORDER BY ts, seq) AS nx FROM ev), kk AS (SELECT *, lead(ts) OVER (PARTITION BY source, path ORDER BY ts, seq) AS valid_until FROM k WHERE coalesce(nx, '') <> 'appended')
    SELECT source, path, seq, ts AS valid_from, valid_until, valid_until IS NULL AS is_current FROM kk WHERE op <> 'vanished'""")
def archive_versions(spark, sf_dir):
    return archive.versions(_manifest(spark, sf_dir)).select("source", "path", "seq", "valid_from", "valid_until", "is_current")


@query(f"WITH {MANIFEST}, f AS (SELECT DISTINCT source, path, substr(path, 2)::BIGINT * 10 + substr(source, 2)::BIGINT AS conv_id FROM ev) SELECT conv_id, max(ts) AS deleted_at FROM f JOIN cur USING (source, path) GROUP BY conv_id HAVING min((op = 'vanished')::INT) = 1")
def archive_tombstones(spark, sf_dir):
    held = _manifest(spark, sf_dir).select("source", "path").distinct().withColumn("conv_id", F.substring("path", 2, 9).cast("long") * 10 + F.substring("source", 2, 9).cast("long"))
    return archive.tombstones(_state(spark, sf_dir), held)


LISTED = """old AS (SELECT o_orderpriority AS source, 'o' || o_orderkey AS path, o_custkey AS size, o_orderkey * 10 AS mtime_ms FROM orders WHERE o_orderkey % 5 <> 0), new_ AS (SELECT o_orderpriority AS source, 'o' || o_orderkey AS path,
    o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE 0 END AS size, o_orderkey * 10 + CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE 0 END AS mtime_ms FROM orders WHERE o_orderkey % 4 <> 0)"""


@query(f"""WITH {LISTED}, d AS (SELECT coalesce(o.source, n.source) AS source, CASE WHEN n.path IS NULL THEN 'vanished' WHEN o.path IS NULL THEN 'new' WHEN o.size = n.size AND o.mtime_ms = n.mtime_ms THEN 'same' WHEN n.size < o.size THEN 'rewritten' ELSE 'look' END AS change, n.size, o.size AS old_size
    FROM old o FULL JOIN new_ n ON o.source = n.source AND o.path = n.path) SELECT source, count(*) FILTER (change = 'new') AS "new", count(*) FILTER (change = 'appended') AS appended, count(*) FILTER (change = 'rewritten') AS rewritten, count(*) FILTER (change = 'vanished') AS vanished, count(*) FILTER (change = 'same') AS same,
    coalesce(sum(size) FILTER (change IN ('new', 'rewritten')), 0)::BIGINT AS capture_bytes FROM d GROUP BY source""")
def change_summary(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(key, F.col("o_orderpriority").alias("source"), F.concat(F.lit("o"), key.cast("string")).alias("path"), "o_custkey")
    old = orders.where(key % 5 != 0).select("source", "path", F.col("o_custkey").alias("size"), (key * 10).alias("mtime_ms"), F.lit("new").alias("op"), F.lit(None).cast("string").alias("prefix_hash"), F.lit(None).cast("long").alias("prefix_len"))
    now = orders.where(key % 4 != 0).select("source", "path", (F.col("o_custkey") - F.when(key % 7 == 0, 1).otherwise(0)).alias("size"), (key * 10 + F.when(key % 3 == 0, 5).otherwise(0)).alias("mtime_ms"))
    return archive.change_summary(archive.metadata_diff(now, old))


@query("SELECT s_suppkey AS id, s_name AS path FROM supplier s WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) AND s_name NOT IN (SELECT s_name FROM supplier WHERE s_suppkey % 4 = 0)")
def coverage_gaps(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("path"))
    claimed = rows.select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("id"), F.when(F.col("id") % 4 == 0, F.col("path")).alias("path"))
    return archive.coverage_gaps(rows, claimed)


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'missing' ELSE 'changed' END AS change FROM part WHERE p_partkey % 10 = 0 OR p_partkey % 7 = 0")
def part_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    other = rows.where("p_partkey % 10 <> 0").withColumn("p_name", F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("new "), "p_name")).otherwise(F.col("p_name")))
    return archive.table_diff(rows, other, ["p_partkey"])


# --- corpus analytics -----------------------------------------------------------------------------------------------


@query(f"WITH {DOCUMENTS} SELECT cwd AS project, count(*) AS n, min(ended_at) AS first_ms, max(ended_at) AS last_ms, count(DISTINCT cwd) AS dirs, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT source AS s FROM docs x WHERE x.cwd = docs.cwd)) AS sources FROM docs WHERE cwd IS NOT NULL GROUP BY cwd")
def project_rollup(spark, sf_dir):
    return projects.rollup(projects.project_of(documents(spark, sf_dir)))


TOPICS = f"""{SEED_SQL}, wd AS (SELECT DISTINCT doc_id AS id, unnest({TOKENS}) AS term FROM documents), h0 AS (SELECT id, topic, count(*) AS terms FROM wd JOIN seeds USING (term) GROUP BY ALL), h AS (SELECT * FROM h0 WHERE topic IN (SELECT topic FROM h0 GROUP BY topic HAVING count(*) >= 2))"""


def _topics(spark, sf_dir):
    seeds = spark.createDataFrame(SEEDS, "topic string, term string")
    return projects.topic_hits(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), seeds)


@query(f"WITH {TOPICS} SELECT topic, count(*) AS members, sum(terms)::BIGINT AS terms FROM h GROUP BY topic")
def topic_report(spark, sf_dir):
    return projects.topic_report(_topics(spark, sf_dir))


@query(f"WITH {TOPICS}, z AS (SELECT topic, count(*) AS n FROM h GROUP BY topic) SELECT x.topic AS a, y.topic AS b, round(count(*) / (any_value(p.n) + any_value(q.n) - count(*)), 6) AS jaccard FROM h x JOIN h y ON x.id = y.id AND x.topic < y.topic JOIN z p ON p.topic = x.topic JOIN z q ON q.topic = y.topic GROUP BY ALL")
def topic_overlaps(spark, sf_dir):
    return projects.topic_overlaps(_topics(spark, sf_dir)).withColumn("jaccard", r6("jaccard"))


@query(r"WITH e AS (SELECT page_id AS id, unnest(regexp_extract_all(html, 'href=.?/[A-Za-z0-9./_-]+')) AS file FROM pages) SELECT id, file, count(*) AS mentions FROM e GROUP BY ALL")
def file_mentions(spark, sf_dir):
    return projects.file_mentions(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")), r"href=.?/[A-Za-z0-9./_-]+")


@query(f"""WITH {MESSAGES}, c AS (SELECT conv_id, CASE seq % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'edit' WHEN 2 THEN 'shell' ELSE 'other' END AS name FROM messages WHERE kind = 'tool_call'), a AS (SELECT conv_id, CASE name WHEN 'read' THEN 'look' WHEN 'edit' THEN 'change' ELSE 'run' END AS act, count(*) AS calls FROM c GROUP BY ALL)
    SELECT conv_id, act, calls, round(calls / sum(calls) OVER (PARTITION BY conv_id), 6) AS share FROM a""")
def act_mix(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(x) for x in ("read", "edit", "shell", "other")]), F.col("seq") % 4 + 1)
    calls = messages(spark, sf_dir).where("kind = 'tool_call'").select("conv_id", name.alias("name"))
    acts = spark.createDataFrame([("read", "look"), ("edit", "change"), ("shell", "run")], "name string, act string")
    return projects.act_mix(calls, acts).withColumn("share", r6("share"))


@query(f"""WITH {LOG}, p AS (SELECT user_id, ts_ms, min(ts_ms) OVER w AS lo, max(ts_ms) OVER w AS hi, count(*) OVER w AS d FROM log WINDOW w AS (PARTITION BY user_id)) SELECT user_id, CASE WHEN hi > lo THEN floor((ts_ms - lo) * 23 / (hi - lo)::DOUBLE + 0.5) ELSE 0 END::INT AS bar, count(*) AS n FROM p WHERE d >= 3 GROUP BY ALL""")
def activity_bars(spark, sf_dir):
    return projects.activity(log(spark, sf_dir), "user_id", "ts_ms")


@query(f"WITH {DOCUMENTS}, c AS (SELECT cwd AS set_id, source, count(*) AS n FROM docs GROUP BY ALL) SELECT set_id, source, n, row_number() OVER (PARTITION BY set_id ORDER BY n DESC, source)::INT AS place FROM c")
def source_composition(spark, sf_dir):
    return facets.composition(documents(spark, sf_dir).select(F.col("cwd").alias("set_id"), "source"))


@query(f"""WITH {DOCUMENTS}, a AS (SELECT id, 1 AS stratum FROM (SELECT id, row_number() OVER (PARTITION BY source ORDER BY ended_at DESC NULLS LAST, id) AS n FROM docs) WHERE n <= 8 UNION ALL (SELECT id, 2 FROM docs ORDER BY n_chars DESC, id LIMIT 12)) SELECT id, min(stratum) AS stratum FROM a GROUP BY id""")
def stratified_sample(spark, sf_dir):
    return projects.sample(documents(spark, sf_dir))


@query(f"""WITH {DOCUMENTS}, m AS (SELECT id FROM docs WHERE source = 'src1'), p AS (SELECT doc_id AS id FROM labels WHERE toxic = 1), x AS (SELECT doc_id AS id FROM labels WHERE quality = 0) SELECT id, id NOT IN (SELECT id FROM m) AS is_pin FROM (SELECT id FROM m UNION SELECT id FROM p) WHERE id NOT IN (SELECT id FROM x)""")
def collection(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return projects.collection(documents(spark, sf_dir).where("source = 'src1'").select("id"), labels.where("toxic = 1"), labels.where("quality = 0"))


@query(f"WITH {DOCUMENTS} SELECT id, row_number() OVER (ORDER BY ended_at DESC NULLS LAST, id)::INT AS place FROM docs QUALIFY place <= 50")
def recent_list(spark, sf_dir):
    from pyspark.sql import Window

    listed = search.recent(documents(spark, sf_dir), 50)
    return listed.select("id", F.row_number().over(Window.orderBy(F.desc_nulls_last("ended_at"), "id")).alias("place"))


def pages_as_text(spark, sf_dir):
    """Chained rewrites, for which there is no SQL here: tests/test_ingest.py holds them against plain Python."""
    return table(spark, sf_dir, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


QUERIES["pages_as_text"] = pages_as_text
