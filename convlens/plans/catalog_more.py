"""Further queries of the catalog: shown rows, answers, windows, calls and the corpus report."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlens.lineage import stored
from convlens.operators import facets, filters, logfold, postings, projects
from convlens.plans import report, search
from convlens.plans.catalog import GROUPED, NOW, SEARCH, SEEDS, TOPICS, asked, found, indexed, query
from convlens.plans.catalog import QUERIES as ALL
from convlens.plans.views import DOCUMENTS, MESSAGES, documents, messages, table


DAY = 86_400_000


@query(SEARCH + f""", {GROUPED}, n AS (SELECT x.qid, x.conv_id AS row_id, row_number() OVER (PARTITION BY x.qid, x.conv_id ORDER BY round(x.score, 9), x.msg_id) AS n, x.msg_id, x.score
    FROM scored x JOIN (SELECT qid, row_id FROM ranked WHERE rank <= 20) r ON r.qid = x.qid AND r.row_id = x.conv_id) SELECT qid, row_id, n::INT AS n, msg_id, score FROM n WHERE n <= 3""")
def nested_messages(spark, sf_dir):
    """The three best messages of each shown row, by decayed score."""
    rows = messages(spark, sf_dir)
    hits = stored(search.match(asked(spark, sf_dir), indexed(spark, sf_dir)), "matches")
    return search.nested(hits, rows, search.grouped(hits, rows, NOW, 20), NOW)


@query(SEARCH + f""", {GROUPED}, listed AS (SELECT id AS row_id, row_number() OVER (ORDER BY ended_at DESC NULLS LAST, id) AS rank FROM (SELECT conv_id AS id, max(ts_ms) AS ended_at FROM messages GROUP BY 1) QUALIFY rank <= 20)
    SELECT qid, rank::INT AS rank, row_id FROM ranked WHERE rank <= 20 UNION ALL SELECT qid, rank::INT, row_id FROM asked, listed WHERE NOT coalesce(len(terms) > 1 OR length(terms[1]) >= 3, false)""")
def answers(spark, sf_dir):
    convs = messages(spark, sf_dir).groupBy(F.col("conv_id").alias("id")).agg(F.max("ts_ms").alias("ended_at"))
    return search.answer(asked(spark, sf_dir), found(spark, sf_dir), convs, 20)


@query(f"""WITH s AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'day:' || item_id WHEN 1 THEN 'younger:' || item_id || 'd' WHEN 2 THEN 'older:' || item_id || 'h' ELSE 'younger:' || item_id || 'mo' END AS spec FROM benchmark), n AS (SELECT make_timestamp({NOW} * 1000) AS now)
    SELECT spec, (CASE item_id % 4 WHEN 0 THEN {NOW // DAY * DAY} - item_id * {DAY} WHEN 1 THEN {NOW} - item_id * {DAY} WHEN 3 THEN epoch_us(now - to_months(item_id::INT)) // 1000 END)::BIGINT AS from_ms,
    (CASE item_id % 4 WHEN 0 THEN {NOW // DAY * DAY} - item_id * {DAY} + {DAY} WHEN 2 THEN {NOW} - item_id * 3600000 END)::BIGINT AS until_ms, false AS rejected FROM s, n""")
def resolved_windows(spark, sf_dir):
    i, text = F.col("item_id"), F.col("item_id").cast("string")
    spec = F.when(i % 4 == 0, F.concat(F.lit("day:"), text)).when(i % 4 == 1, F.concat(F.lit("younger:"), text, F.lit("d"))).when(i % 4 == 2, F.concat(F.lit("older:"), text, F.lit("h"))).otherwise(F.concat(F.lit("younger:"), text, F.lit("mo")))
    return filters.resolve_windows(table(spark, sf_dir, "benchmark").select(spec.alias("spec")), NOW, "UTC")


@query(f"""WITH {DOCUMENTS}, w AS (SELECT id, CASE WHEN id % 5 > 0 THEN ended_at // {DAY} * {DAY} END AS a, CASE WHEN id % 7 > 0 THEN ended_at + id % 4 * 3600000 END AS b FROM docs) SELECT id, coalesce(CASE WHEN a % {DAY} = 0 THEN strftime(make_timestamp(a * 1000), '%Y-%m-%d') ELSE strftime(make_timestamp(a * 1000), '%Y-%m-%dT%H:%M:%S') END, '') || '..' ||
    coalesce(CASE WHEN b % {DAY} = 0 THEN strftime(make_timestamp(b * 1000), '%Y-%m-%d') ELSE strftime(make_timestamp(b * 1000), '%Y-%m-%dT%H:%M:%S') END, '') AS label FROM w""")
def window_labels(spark, sf_dir):
    """A window of every document, from a day's beginning to within some hours, open on either side for some; window_labels_all has them closed and short."""
    at, i = F.col("ended_at"), F.col("id")
    begins, ends = F.when(i % 5 > 0, F.floor(at / DAY) * DAY), F.when(i % 7 > 0, at + i % 4 * 3_600_000)
    return documents(spark, sf_dir).select("id", filters.window_text(begins, ends, "UTC").alias("label"))


@query(f"""WITH {DOCUMENTS}, w AS (SELECT id, ended_at AS a, ended_at + 90000 AS b FROM docs) SELECT id, coalesce(CASE WHEN a % {DAY} = 0 THEN strftime(make_timestamp(a * 1000), '%Y-%m-%d') ELSE strftime(make_timestamp(a * 1000), '%Y-%m-%dT%H:%M:%S') END, '') || '..' ||
    coalesce(CASE WHEN b % {DAY} = 0 THEN strftime(make_timestamp(b * 1000), '%Y-%m-%d') ELSE strftime(make_timestamp(b * 1000), '%Y-%m-%dT%H:%M:%S') END, '') AS label FROM w""")
def window_labels_all(spark, sf_dir):
    """Every document's window of a minute and a half."""
    return documents(spark, sf_dir).select("id", filters.window_text(F.col("ended_at"), F.col("ended_at") + 90_000, "UTC").alias("label"))


@query("SELECT o_orderkey AS id, nullif(list_position([o_custkey % 7, o_custkey % 5, o_custkey % 3], o_orderkey % 6), 0)::BIGINT AS rank FROM orders")
def pick_ranks(spark, sf_dir):
    c = F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array(c % 7, c % 5, c % 3).alias("shown"), (F.col("o_orderkey") % 6).alias("conv_id"))
    return logfold.pick_rank(rows).select("id", "rank")


@query("""SELECT o_orderkey AS id, o_custkey AS conv_id, CASE WHEN o_orderkey % 2 = 0 THEN 'run' ELSE 'edit' END AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'ls ' || o_orderstatus ELSE '/f/' || o_orderkey END AS summary,
    CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS removed, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 2 END AS added FROM orders""")
def call_details(spark, sf_dir):
    key = F.col("o_orderkey")
    run = F.concat(F.lit("run\n"), F.to_json(F.struct(F.concat(F.lit("ls "), "o_orderstatus").alias("command"))))
    edit = F.concat(F.lit("edit\n"), F.to_json(F.struct(F.concat(F.lit("/f/"), key.cast("string")).alias("file_path"), F.lit("a").alias("old_string"), F.lit("b\nc").alias("new_string"))))
    rows = table(spark, sf_dir, "orders").select(key.alias("id"), F.col("o_custkey").alias("conv_id"), F.when(key % 2 == 0, run).otherwise(edit).alias("text"))
    return projects.call_detail(rows)


@query(f"WITH {MESSAGES} SELECT id, CASE WHEN kind = 'prose' THEN 'prose' WHEN kind IN ('tool_call', 'tool_result') AND coalesce(text, '') <> '' THEN 'tools' END AS field FROM messages")
def message_fields(spark, sf_dir):
    from convlens.operators.model import field_of

    return messages(spark, sf_dir).select("id", field_of(F.col("kind"), F.col("text")).alias("field"))


@query(f"WITH {DOCUMENTS} SELECT source, count(*) AS conversations FROM docs GROUP BY source")
def source_census(spark, sf_dir):
    return facets.source_census(documents(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {DOCUMENTS}, {TOPICS}, d AS (SELECT * FROM docs WHERE cwd IS NOT NULL AND ended_at IS NOT NULL), f AS (SELECT *, CASE WHEN ended_at - lag(ended_at) OVER w <= 259200000 THEN 0 ELSE 1 END AS o FROM d WINDOW w AS (PARTITION BY cwd ORDER BY ended_at, id)),
    i AS (SELECT *, sum(o) OVER (PARTITION BY cwd ORDER BY ended_at, id) AS island FROM f), l AS (SELECT cwd, island FROM i GROUP BY ALL HAVING count(*) >= 2),
    num AS (SELECT *, row_number() OVER (PARTITION BY cwd ORDER BY ended_at, id) AS n FROM d), w AS (SELECT cwd, n, ended_at, source, ended_at AS started FROM num WHERE n = 1 UNION ALL
        SELECT o.cwd, o.n, o.ended_at, o.source, CASE WHEN o.ended_at - w.ended_at > 7200000 OR o.ended_at - w.started > 21600000 THEN o.ended_at ELSE w.started END FROM w JOIN num o ON o.cwd = w.cwd AND o.n = w.n + 1),
    s AS (SELECT cwd, started FROM w GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT source) >= 2)
    SELECT 'project' AS section, cwd AS name, count(*) AS n FROM docs WHERE cwd IS NOT NULL GROUP BY cwd UNION ALL SELECT 'lineage', cwd, count(*) FROM l GROUP BY cwd UNION ALL SELECT 'session', cwd, count(*) FROM s GROUP BY cwd UNION ALL SELECT 'topic', topic, count(*) FROM h GROUP BY topic"""
)
def corpus_report(spark, sf_dir):
    return report.corpus_report(documents(spark, sf_dir), spark.createDataFrame(SEEDS, "topic string, term string"))


def search_snippets(spark, sf_dir):
    """The best message of each shown row with its snippet; tests hold the cutting against examples."""
    rows, asks = messages(spark, sf_dir), asked(spark, sf_dir)
    hits = stored(search.match(asks, indexed(spark, sf_dir)), "matches")
    top = search.nested(hits, rows, search.grouped(hits, rows, NOW, 20), NOW, 1).select("qid", "msg_id").join(rows.select(F.col("id").alias("msg_id"), "text"), "msg_id")
    return search.snippets(top, search.marking_terms(asks))


def marked_words(spark, sf_dir):
    """Byte spans of matching words in the best message of each shown row."""
    rows, asks = messages(spark, sf_dir), asked(spark, sf_dir)
    hits = stored(search.match(asks, indexed(spark, sf_dir)), "matches")
    top = search.nested(hits, rows, search.grouped(hits, rows, NOW, 20), NOW, 1).select("qid", "msg_id").join(rows.select(F.col("id").alias("msg_id"), "text"), "msg_id")
    return search.match_spans(top, search.marking_terms(asks))


def stemmed_vocabulary(spark, sf_dir):
    """Document frequency of stemmed terms; the stemmer has no SQL."""
    placed = postings.stem_terms(postings.words(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("prose").alias("kind"), "text")))
    return placed.groupBy("term").agg(F.countDistinct("msg_id").alias("df"))


for _f in (search_snippets, marked_words, stemmed_vocabulary):
    ALL[_f.__name__] = _f
