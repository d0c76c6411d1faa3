"""What once was left out: rows, spans, sessions and pairs, each against plain Python."""

import random
import re
from pathlib import Path

from convlens.operators import explain, sittings
from convlens.plans import catalog, catalog_answers, catalog_more, report, search  # noqa: F401
from convlens.plans.views import START_MS, log, table

DATA = "/root/testdata/sf0.001"
DAY = 86_400_000


def plan(df):
    return df._jdf.queryExecution().toString()


def test_pairs_explained_are_all_known_ones_and_no_cross_product(spark):
    got = {(r["qid"], r["conv_id"]): r["verdict"] for r in catalog.QUERIES["explained_known_pairs"](spark, DATA).collect()}
    graded = {(r["doc_id"] % 40, r["doc_id"]) for r in table(spark, DATA, "labels").collect()}
    assert graded <= set(got)
    assert {(q, -1) for q in range(40)} <= set(got)
    assert {(q + c) % 7 for q, c in graded} == set(range(7))
    assert any(v.startswith("ranked") for v in got.values()) and {got[q, -1] for q in range(40)} == {"missing"}
    for name in ("explained_pairs", "explained_known_pairs"):
        text = plan(catalog.QUERIES[name](spark, DATA))
        assert "NestedLoopJoin" not in text and "CartesianProduct" not in text


def test_every_query_is_explained_for_every_conversation(spark):
    convs = {r["conv_id"] for r in table(spark, DATA, "conversations").select("conv_id").collect()} | {-1}
    qids = [r["qid"] for r in catalog.asked(spark, DATA).select("qid").collect()]
    rows = [(r["qid"], r["conv_id"]) for r in catalog.QUERIES["explained_pairs"](spark, DATA).select("qid", "conv_id").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(q, c) for q in qids for c in convs}


def test_every_pair_gets_what_it_gets_when_asked_for(spark):
    """More queries than a cell has, the unknown conversation asked for, a conversation without text and a query without terms."""
    words = [f"w{i}" for i in range(90)]
    said = [(f"{c}:{t}", c, c * 1000 + t, "prose reasoning tool_call".split()[(c + t) % 3], t != 3, None if c == 7 else f"{words[(c * 7 + t) % 90]} {words[t]}") for c in range(12) for t in range(5)]
    rows = spark.createDataFrame(said, "id string, conv_id long, ts_ms long, kind string, on_head_path boolean, text string")
    asks = search.prepare_queries(spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(500, ""), (501, "w1 w8"), (502, "w")], "qid long, q string"))
    found = spark.createDataFrame([(q, f"{c}:{t}", -1.0 - q - t) for q in (1, 8, 501) for c in range(3) for t in range(2)], "qid long, msg_id string, score double")
    convs = spark.createDataFrame([(c,) for c in range(12)], "id long")
    asked = spark.createDataFrame([(c,) for c in (*range(12), -1)], "conv_id long")
    pairs = asks.select("qid").crossJoin(asked)
    one = explain.run(pairs, asks, convs, rows, found, pairs.where("conv_id <> 4"), 10_000, most=4)
    every = explain.every(asked, asks, convs, rows, found, asked.where("conv_id <> 4"), 10_000, most=4)
    assert every.columns == one.columns
    got, want = sorted(map(tuple, every.collect()), key=lambda r: r[:2]), sorted(map(tuple, one.collect()), key=lambda r: r[:2])
    assert got == want and len(got) == 93 * 13 and len({r[-1] for r in got}) > 6


def test_every_order_gives_a_driven_span(spark):
    days = {r["o_orderkey"] % 400 for r in table(spark, DATA, "orders").select("o_orderkey").collect()}
    assert len(days) > 8
    at = {r["id"]: r["ts_ms"] - START_MS for r in log(spark, DATA).select("id", "ts_ms").collect()}
    want = {i for i, t in at.items() if not (t // DAY in days and t % DAY < 7_200_000)}
    got = {r["id"] for r in catalog.QUERIES["absorbed_keystrokes_all_spans"](spark, DATA).collect()}
    assert got == want and len(want) < len(at)
    totals = catalog.QUERIES["need_totals_all_spans"](spark, DATA).first()
    assert totals["driven"] == len(at) - len(want)


def test_every_document_gets_a_window_label(spark):
    got = [r["id"] for r in catalog.QUERIES["window_labels_all"](spark, DATA).collect()]
    assert sorted(got) == sorted(r["doc_id"] for r in table(spark, DATA, "documents").collect())


def folded(rows, gap, span):
    """{(key, start): [end, items, sources]} by one pass over each key's rows."""
    out = {}
    for key in {r[1] for r in rows}:
        start = last = None
        for at, source in sorted((r[2], r[3]) for r in rows if r[1] == key and r[2] is not None):
            start = at if start is None or at - last > gap or at - start > span else start
            last = at
            one = out.setdefault((key, start), [at, 0, set()])
            one[0], one[1] = at, one[1] + 1
            one[2].add(source)
    return {k: (v[0], v[1], len(v[2])) for k, v in out.items()}


def test_sessions_without_gaps_equal_a_fold_and_keep_rows_apart(spark):
    pick = random.Random(5)
    rows = [(i, 1, i * 40 + pick.randrange(40), "ab"[i % 2]) for i in range(3000)]  # one island
    rows += [(5000 + i, None if i % 3 else 2, 10_000 + pick.randrange(-30_000, 30_000), "abc"[i % 3]) for i in range(400)] + [(9000, 2, None, "a")]
    rows += [(9100 + i, 3, 500, "ab"[i % 2]) for i in range(50)] + [(9200, 3, 1500, "a"), (9201, 3, 1501, "b"), (9202, 3, 5000, "b")]
    df = spark.createDataFrame(rows, "id long, user long, at long, source string")
    for gap, span in ((100, 1000), (700, 333), (5000, 1000)):
        out = sittings.bounded_sessions(df, ["user"], "at", "id", gap, span)
        got = {(r["user"], r["started"]): (r["ended"], r["items"], r["sources"]) for r in out.collect()}
        assert got == folded(rows, gap, span)
        assert "collect_list" not in plan(out)


def test_report_counts_sessions_across_sources(spark):
    hour = 3_600_000
    rows = [(i, "ab"[i % 2], "/Home/p", START_MS + i * hour, "text") for i in range(14)] + [(99, "a", "/Home/q", START_MS, "text")]
    docs = spark.createDataFrame(rows, "id long, source string, cwd string, ended_at long, text string")
    got = {(r["section"], r["n"]) for r in report.corpus_report(docs, spark.createDataFrame([("t", "text")], "topic string, term string")).collect()}
    assert ("session", 2) in got  # two of seven hours


def test_items_once_left_out_are_claimed_and_have_queries():
    text = (Path(__file__).parents[1] / "README.md").read_text()
    table_rows = "\n".join(x for x in text.split("## Layout")[1].split("## Scale")[0].splitlines() if x.startswith("|"))
    claimed = set(re.findall(r"\b[A-Z]\d+\b", table_rows))
    for a, lo, hi in re.findall(r"\b([A-Z])(\d+)–[A-Z](\d+)", table_rows):
        claimed |= {f"{a}{n}" for n in range(int(lo), int(hi) + 1)}
    built = {
        "J11": ["project_files", "project_topics"], "X6": ["answer_envelopes"], "X7": ["explained_terms", "explained_ranks"], "T7": ["project_sample"],
        "B14": ["query_timeline", "query_totals"], "B27": ["topic_shares", "matched_seeds"], "B33": ["call_totals"],
    }
    assert set(built) <= claimed
    assert all(name in catalog.QUERIES and name in catalog.SQL for names in built.values() for name in names)
