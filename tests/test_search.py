"""Stemmed and accent-blind search, filters and sittings against plain Python; text within nested values."""

import hashlib
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from convlens.functions.stem import porter
from convlens.functions.text import fold
from convlens.operators import archive, filters, postings, projects
from convlens.plans import search
from convlens.sources import transcripts

SAID = ["running in the hills", "he runs and ran", "the runner rests", "hills are alive", "šafran čaj in Łódź", "safrán again", "ponies and pony", "relational databases relate", "a_b under_score words", "", None]


def messages(spark):
    rows = [(f"m{i}", i % 4, i, "prose", t, i % 5 != 4, 1000 * i) for i, t in enumerate(SAID)]
    return spark.createDataFrame(rows, "id string, conv_id long, seq int, kind string, text string, on_head_path boolean, ts_ms long")


def plain(text):
    low = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", low)


@pytest.mark.parametrize("stemmed", [False, True])
def test_words_and_stems_find_what_they_should(spark, stemmed):
    asks = ["running ", "run ", "hill run ", "safran ", "ŠAFRÁN ", "pony ", "relate ", "relational database ", "runn", "the hil", "database"]
    queries = search.prepare_queries(spark.createDataFrame(list(enumerate(asks)), "qid long, q string"))
    built = postings.build(messages(spark), stemmed)
    got = {}
    for r in search.match(queries, built, stemmed=stemmed).collect():
        got.setdefault(r["qid"], set()).add(r["msg_id"])
    key = porter if stemmed else (lambda w: w)
    want = {}
    for i, q in enumerate(asks):
        words = plain(q)
        whole, start = ([key(w) for w in words], None) if q.endswith(" ") else ([key(w) for w in words[:-1]], words[-1])
        for j, text in enumerate(SAID):
            own = {key(w) for w in plain(text)}
            if set(whole) <= own and (start is None or any(w.startswith(start) for w in own)):
                want.setdefault(i, set()).add(f"m{j}")
    assert got == want
    assert ("m1" in got[0]) == stemmed


def test_folding_of_letters_with_marks(spark):
    given = ["Šafrán ÑÔÜ ǖ ẫ Ÿ", "é ö", "Łódź ø ß", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in given], "t string").select(fold(F.col("t"))).collect()]
    assert got == ["safran nou u a y", "e o", "łodz ø ß", None]


def test_recent_rows_under_filters_and_sittings(spark):
    convs = spark.createDataFrame([(1, 100), (2, 200), (3, None), (4, 50), (5, 300)], "id long, ended_at long")
    groups = spark.createDataFrame([(1, 1, True, 200), (2, 1, False, 200), (4, 4, True, 900), (5, 4, False, 900)], "conv_id long, group_id long, opens boolean, ended long")
    assert [r["id"] for r in search.recent(convs, 10).collect()] == [5, 2, 1, 4, 3]
    assert [(r["id"], r["ended_at"]) for r in search.recent(convs, 10, groups=groups).collect()] == [(4, 900), (1, 200), (3, None)]
    keep = convs.where("id <> 4").select(F.col("id").alias("conv_id"))
    assert [r["id"] for r in search.recent(convs, 2, keep=keep, groups=groups).collect()] == [1, 3]


def test_totals_under_a_ceiling_are_not_settled(spark):
    rows = messages(spark)
    queries = search.prepare_queries(spark.createDataFrame([(1, "the "), (2, "hills "), (3, "")], "qid long, q string"))
    hits = search.match(queries, postings.build(rows))
    got = {r["qid"]: (r["total"], r["settled"]) for r in search.totals(hits, rows, 20, ceiling=1).collect()}
    assert got == {1: (1, False), 2: (2, True)} or not got[1][1]
    whole = {r["qid"]: (r["count"], r["total"], r["settled"]) for r in search.envelope(queries, search.totals(hits, rows, 1), rows.select(F.col("conv_id").alias("id")).distinct(), 1).collect()}
    assert whole == {1: (1, 2, True), 2: (1, 2, True), 3: (1, 4, True)}


def test_text_within_nested_values(spark):
    values = [
        {"content": [{"text": "a"}, {"text": "b"}]}, [{"content": [{"text": "deep"}]}], {"text": None, "content": "x"}, "plain", ["a", {"text": "b"}, None, ["c", ["d"]]],
        {"output": {"message": {"thinking": {"text": {"content": ["far", {"text": "down"}]}}}}}, {"other": "no"}, {"text": "", "content": "y"}, [], {}, None, 5, {"content": {"text": None}}, [[["x"]]],
    ]

    def walk(v):
        if isinstance(v, dict):
            return next((walk(v[k]) for k in ("text", "content", "output", "message", "thinking") if v.get(k) is not None), "")
        if isinstance(v, list):
            return "\n".join(filter(None, map(walk, v)))
        return "" if v is None else v if isinstance(v, str) else json.dumps(v)

    nested = "deepest"
    for _ in range(200):
        nested = {"content": [nested]}
    values.append(nested)
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string").select("i", transcripts.flatten(F.try_parse_json("j")).alias("t"))
    assert [r["t"] for r in df.orderBy("i").collect()] == [walk(v) for v in values]


def test_projects_of_worktrees_and_scratch(spark):
    rows = [
        (1, "/Users/u/dev/mars/", "/Users/u/dev/mars"), (2, "/Users/u/dev/mars/.claude/worktrees/a-b", "/Users/u/dev/mars"), (3, "/Users/u/.codex/worktrees/0af/mars", "/Users/u/dev/mars"),
        (4, "/Users/u/.codex/worktrees/0af/venus", "/Users/u/.codex/worktrees/0af/venus"), (5, "/Users/u/Documents/Codex/2026-01-02/x", None), (6, "/private/var/folders/x", None), (7, None, None), (8, "", None),
    ]
    got = projects.project_of(spark.createDataFrame(rows, "id long, cwd string, want string")).collect()
    assert {r["id"]: r["project"] for r in got} == {i: p for i, _, p in rows}


def test_globs_prefixes_and_civil_dates(spark):
    paths = spark.createDataFrame([("a/x.jsonl",), ("a/x.json",), ("b/y.jsonl",)], "path string")
    chosen = lambda globs: sorted(r["path"] for r in archive.select_globs(paths, globs).collect())
    assert chosen([]) == ["a/x.json", "a/x.jsonl", "b/y.jsonl"] and chosen(["a/*.jsonl"]) == ["a/x.jsonl"] and chosen(["[", "*.json"]) == ["a/x.json"] and chosen(["["]) == []
    big = bytes(range(256)) * 512
    files = spark.createDataFrame([("a", b"short"), ("b", big), ("c", big + b"more"), ("d", b"")], "path string, content binary")
    got = {r["path"]: (r["prefix_len"], r["prefix_hash"]) for r in archive.fingerprint(files).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {"a": (5, sha(b"short")), "b": (65536, sha(big[:65536])), "c": (65536, sha(big[:65536])), "d": (0, sha(b""))}
    at = spark.createDataFrame([(1767225599000,), (1767225600000,), (None,)], "ms long").select(filters.civil_date(F.col("ms"), "UTC").alias("u"), filters.civil_date(F.col("ms"), "America/New_York").alias("n"))
    assert [tuple(r) for r in at.collect()] == [("2025-12-31", "2025-12-31"), ("2026-01-01", "2025-12-31"), (None, None)]


def test_sources_that_are_not_known_are_named(spark):
    asks = spark.createDataFrame([(1, "two words", ["a", "x", "b"]), (2, "two words", []), (3, "", ["y"])], "qid long, q string, sources array<string>")
    got = {r["qid"]: (r["mode"], r["rejected"]) for r in search.prepare_queries(asks, spark.createDataFrame([("a",), ("b",)], "source string")).collect()}
    assert got == {1: ("searchable", ["x"]), 2: ("searchable", []), 3: ("empty", ["y"])}


def test_spans_of_many_words(spark):
    text = "é ab! " * 30_000
    shown = spark.createDataFrame([(1, "m", text)], "qid long, msg_id string, text string")
    terms = spark.createDataFrame([(1, "ab", False), (1, "e", True)], "qid long, term string, is_prefix boolean")
    got = search.match_spans(shown, terms).agg(F.count("*"), F.max("end")).collect()[0]
    assert tuple(got) == (60_000, 7 * 30_000 - 2)


def test_first_join_does_not_grow_with_the_commonest_term(spark):
    """Candidates are the messages of the rarest term, however common the other one is, also where it is dealt out as heavy."""
    from convlens.lineage import stored
    from convlens.operators import postings

    for common in (200, 2_000):
        docs = [(i, "prose", "every " + ("rare" if i % 100 == 0 else "usual") + (" alone" if i == 3 else "")) for i in range(common)]
        index = stored(postings.build(spark.createDataFrame(docs, "id long, kind string, text string")), "postings")
        asks = search.prepare_queries(spark.createDataFrame([(q, "every alone ") for q in range(50)] + [(90, "every "), (91, "every nowhere "), (92, "usual every usu")], "qid long, q string"))
        terms = search.query_terms(asks)
        hits = search.term_hits(terms, index)
        known = stored(search.frequencies(hits), "known")
        wanted = terms.groupBy("qid", "term", "is_prefix").agg(F.count("*").alias("times"))
        rows = {n: search.candidates(wanted.where(f"qid {n}"), hits, known, 4, 10, 8).count() for n in ("< 90", "= 90", "= 91")}
        assert rows == {"< 90": 50, "= 90": common, "= 91": 0}
        got = search.match(asks, index).groupBy("qid").count().collect()
        assert {r["qid"]: r["count"] for r in got} == {**{q: 1 for q in range(50)}, 90: common, 92: common - common // 100}


def test_sittings_of_one_island_over_many_ranges(spark):
    """A key that never pauses is counted range by range: places, sums and opener are those of one window over all of it."""
    import random

    from convlens.operators import sittings

    pick = random.Random(2)
    rows, at = [], {k: 0 for k in ("a", "b", None)}
    for i in range(900):
        key = pick.choice(["a", "a", "b", None])
        at[key] += pick.choice([0, 1, 60_000, 1_700_000]) if key == "a" else pick.choice([0, 1_700_000, 1_800_000, 40_000_000])
        rows.append((i, key, at[key], pick.randrange(9)))
    rows.append((1000, "a", None, 5))
    df = spark.createDataFrame(rows, "id long, cwd string, ended_at long, msg_count long")
    want = set()
    for key in at:
        sitting, last = [], None
        for i, k, t, n in [*sorted((r for r in rows if r[1] == key and r[2] is not None), key=lambda r: (r[2], r[0])), (None, key, 10**15, 0)]:
            if last is not None and t - last >= 1_800_000 or i is None:
                if len(sitting) > 1:
                    told = 0
                    for place, (j, m) in enumerate(sitting):
                        want.add((key, j, sitting[0][0], len(sitting), place + 1, told))
                        told += m
                sitting = []
            sitting.append((i, n))
            last = t
    got = sittings.build(df, ["cwd"], span_ms=3_600_000)
    assert {(r["cwd"], r["id"], r["sitting_id"], r["members"], r["position"], r["message_offset"]) for r in got.collect()} == want
    allowed = sittings.build(df, ["cwd"], span_ms=3_600_000, allow=spark.createDataFrame([("b",)], "cwd string"))
    assert {r["id"] for r in allowed.collect()} == {w[1] for w in want if w[0] == "b"}
    one = next(w for w in want if w[4] == 2)
    found = sittings.resolve(got, spark.createDataFrame([(one[1],), (1000,)], "id long")).collect()
    assert {r["member"] for r in found if r["id"] == one[1]} == {w[1] for w in want if w[2] == one[2] and w[0] == one[0]}
    assert [(r["sitting_id"], r["member"], r["position"]) for r in found if r["id"] == 1000] == [(1000, 1000, 1)]


def test_union_of_spans_against_brute_force(spark):
    """Overlapping, touching, nested, empty and year-long spans: events outside are those of plain comparison, and a day's pieces are disjoint."""
    import random

    from convlens.operators import logfold

    pick, day = random.Random(9), 86_400_000
    spans = [(a, a + pick.choice([0, -5, 1, 3_600_000, 20 * 3_600_000, 30 * 3_600_000, 3 * day])) for a in (pick.randrange(40 * day) for _ in range(60))]
    spans += [(a, a + day) for a in (50 * day, 51 * day, 51 * day + 1)] + [(60 * day + 5, 60 * day + 10), (60 * day + 10, 60 * day + 20), (100 * day + 7, 465 * day + 7)] * 3
    edges = [x + d for s in spans for x in s for d in (-1, 0, 1)]
    log = [(i, t) for i, t in enumerate(edges + [pick.randrange(500 * day) for _ in range(500)] + [None])]
    frame = spark.createDataFrame(spans, "from_ms long, until_ms long")
    out = logfold.exclude_spans(spark.createDataFrame(log, "id long, ts_ms long"), frame)
    assert out.columns == ["id", "ts_ms"]
    assert {r["id"] for r in out.collect()} == {i for i, t in log if t is None or not any(a <= t < b for a, b in spans)}
    whole, pieces = logfold.merge_spans(frame)
    days, parts = [r["day"] for r in whole.collect()], [(r["day"], r["from_ms"], r["until_ms"]) for r in pieces.collect()]
    assert len(days) == len(set(days)) and not set(days) & {d for d, _, _ in parts}
    for d in {p[0] for p in parts}:
        own = sorted(p[1:] for p in parts if p[0] == d)
        assert all(a[1] < b[0] for a, b in zip(own, own[1:])) and all(d * day <= a < b <= (d + 1) * day for a, b in own)


def test_explained_terms_search_a_text_once(spark):
    from convlens.operators import explain

    messages = spark.createDataFrame([(1, "c", "prose", "Alpha beta"), (2, "c", "reasoning", "alpha"), (3, "c", "tool_call", "alpha gamma")], "id long, conv_id string, kind string, text string")
    asks = search.prepare_queries(spark.createDataFrame([(q, "alpha gamma ") for q in range(30)], "qid long, q string"))
    pairs = asks.select("qid", F.lit("c").alias("conv_id"))
    got = explain.term_hits(pairs, asks, messages).collect()
    assert len(got) == 60 and {(r["term"], r["indexed"], r["unindexed"]) for r in got} == {("alpha", 1, 1), ("gamma", 0, 0)}
