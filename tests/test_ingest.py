"""Readers of transcript layouts on invented files, and text helpers on boundaries."""

import datetime
import json
import re

import pytest

from convlens.functions import titles
from convlens.functions.stem import porter
from convlens.functions.text import clip_bytes, html_to_text
from convlens.operators import archive, filters, model
from convlens.plans import search
from convlens.sources import events, tables, transcripts
from pyspark.sql import functions as F


def put(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else "\n".join(x if isinstance(x, str) else json.dumps(x) for x in content))


def by_id(messages):
    return {r["id"]: r.asDict() for r in messages.collect()}


def test_session_lines(spark, tmp_path):
    said = lambda role, content, **more: {"type": role, "sessionId": "s1", "uuid": more.pop("u"), "parentUuid": more.pop("up", None), "timestamp": "2026-01-02T03:04:05.678Z", "message": {"role": role, "content": content, **more.pop("m", {})}, **more}
    put(tmp_path, "p/a.jsonl", [
        {"type": "custom-title", "customTitle": "first", "sessionId": "s1"},
        said("user", "<system-reminder>x</system-reminder>", u="u0", cwd="/w", gitBranch="main"),
        said("user", "meta", u="u1", up="u0", isMeta=True),
        '{"type": "assistant", "uuid": broken',
        said("assistant", [{"type": "thinking", "thinking": ""}], u="u2", up="u1", m={"model": "m1"}),
        said("assistant", [{"type": "text", "text": "hello"}, {"type": "tool_use", "name": "run", "input": {"a": 1}}], u="u3", up="u2", m={"model": "m1"}),
        said("user", [{"type": "tool_result", "content": [{"type": "text", "text": "no"}], "is_error": True}], u="u4", up="u3"),
        {"type": "custom-title", "customTitle": "second", "sessionId": "s1"},
        said("user", "what now", u="u5", up="u4", isSidechain=True),
    ])
    put(tmp_path, "p/empty.jsonl", [{"type": "summary", "sessionId": "s9"}])
    convs, msgs = transcripts.session_jsonl(spark, f"{tmp_path}/p")
    (conv,) = convs.collect()
    assert (conv["conv_id"], conv["custom"], conv["first_user"], conv["cwd"], conv["git_branch"]) == ("session:s1", "second", "what now", "/w", "main")
    got = by_id(msgs)
    order = sorted(got.values(), key=lambda r: r["seq"])
    assert [r["id"] for r in order] == ["session:s1:" + x for x in ("u0", "u3", "u3#1", "u4", "u5")]
    assert [r["parent_id"] and r["parent_id"].split(":")[-1] for r in order] == [None, "u0", "u3", "u3", "u4"]
    assert [(r["role"], r["kind"]) for r in order] == [("user", "prose"), ("assistant", "prose"), ("assistant", "tool_call"), ("tool", "tool_result"), ("user", "prose")]
    assert order[2]["text"] == 'run\n{"a":1}' and order[3]["text"] == "no" and order[3]["is_error"] and order[4]["is_sidechain"]
    assert [r["model"] for r in order] == [None, "m1", "m1", None, None] and order[0]["ts_ms"] == 1767323045678


def test_rollout_lines(spark, tmp_path):
    rec = lambda rtype, **p: {"timestamp": "2026-06-02T09:15:04Z", "type": rtype, "payload": p}
    put(tmp_path, "r/rollout-a.jsonl", [
        rec("session_meta", id="t1", cwd="/c", git={"branch": "b"}, originator="cli", forked_from_id="t0", thread_source="subagent"),
        rec("session_meta", id="t2"),
        rec("turn_context", model="m1"),
        rec("event_msg", type="user_message", message="<env>", kind="environment_context"),
        rec("event_msg", type="user_message", message="/status"),
        rec("event_msg", type="user_message", message="run[$commit](/x/y.md) now"),
        rec("event_msg", type="agent_message", message="ok"),
        rec("turn_context", model="m2"),
        rec("response_item", type="function_call", name="shell", arguments='{"cmd":"ls"}'),
        rec("response_item", type="function_call_output", output='{"metadata":{"exit_code":2},"output":"bad"}'),
    ])
    convs, msgs = transcripts.rollout_jsonl(spark, f"{tmp_path}/r")
    (conv,) = convs.collect()
    assert (conv["native_id"], conv["first_user"], conv["git_branch"], conv["surface"], conv["forked_from"], conv["declared_model"]) == ("t1", "run commit now", "b", "cli", "t0", "m2")
    rows = sorted(by_id(msgs).values(), key=lambda r: r["seq"])
    assert [r["id"].split(":", 2)[2] for r in rows] == [f"rollout-a:{i:06d}" for i in range(5)]
    assert [r["model"] for r in rows] == [None, None, "m1", "m2", None]
    assert rows[4]["is_error"] and rows[3]["text"] == 'shell\n{"cmd":"ls"}' and all(r["is_sidechain"] for r in rows)
    assert [r["parent_id"] for r in rows] == [None, *[r["id"] for r in rows[:-1]]]


def test_chat_export(spark, tmp_path):
    node = lambda parent, children, role=None, text=None, **content: {"parent": parent, "children": children, "message": role and {"author": {"role": role}, "create_time": 1.5, "content": {"content_type": "text", "parts": [text], **content}}}
    conv = {"id": "c1", "title": "T", "current_node": "hid", "default_model_slug": "auto", "mapping": {
        "root": node(None, ["a"]), "a": node("root", ["b2", "b1"], "user", "question"), "b1": node("a", ["hid"], "assistant", "one"), "b2": node("a", [], "assistant", "two"),
        "hid": node("b1", [], "system", "secret"), "loop1": node("loop2", ["loop2"], "user", "l1"), "loop2": node("loop1", ["loop1"], "tool", "l2")}}
    put(tmp_path, "e/conversations.json", json.dumps([conv, {"no": "id"}]))
    convs, msgs = transcripts.chat_export(spark, f"{tmp_path}/e")
    (c,) = convs.collect()
    assert (c["conv_id"], c["custom"], c["first_user"], c["head"], c["declared_model"]) == ("chat-export:c1", "T", "question", "b1", None)
    rows = sorted(by_id(msgs).values(), key=lambda r: r["seq"])
    assert [(r["id"].split(":")[-1], r["parent_id"] and r["parent_id"].split(":")[-1], r["kind"]) for r in rows] == [("a", None, "prose"), ("b2", "a", "prose"), ("b1", "a", "prose"), ("loop1", None, "prose"), ("loop2", "loop1", "tool_result")]
    assert rows[0]["ts_ms"] == 1500


def test_other_layouts(spark, tmp_path):
    put(tmp_path, "j/x.json", json.dumps({"sessionId": "g", "messages": [{"id": "1", "type": "user", "content": "hi"}, {"id": "1", "type": "gemini", "content": [{"text": "yo"}], "model": "m"}, {"type": "info", "content": "note"}]}))
    put(tmp_path, "j/y.json", "[1, 2]")
    _, msgs = transcripts.session_json(spark, f"{tmp_path}/j")
    assert [(r["id"], r["role"]) for r in msgs.orderBy("seq").collect()] == [("session-json:g:1", "user"), ("session-json:g:msg-000001", "assistant"), ("session-json:g:msg-000002", "system")]

    log = [{"header": "Gemini Apps", "title": "Prompted why", "time": "2026-01-01T00:00:00Z", "attachedFiles": ["f"], "safeHtmlItem": [{"html": "<p>be&amp;cause</p>"}], "subtitles": [{"url": "https://a"}, {"url": "https://a"}, {"url": "x"}]}, {"title": "Used it", "time": "2026-01-02T00:00:00Z"}, {"title": "no time"}]
    put(tmp_path, "l/log.json", json.dumps(log))
    convs, msgs = transcripts.activity_log(spark, f"{tmp_path}/l")
    assert [(c["surface"], c["first_user"]) for c in convs.collect()] == [("gemini-apps", "why")]
    assert [r["text"] for r in msgs.orderBy("seq").collect()] == ["why\n[attached: f]", "be&cause\n[sources: https://a]"]

    put(tmp_path, "w/conversation_k.txt", json.dumps({"title": "t", "conversation_turns": [{"user_turn": {"prompt": "p"}}, {"other": 1}, {"system_turn": {"text": [{"preamble": "a", "data": " b "}]}}, {"user_turn": {"prompt": " "}}]}))
    _, msgs = transcripts.turn_list(spark, f"{tmp_path}/w")
    assert [(r["id"], r["text"]) for r in msgs.orderBy("seq").collect()] == [("turn-list:k:turn-0000", "p"), ("turn-list:k:turn-0001", "a\nb")]

    put(tmp_path, "n/Book/Chats/Chat - 77.html", "lost\nUSER: <b>one</b>\nmore\nMODEL: two\nUSER:  \n")
    convs, msgs = transcripts.transcript_html(spark, f"{tmp_path}/n")
    assert [(r["role"], r["text"]) for r in msgs.orderBy("seq").collect()] == [("user", "one\nmore"), ("assistant", "two")]
    assert [(c["native_id"], c["generated"]) for c in convs.collect()] == [("77", "Book")]

    put(tmp_path, "d/local_q.json", json.dumps({"sessionId": "local_q", "title": "State", "model": "m0"}))
    put(tmp_path, "d/local_q/audit.jsonl", [{"type": "system", "model": "m1"}, {"type": "user", "uuid": "a", "message": {"content": "hey"}}, {"type": "user", "uuid": "a", "isReplay": True, "message": {"content": "hey"}}, {"type": "assistant", "uuid": "a", "parent_tool_use_id": "t", "_audit_timestamp": "2026-01-01T00:00:00Z", "message": {"content": [{"type": "text", "text": "yes"}]}}])
    convs, msgs = transcripts.state_and_audit(spark, f"{tmp_path}/d")
    assert [(r["id"], r["model"], r["is_sidechain"]) for r in msgs.orderBy("seq").collect()] == [("desktop:q:a", None, False), ("desktop:q:msg-000001", "m1", True)]
    merged = model.merge_conversations(convs, ["file"], ["generated", "first_user", "declared_model"], "conv_id").collect()
    assert [(r["generated"], r["first_user"]) for r in merged] == [("State", "hey")]


def test_titles(spark):
    rows = [("<command-name>/model</command-name><command-args>opus</command-args>", None), ("<command-name>/x</command-name><command-args>do  it</command-args>", "do it"), ("[Request interrupted by user]", None), ("<ide_selection>cut off", "cut off")]
    assert [r[0] for r in spark.createDataFrame(rows, "t string, w string").select(titles.session_title(F.col("t"))).collect()] == [w for _, w in rows]
    rows = [("# Context from my IDE setup:\nx\n## My request for Codex:\n fix it\nnow", "fix it now"), ("/model luna", None), ("/usr/local/bin", "/usr/local/bin"), ("/2026 was", "/2026 was"), ("# Files mentioned by the user:\nx", None)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string, w string").select(titles.rollout_title(F.col("t"))).collect()] == [w for _, w in rows]


def test_clip_keeps_characters_whole(spark):
    for text, n in (("aé𝒳中" * 20, k) for k in range(1, 40)):
        (out,) = spark.createDataFrame([(text,)], "t string").select(clip_bytes(F.col("t"), n, "|%d")).first()
        want = text.encode()[:n].decode(errors="ignore")
        assert out == f"{want}|{len(text.encode()) - len(want.encode())}"


def test_html_to_text_of_all_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html", html_to_text(F.col("html")).alias("text")).collect()
    for r in rows:
        assert not re.search(r"<(p|div|li|td|br|script|style|b)\b", r["text"]) and all(line.strip() for line in r["text"].split("\n"))
    (out,) = spark.createDataFrame([("<ul><li>a<li>b</ul><table><tr><td>1</td><td>2</td></tr></table><hr>x<br/>y &lt;&amp;lt; &bogus;",)], "h string").select(html_to_text(F.col("h"))).first()
    assert out == "- a\n- b\n1 | 2\n---\nx\ny <&lt; &bogus;"


def test_stems():
    pairs = "caresses caress,ponies poni,cats cat,feed feed,agreed agre,plastered plaster,motoring motor,sing sing,conflated conflat,hopping hop,falling fall,filing file,happy happi,sky sky,relational relat,rational ration,triplicate triplic,hopefulness hope,revival reviv,adjustment adjust,adoption adopt,probate probat,rate rate,controll control"
    for word, stem in (p.split() for p in pairs.split(",")):
        assert porter(word) == stem, word


def test_civil_time_at_clock_changes(spark):
    tz = "America/Los_Angeles"
    rows = [("2026-11-01 01:30:00", "2026-11-01T08:30:00+00:00"), ("2026-03-08 02:30:00", "2026-03-08T10:00:00+00:00"), ("2026-07-01 00:00:00", "2026-07-01T07:00:00+00:00")]
    df = spark.createDataFrame(rows, "l string, w string").select(filters.to_instant(F.col("l").cast("timestamp"), tz).alias("ms"), "w")
    for r in df.collect():
        assert datetime.datetime.fromtimestamp(r["ms"] / 1000, datetime.timezone.utc).isoformat() == r["w"]


def test_date_specs(spark):
    now = int(datetime.datetime(2026, 3, 31, 12, tzinfo=datetime.timezone.utc).timestamp() * 1000)
    day = 86_400_000
    noon = now
    start = now - day // 2
    want = {
        "day:1": (start - day, start, False), "younger:2h": (noon - 7_200_000, None, False), "older:1w": (None, noon - 7 * day, False), "2026-03-30": (start - day, start, False),
        "2026-03-01..": (start - 30 * day, None, False), "2026-03-30..2026-03-29": (start - day, start - 2 * day, True), "..": (None, None, True), "junk": (None, None, True),
        "younger:1mo": (noon - 31 * day, None, False),
    }
    got = filters.resolve_windows(spark.createDataFrame([(s,) for s in want], "spec string"), now, "UTC").collect()
    assert {r["spec"]: (r["from_ms"], r["until_ms"], r["rejected"]) for r in got} == want | {"younger:1mo": (int(datetime.datetime(2026, 2, 28, 12, tzinfo=datetime.timezone.utc).timestamp() * 1000), None, False)}


def test_tolerant_logs_and_tables(spark, tmp_path):
    put(tmp_path, "log/a.jsonl", ['{"kind": "search", "q": "x", "ts": 1}', "{oops", '{"kind": "pick", "q": "y", "ts": 2}'])
    put(tmp_path, "log/b.jsonl", ['{"kind": "search", "q": "z", "ts": 3}', '{"cut'])
    good, bad = events.read_events(spark, f"{tmp_path}/log", "kind string, q string, ts long")
    assert sorted(r["q"] for r in good.collect()) == ["x", "y", "z"] and sorted(r["unreadable"] for r in bad.collect()) == [1, 1]
    assert [r["file"][-7:] for r in events.damaged_before_end(spark, f"{tmp_path}/log").collect()] == ["a.jsonl"]
    msgs = spark.createDataFrame([("c", "m", False, "main", 0)], "conv_id string, id string, is_sidechain boolean, thread_key string, seq int")
    tables.write(spark.createDataFrame([("c",)], "id string"), msgs, f"{tmp_path}/t")
    assert tables.read(spark, f"{tmp_path}/t")[1].count() == 1
    archive.append_events(spark.createDataFrame([(1767323045678, "new")], "ts long, op string"), f"{tmp_path}/ev")
    assert [p.name for p in (tmp_path / "ev").glob("period=*")] == ["period=2026-01"]


def test_archive_scan_reads_only_what_changed(spark, tmp_path):
    """As files on disk: what is the same by size and time may be unreadable, heads alone are read, and what cannot be read is told."""
    import hashlib

    sha = lambda b: hashlib.sha256(b).hexdigest()
    big = b"a" * 100_000
    at = lambda name: f"{tmp_path}/{name}"
    for name, data in {"grown": b"abcdef", "touched": b"abc", "rewritten": b"xbcdef", "shrunk": b"ab", "fresh": b"z", "long one": big + b"tail"}.items():
        (tmp_path / name).write_bytes(data)
    old = [("same", 3, 1, "x", 3), ("grown", 3, 1, sha(b"abc"), 3), ("touched", 3, 1, sha(b"abc"), 3), ("rewritten", 3, 1, sha(b"abc"), 3), ("shrunk", 9, 1, "x", 9), ("gone", 1, 1, "x", 1), ("lost", 3, 1, "x", 3), ("long one", 100_000, 1, sha(big[:65536]), 65536)]
    now = [("same", 3, 1), ("grown", 6, 2), ("touched", 3, 2), ("rewritten", 6, 2), ("shrunk", 2, 2), ("fresh", 1, 2), ("lost", 4, 2), ("long one", 100_004, 2)]
    manifest = spark.createDataFrame([("new", "s", at(n), *r) for n, *r in old], "op string, source string, path string, size long, mtime_ms long, prefix_hash string, prefix_len long")
    listing = spark.createDataFrame([("s", at(n), *r) for n, *r in now], "source string, path string, size long, mtime_ms long")
    got = {r["path"].rsplit("/", 1)[1]: r for r in archive.scan(listing, manifest).collect()}
    assert {k: r["change"] for k, r in got.items()} == {"same": "same", "grown": "appended", "touched": "same", "rewritten": "rewritten", "shrunk": "rewritten", "gone": "vanished", "fresh": "new", "lost": "unreadable", "long one": "appended"}
    assert {k: r["bytes_read"] for k, r in got.items()} == {"same": 0, "grown": 6, "touched": 3, "rewritten": 6, "shrunk": 2, "gone": 0, "fresh": 1, "lost": 0, "long one": 65536}
    assert got["grown"]["prefix_hash"] == sha(b"abcdef") and got["long one"]["prefix_hash"] == sha(big[:65536])


def test_archive_loop_closes(spark, tmp_path):
    """Scan, append, scan again: no change the second time; a scan that is appended again adds nothing; each later change comes once."""
    import os

    root, log = tmp_path / "files", f"{tmp_path}/log"
    root.mkdir()
    for i in range(1, 21):
        (root / f"f{i}.jsonl").write_bytes(b"line\n" * i)
    listing = lambda: archive.files(spark, str(root)).select(F.lit("s").alias("source"), "path", "size", "mtime_ms")
    counts = lambda df: {r["change"]: r["count"] for r in df.groupBy("change").count().collect()}
    first = archive.rescan(listing(), log, "scan-1", 1_000)
    assert counts(first) == {"new": 20} and archive.manifest_events(spark, log).count() == 20
    assert counts(archive.rescan(listing(), log, "scan-2", 2_000)) == {"same": 20}
    assert not archive.append_scan(archive.scan_events(first, 1_000), log, "scan-1") and archive.manifest_events(spark, log).count() == 20
    with open(root / "f3.jsonl", "ab") as f:
        f.write(b"more\n")
    (root / "f4.jsonl").write_bytes(b"other text altogether")
    (root / "f5.jsonl").unlink()
    os.utime(root / "f3.jsonl", (2_000_000_000, 2_000_000_000))
    os.utime(root / "f4.jsonl", (2_000_000_000, 2_000_000_000))
    third = archive.rescan(listing(), log, "scan-3", 3_000)
    assert counts(third) == {"same": 17, "appended": 1, "rewritten": 1, "vanished": 1}
    assert third.agg(F.sum("bytes_read")).first()[0] == 20 + 21
    assert counts(archive.rescan(listing(), log, "scan-4", 4_000)) == {"same": 19}
    events = archive.manifest_events(spark, log)
    assert {r["op"]: r["count"] for r in events.groupBy("op").count().collect()} == {"new": 20, "appended": 1, "rewritten": 1, "vanished": 1}
    state = archive.current(events, ["source", "path"], ["ts", "scan"])
    assert state.count() == 20 and state.where("op = 'vanished'").count() == 1
    held = archive.occupancy(listing(), third).collect()[0]
    assert (held["files"], held["appended"], held["vanished"]) == (19, 1, 1) and held["allocated_bytes"] >= held["apparent_bytes"] == sum(x.stat().st_size for x in root.iterdir())


def test_commits_of_several_tables(spark, tmp_path):
    """A failed or overtaken rebuild leaves the former version; upserts come once for each entry of a ledger and rewrite only their buckets."""
    path = f"{tmp_path}/t"
    msgs = lambda n: spark.createDataFrame([(f"m{i}", "c", False, "main", i) for i in range(n)], "id string, conv_id string, is_sidechain boolean, thread_key string, seq int")
    convs = lambda t: spark.createDataFrame([("c", t)], "id string, title string")
    told = lambda: (lambda c, m: (c.first()["title"], m.count()))(*tables.read(spark, path))
    tables.write(convs("one"), msgs(3), path)
    assert told() == ("one", 3)
    held = tables.read(spark, path)
    broken = msgs(5).withColumn("seq", F.expr("if(seq = 4, raise_error('no'), seq)").cast("int"))
    with pytest.raises(Exception, match="no"):
        tables.write(convs("two"), broken, path)
    assert told() == ("one", 3)
    seen = tables.pointer(spark, path)
    tables.write(convs("three"), msgs(4), path)
    assert told() == ("three", 4) and held[1].count() == 3  # who has the former version keeps it
    with pytest.raises(tables.Conflict):
        tables._commit(spark, path, seen, seen["commit"])
    assert len(tables.vacuum(spark, path, older_than_s=-10)) == 2 and told() == ("three", 4)

    path = f"{tmp_path}/u"
    rows = lambda *r: {"x": spark.createDataFrame(r, "file string, v long")}
    every = lambda: sorted(map(tuple, tables.load(spark, path, "x").collect()))
    assert tables.upsert(spark, path, rows(*[(f"f{i}", i) for i in range(30)]), "a", 0, buckets=8)
    before = tables.pointer(spark, path)["tables"]["x"]
    assert not tables.upsert(spark, path, rows(("f1", 99)), "a", 0, buckets=8)
    assert tables.upsert(spark, path, rows(("f1", 7), ("f1", 8), ("new", 1)), "a", 1, buckets=8)
    assert every() == sorted([(f"f{i}", i) for i in range(30) if i != 1] + [("f1", 7), ("f1", 8), ("new", 1)])
    after = tables.pointer(spark, path)["tables"]["x"]
    assert set(before) <= set(after) and 1 <= sum(before.get(b) != v for b, v in after.items()) <= 2
    assert tables.upsert(spark, path, rows(("f1", 5)), "b", 0, buckets=8) and (("f1", 5) in every()) and (("f1", 7) not in every())


def test_stored_files_go_with_their_scope(spark):
    import os

    from convlens.lineage import kept, scope, stored

    place = lambda df: df.inputFiles()[0].removeprefix("file://")
    with scope(spark):
        with scope(spark):
            inner, outer = stored(spark.range(5), "a"), kept(spark.range(6), "b")
            gone, there = place(inner), place(outer)
            assert os.path.exists(gone) and os.path.exists(there)
        assert not os.path.exists(gone) and outer.count() == 6
    assert not os.path.exists(there)
    assert os.path.exists(place(stored(spark.range(5), "c")))


def test_build_counts_what_it_writes(spark, tmp_path):
    """The report is that of the tables written, and comes without another job over them."""
    from convlens.plans import build

    heads = lambda *r: spark.createDataFrame(r, "conv_id string, file string, title string")
    rows = lambda *r: spark.createDataFrame(r, "id string, conv_id string, file string, is_sidechain boolean, thread_key string, seq int, kind string, text string")
    one = (heads(("c1", "f1", None), ("c2", "f1", "t"), ("c1", "f2", "u")), rows(("m1", "c1", "f1", False, "main", 0, "prose", "é"), ("m1", "c1", "f2", False, "main", 0, "prose", "later"), ("m2", "c2", "f1", False, "main", 0, "tool_call", None)))
    report = build.build_tables({"one": one, "none": (heads().limit(0), rows().limit(0))}, ["title"], f"{tmp_path}/t")
    assert sorted(map(tuple, report.collect())) == [("none", 0, 0, 0, 0, 0, 0, 0, "no rows"), ("one", 2, 2, 1, 2, 1, 1, 2, "ok")]
    convs, msgs = tables.read(spark, f"{tmp_path}/t")
    assert {(r["conv_id"], r["title"]) for r in convs.collect()} == {("c1", "u"), ("c2", "t")} and msgs.count() == 2


def test_preorder_of_random_forests(spark):
    """Roots, children out of order, unknown parents, cycles and what hangs from them, against a walk with a stack."""
    import random

    from convlens.operators import walks

    def walked(cells):
        children, ups = {}, {n: u for n, u, _ in cells}
        for node, up, ord_ in cells:
            children.setdefault(up if up in ups else None, []).append((ord_ or 0, node))
        done = {}
        for start in [*sorted(n for _, n in children.get(None, [])), *sorted(ups)]:
            stack = [(start, None)]
            while stack:
                node, up = stack.pop()
                if node not in done:
                    done[node] = up
                    stack += [(child, node) for _, child in sorted(children.get(node, []), reverse=True)]
        return {(node, up, i) for i, (node, up) in enumerate(done.items())}

    pick, rows, want = random.Random(6), [], {}
    for conv in range(40):
        n = pick.choice([1, 2, 5, 30, 60])
        names = [f"n{i:02d}" for i in pick.sample(range(100), n)]
        up = lambda i: pick.choice([None, "lost", *names]) if conv % 3 == 0 else pick.choice([None, *names[:i]]) if conv % 3 == 1 else (names[i - 1] if i else None)  # noqa: E731, B023
        cells = [(name, up(i), pick.choice([0, 1, 2, None])) for i, name in enumerate(names)]
        rows += [(f"c{conv}", *c) for c in cells]
        want[f"c{conv}"] = walked(cells)
    out = walks.preorder(spark.createDataFrame(rows, "native_id string, node string, up string, ord int"), "native_id")
    got = {}
    for r in out.collect():
        got.setdefault(r["native_id"], set()).add((r["node"], r["up"], r["walk"]))
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_fork_cycles_are_errors(spark):
    rows = [(1, 2), (2, 3), (3, 1), (4, 1), (5, None), (6, 5)]
    with pytest.raises(ValueError, match="cycle"):
        model.fork_tree(spark.createDataFrame(rows, "id long, forked_from long"))
    assert model.fork_tree(spark.createDataFrame(rows[4:], "id long, forked_from long")).count() == 2


def test_snippets_of_very_many_matches_and_halved_marks():
    import time

    from convlens.plans import search

    text, began = "foo " * 100_000, time.time()
    body, marks = search.snippet(text, [(4 * i, 4 * i + 3) for i in range(100_000)])
    assert time.time() - began < 5 and len(body) == 160 and len(marks) >= 39 and all(body[a:b] == "foo" for a, b in marks)
    # A mark that the cut halves is clipped to what is shown, and one longer than the window as well.
    body, marks = search.snippet("x" * 50 + "match" * 10 + "y" * 50, [(50, 100)], 30)
    assert len(body) == 30 and len(marks) == 1 and set(body[slice(*marks[0])]) <= set("match") and marks[0][1] - marks[0][0] >= 28
    text = "aa bb " + "z" * 40 + " cc"
    body, marks = search.snippet(text, [(0, 2), (3, 5), (47, 49)], 20)
    assert [body[a:b] for a, b in marks] == ["aa", "bb"]


@pytest.mark.parametrize("n", [1, 2, 70])
def test_long_chains(spark, n):
    rows = [(f"m{i}", "c", f"m{i - 1}" if i else None, "main", i) for i in range(n)]
    msgs = spark.createDataFrame([*rows, ("side", "c", "m0", "main", -1)], "id string, conv_id string, parent_id string, thread_key string, seq int")
    got = {r["id"] for r in model.head_path(msgs).where("on_head_path").collect()}
    assert got == {f"m{i}" for i in range(n)}
    heads = spark.createDataFrame([("c", "side")], "conv_id string, head_id string")
    assert {r["id"] for r in model.head_path(msgs, heads).where("on_head_path").collect()} == {"side", "m0"}


def test_queries_phrases_and_snippets(spark):
    docs = spark.createDataFrame([("a", "prose", "the foo bar of foo_bar"), ("b", "prose", "bar foo apart"), ("c", "prose", "food")], "id string, kind string, text string")
    from convlens.operators import postings

    asks = search.prepare_queries(spark.createDataFrame([(1, "foo_bar x"), (2, "Foo"), (3, "fo"), (4, " ,"), (5, "bar foo ")], "qid long, q string"))
    assert {r["qid"]: r["mode"] for r in asks.collect()} == {1: "searchable", 2: "searchable", 3: "too_short", 4: "empty", 5: "searchable"}
    hits = search.match(asks.where("qid <> 1").union(search.prepare_queries(spark.createDataFrame([(1, "foo_bar ")], "qid long, q string"))), postings.build(docs))
    got = {}
    for r in hits.collect():
        got.setdefault(r["qid"], set()).add(r["msg_id"])
    assert got == {1: {"a"}, 2: {"a", "b", "c"}, 5: {"a", "b"}}
    text = "x " * 200 + "needle here " + "y " * 200
    body, marks = search.snippet(text, [(400, 406)], 60)
    assert len(body) <= 60 and [body[a:b] for a, b in marks] == ["needle"] and body[0] == body[-1] == "…"
