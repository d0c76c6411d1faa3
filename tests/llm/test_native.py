"""Scans and chat formatting against plain Python over every document of the smallest table, and over odd inputs."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from convlens.llm import chat, pii, queries, secrets
from convlens.llm.oracle import SQL
from convlens.functions.arrays import running, running_max

DATA = "/root/testdata/sf0.001"
ODD = [
    None,
    "",
    "token=abc token=abcdefghi secret=token:abcdefghij API_KEY: 'AKIAAKIA12345678901' passwd = \"0123456789abcdef0123456789abcdef\"",
    "é𝒳 a.b+c@x-y.example.com_foo@z.org x@y 1.2.3.4.5.6.7.8 256.1.1.1 007.0.0.255",
    "4111 1111 1111 1111 5500-0000-0000-0004 +1 (017) 555-7713 +12 +1234567890123456",
    "1" * 60000,
    "a" * 60000 + "@",
    "1 " * 30000,
    "AKIA" + "A" * 40 + " token " + " " * 5000 + "=x",
]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def base_secrets(t):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def luhn(d):
    return sum(int(x) if i % 2 == 0 else int(x) * 2 - 9 * (int(x) > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def base_pii(t):
    out = [(0, m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t if "@" in t and len(t) < 50000 else "")]
    out += [(1, m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), "card", m.end()))
    out += [(3, m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{s}:{e}" for _, s, k, e in sorted(out))


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, row_key string, spans int").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("query,base", [(queries.op5_secret_scan, base_secrets), (queries.op10_pii, base_pii)])
def test_base_spans_match_plain_python(spark, tmp_path, query, base):
    for folder in (DATA, documents(spark, tmp_path, [(i, t, "x", "y", 1) for i, t in enumerate(ODD)] + [(None, "AKIA" + "Z" * 12, None, None, None)] * 2)):
        texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        want = sorted(((r[0] is None, r[0], sha(base(r[1] or ""))) for r in texts), key=str)
        got = query(spark, folder).collect()
        assert sorted(((r["doc_id"] is None, r["doc_id"], r["base_sha256"]) for r in got), key=str) == want
        for r in got:
            assert sha(",".join(x for x in r["spans"].split(",") if x.split(":")[0] in ("assign", "access", "hex", "email", "ip", "card", "phone"))) == r["base_sha256"]


def test_weak_parts_are_linked_only_together(spark):
    weak = "x9" * 15
    rows = [(1, f"AKIA{'B' * 12} then {weak} ."), (2, f"nothing but {weak} ."), (3, f"AKIA{'B' * 12} {'word ' * 100} {weak} ."), (4, f"{weak} at https://db.example.org/x")]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["access", "weak_secret"], 2: [], 3: ["access"], 4: ["weak_secret"]}


def test_long_and_weak_parts_are_linked_from_edge_to_edge(spark):
    url, key, name = "https://store.example.org/x", "Ab9/" * 21 + "Q1", "ID34" * 3
    rows = [
        (1, f"AKIA{'B' * 12} AccountKey={key}== ."), (2, f"{key} at {url}"), (3, f"password={'v' * 400} {'Q7' * 20} {url}"),
        (4, f"{name} {'x9' * 15} {url}"), (5, f"{'Q7' * 15} {url}"), (6, f"https://a.example.org/{'p' * 600} {'x9' * 15}"), (7, f"{'x9' * 15} {'y ' * 100} {name}"), (8, None),
        (9, f"{'x9' * 15} {'y ' * 150} {url}"), (10, f"{name} {url} {'y ' * 100} {'x9' * 30}"), (11, f"{'x9' * 200} {'y ' * 100} AKIA{'B' * 12}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scanned = secrets.scan_secrets(docs)
    got = {r["doc_id"]: sorted((s["kind"], s["end"] - s["start"]) for s in r["spans"]) for r in scanned.collect()}
    assert got[1] == [("access", 16), ("weak_secret", 86)] and got[2] == [("weak_secret", 86)]
    assert {k for k, _ in got[3]} == {"assign", "weak_secret", "weak_access", "endpoint"} and ("weak_access", 40) in got[3]
    assert got[4] == [("endpoint", len(url)), ("weak_access", 12), ("weak_secret", 30)]
    assert got[5] == [("weak_secret", 30)]  # one string completes no other part by itself
    assert ("weak_secret", 30) in got[6]
    assert got[7] == [] and got[8] == [] and got[9] == []
    assert ("weak_access", 12) in got[10] and ("weak_secret", 60) in got[10]
    assert got[11] == [("access", 16), ("weak_secret", 400)]
    assert key not in {r["doc_id"]: r["text"] for r in secrets.redact(docs, scanned).collect()}[1]


def test_redaction_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a token=abcdefgh12 b", "en"), (2, None, None)], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs, secrets.scan_secrets(docs)).collect()}
    assert out == {1: "a [assign] b", 2: None}


def test_labelers_learn_and_find_weak_spans(spark):
    rows = [(i, f"please call or mail anna at gmail dot com soon {i}") for i in range(30)] + [(100 + i, f"version 123456{i} of it") for i in range(10, 40)]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == ["spoken_mail"] for i in range(30))
    assert all(not v for k, v in got.items() if k >= 100)


def test_precision_and_recall_on_planted_spans(spark):
    import random

    pick = random.Random(4)
    filler = "the river runs past old mills and quiet fields where people walk on warm days".split()
    words = lambda n: " ".join(pick.choice(filler) for _ in range(n))
    names, hosts = ["zoltan", "brigida", "anna", "peter", "ingmar"], ["mailbarn", "gmail", "postnest"]
    rows, want = [], set()
    for i in range(600):
        say = pick.choice(["mail", "name", "phone", "version", "order", "dot", "address"])
        name, host = pick.choice(names), pick.choice(hosts)
        if say == "mail":
            span, lead = f"{name}.{pick.choice(filler)} at {host} dot com", "contact "
        elif say == "name":
            span, lead = f"Dr {name.title()} Weber", "you can reach "
        elif say == "phone":
            span, lead = f"0170 {pick.randrange(100, 999)} {pick.randrange(1000, 9999)}", "please call "
        elif say == "version":
            span, lead = str(pick.randrange(10**6, 10**7)), "version "
        elif say == "order":
            span, lead = f"{pick.randrange(1000, 9999)} {pick.randrange(1000, 9999)}", "order id "
        elif say == "dot":
            span, lead = "walk at mills dot fieldset", "they "
        else:
            span, lead = f"{name}.{pick.choice(filler)}@{host}.com", "write to "
        before = f"{words(8)} {lead}"
        rows.append((i, f"{before}{span} {words(6)}"))
        if say in ("mail", "name", "phone", "address"):
            want.add((i, len(before), len(before) + len(span)))
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r["doc_id"], s["start"], s["end"]) for r in found for s in r["spans"]}
    assert len(got & want) >= 0.95 * len(got) and len(got & want) >= 0.9 * len(want)


def test_gazetteer_grows_by_written_addresses(spark):
    rows = [(1, "zoltan.k@mailbarn.org"), (2, "Zoltan_x@mailbarn.org"), (3, "once@single.net once@single.net"), (4, None)]
    hits = pii._hits(spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    words = {(r["list"], r["word"]) for r in pii.gazetteer(hits).collect()}
    assert {("host", "mailbarn"), ("name", "zoltan"), ("name", "anna")} <= words and not {("host", "single"), ("name", "once")} & words


def brute_links(text, scope=256):
    """Weak spans by comparing all parts of one text with all."""
    find = lambda p: [(m.start(), m.end(), m[0]) for m in re.finditer(p, text)]
    base = [tuple(x.split(":")) for x in base_secrets(text).split(",") if x]
    parts = {
        "secret": [(int(s), int(e)) for k, s, e in base if k != "access"],
        "access": [(int(s), int(e)) for k, s, e in base if k == "access"],
        "weak_secret": [(s, e) for s, e, t in find(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}(?![A-Za-z0-9+/_-])") if re.search("[0-9]", t) and re.search("[A-Za-z]", t)],
        "weak_access": [(s, e) for s, e, t in find(r"(?<![A-Za-z0-9])[A-Z0-9]{12,}(?![A-Za-z0-9])") if re.search("[0-9]", t) and re.search("[A-Z]", t) and not t.startswith("AKIA")],
        "endpoint": [(s, e) for s, e, _ in find(r"(?<![A-Za-z0-9])(?:https?://[A-Za-z0-9./_-]+|[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+:[0-9]{2,5})")],
    }
    apart = lambda a, b: max(a[0] - b[1], b[0] - a[1])
    near = lambda x, p: [y for y in parts[p] if apart(x, y) <= scope]
    beside = lambda x, p: [y for y in near(x, p) if apart(x, y) >= 0]
    out = {("weak_secret", *x) for x in parts["weak_secret"] if near(x, "access") or near(x, "endpoint")}
    out |= {("weak_access", *x) for x in parts["weak_access"] if near(x, "endpoint") and (near(x, "secret") or beside(x, "weak_secret"))}
    both = lambda x: any(a[1] <= b[0] or b[1] <= a[0] for a in beside(x, "weak_secret") for b in beside(x, "weak_access"))
    return out | {("endpoint", *x) for x in parts["endpoint"] if near(x, "access") or near(x, "secret") or both(x)}


def test_linked_spans_match_brute_force(spark):
    import random

    pick = random.Random(9)
    pieces = [lambda: "AKIA" + "B" * 14, lambda: "token=" + "k3" * 6, lambda: "x9Y" * pick.randrange(8, 40), lambda: "ID34" * pick.randrange(3, 9), lambda: "https://db.example.org/x", lambda: "db-1.example.org:5432", lambda: "ab12" * 8]
    rows = [(i, " ".join(pick.choice(pieces)() if pick.random() < 0.3 else "word " * pick.randrange(1, 40) for _ in range(pick.randrange(1, 25)))) for i in range(200)]
    got = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = {r["doc_id"]: {(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in secrets.WEAK_KINDS} for r in got}
    assert linked == {i: brute_links(t) for i, t in rows} and sum(map(len, linked.values())) > 200


def test_chats_round_trip(spark, tmp_path):
    rows = [
        (1, 1, "user", r"a \b <|end|> \m"), (1, 0, "sys|>tem<|", None), (1, 2, "user", ""), (1, 3, "assistant", "<|next|>"), (1, 4, "assistant", "x\n"),
        (2, None, None, "t"), (2, 0, "assistant", "y"), (2, 0, "assistant", "y"), (None, 0, "user", "z"),
    ]
    turns = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    for conv in (1, 2, None):
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))]
        assert [tuple(t) for t in got[conv]["turns"]] == want
        assert got[conv]["loss_text"] == "".join(t for r, t in want if r == "assistant")
        spans = [(m["start"], m["end"]) for m in got[conv]["mask"]]
        under = [got[conv]["formatted"][a:b] for a, b in spans]
        assert [u.replace("\\m", "<|").replace("\\b", "\\") for u in under] == [t for r, t in want if r == "assistant"]
        assert not any("<|" in u for u in under) and spans == sorted(spans)
    blocks = {r["conv_id"]: (r["n_turns"], r["n_blocks"]) for r in chat.format_chats(turns).collect()}
    assert blocks == {1: (5, 3), 2: (3, 2), None: (1, 1)}
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_rows_without_a_conversation_stand_alone(spark):
    """Very many rows whose conversation is null are not gathered into one: each is a conversation of its own, equal ones too."""
    turns = spark.range(20_000).select(F.lit(None).cast("long").alias("conv_id"), F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("said "), (F.col("id") % 7).cast("string")).alias("text"))
    out = chat.read_chats(chat.format_chats(turns)).groupBy("loss_text", F.size("turns").alias("n")).count().collect()
    assert len(out) == 7 and {r["n"] for r in out} == {1} and sum(r["count"] for r in out) == 20_000


def test_mask_of_a_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"𝒳 turn {i} <|end|> \\") for i in range(1000)]
    row = chat.read_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()[0]
    assert len(row["mask"]) == sum(r[2] == "assistant" for r in rows) and row["loss_text"] == "".join(r[3] for r in rows if r[2] == "assistant")
    assert [tuple(t) for t in row["turns"]] == [r[2:] for r in rows]


def test_running_sums(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        numbers = [i * 7 % 13 for i in range(n)]
        df = spark.createDataFrame([(numbers,)], "n array<int>").select(running("n").alias("r"))
        assert df.collect()[0]["r"] == [sum(numbers[:i]) for i in range(n)]
        most = spark.createDataFrame([(numbers,)], "n array<int>").select(running_max("n").alias("r"))
        assert most.collect()[0]["r"] == [max(numbers[:i], default=0) for i in range(n)]


def test_a_text_with_very_many_matches(spark):
    docs = spark.createDataFrame([(1, "a@b.co " * 100_000)], "doc_id long, text string")
    spans = pii.find_pii(docs).select(F.size("base").alias("n"), F.element_at("base", -1).alias("last")).collect()[0]
    assert spans["n"] == 100_000 and spans["last"]["end"] == 7 * 100_000 - 1


def test_redaction_of_very_many_matches(spark):
    """Time does not grow with the square of the matches; code points beyond 16 bits and spans at both ends are kept apart."""
    said = "token=abcdefgh12 𝒳 "
    docs = spark.createDataFrame([(1, said * 100_000), (2, said), (3, "no such thing 𝒳")], "doc_id long, text string")
    began = time.time()
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs, secrets.scan_secrets(docs)).collect()}
    assert time.time() - began < 60
    assert out == {1: "[assign] 𝒳 " * 100_000, 2: "[assign] 𝒳 ", 3: "no such thing 𝒳"}


def test_redaction_melts_overlapping_spans(spark):
    pick = random.Random(8)
    rows, spans, want = [], [], []
    for i in range(60):
        text = "".join(pick.choice("abc𝒳é \n") for _ in range(pick.choice([0, 5, 3000])))
        own = sorted((a, f"k{pick.randrange(3)}", a + pick.randrange(1, 40)) for a in (pick.randrange(len(text)) for _ in range(pick.randrange(12) if text else 0)))
        own = [(a, k, min(b, len(text))) for a, k, b in own]
        out, at = "", 0
        for a, k, b in own:
            if a >= at:
                out += text[at:a] + f"[{k}]"
            at = max(at, b)
        rows.append((i, text))
        spans.append((i, own))
        want.append((i, out + text[at:] if own else text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = spark.createDataFrame(spans, "doc_id long, spans array<struct<start:int,kind:string,end:int>>").join(docs.select("doc_id", F.xxhash64("text").alias("row_key")), "doc_id")
    assert sorted(tuple(r) for r in secrets.redact(docs, found).collect()) == want


def test_weak_spans_beside_very_many_base_spans(spark):
    """Weak spans are free of base spans whatever the order of kinds, and many of both in one text are merged by place."""
    said = "a@b.co Mr Anna Smith, 10.0.0.1, 12345678; 4111111111111111, "
    docs = spark.createDataFrame([(1, said * 20_000), (2, said)], "doc_id long, text string")
    began = time.time()
    hits = {r["doc_id"]: r for r in pii._hits(docs).select("doc_id", F.size("base").alias("n"), "weak").collect()}
    assert time.time() - began < 60
    assert hits[1]["n"] == 60_000 and hits[2]["n"] == 3
    told = lambda r: [(w["kind"], w["start"], w["text"], w["before"]) for w in r["weak"]]
    assert told(hits[2]) == [("name", 7, "Mr Anna Smith", "a@b.co "), ("digits", 32, "12345678", said[:32])]
    assert [w["start"] for w in hits[1]["weak"]] == [len(said) * i + k for i in range(20_000) for k in (7, 32)]
    assert all(w["before"] == (said * 2)[len(said) + w["start"] % len(said) - 40 : len(said) + w["start"] % len(said)] for w in hits[1]["weak"][2:])


@pytest.mark.parametrize("scan", [secrets.scan_secrets, pii.find_pii])
def test_scans_of_an_empty_table(spark, scan):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_chat_query_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    want = sorted(con.execute(f"select conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from ({SQL['op9_chat_format']})").fetchall())
    assert sorted(tuple(r) for r in queries.op9_chat_format(spark, DATA).collect()) == want
