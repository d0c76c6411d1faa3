"""Ranked lexical search, fill-in-middle and quality rules against plain Python and SQL over whole small tables."""

import hashlib
import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent.parent))
from compare import compare, connect  # noqa: E402

from convlens.llm import fim, lexical, oracle, queries, rules  # noqa: E402
from convlens.llm.shared import bounded_batches, stored  # noqa: E402
from convlens.llm.wavelet import WaveletMatrix  # noqa: E402

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_fill_in_middle", "op13_quality_rules"])
def test_query_matches_sql(spark, name):
    (columns, got), (want_columns, want) = compare(queries.QUERIES[name](spark, DATA), connect(DATA), oracle.SQL[name])
    assert columns == want_columns
    assert got == want and got


# --- search ----------------------------------------------------------------------------------------------------------


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k=20):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, tokens = len(counts), sum(n for _, _, n in counts)
    out = []
    for item, text in items:
        asked = Counter(terms_of(text))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c, _ in counts) + 1))) for t in asked}
        score = lambda c, n: sum(q * weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // tokens))) for t, q in asked.items() if t in c)
        best = sorted((-score(c, n), i is None, i or 0) for i, c, n in counts if score(c, n) > 0)[:k]
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(best)]
    return sorted(out, key=str)


def searched(spark, docs, items, **how):
    bounded_batches(spark)
    frame = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("clash")).withColumn("rank", F.lit(1))
    index = stored(lexical.build_index(frame, **{k: v for k, v in how.items() if k == "shard_bytes"}), "index")
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("clash"))
    out = lexical.search(index, asked, **{k: v for k, v in how.items() if k != "shard_bytes"})
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"  # noqa: E731  few common words, many rare ones
    docs = [(i, " ".join(word() for _ in range(rng.choice([3, 30, 200])))) for i in range(n)]
    docs += [(n + 7, docs[5][1]), (n + 3, docs[5][1]), (n + 3, docs[5][1])]  # ties, and an id that is there twice
    return docs, [(q, " ".join(word() for _ in range(rng.choice([1, 4, 12])))) for q in range(40)]


def test_shards_keep_their_size_whatever_comes_in_a_batch(spark):
    docs = [(i, None if i % 50 == 7 else f"word{i} and word{i + 1} " * 40) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    shards = lexical.build_index(frame, shard_bytes=20_000).collect()
    size = {i: len(t or "") for i, t in docs}
    assert sorted(d for s in shards for d in s["doc_ids"]) == sorted(size)
    held = [sum(size[d] for d in s["doc_ids"]) for s in shards]
    assert len(held) > 10 and max(held) <= 25_000 and min(held[:-1]) >= 20_000


@pytest.mark.parametrize("shard_bytes", [2_000, 1 << 20])
def test_search_is_exact_over_many_shards(spark, shard_bytes):
    docs, items = corpus()
    assert searched(spark, docs, items, shard_bytes=shard_bytes) == ranked(docs, items)


def test_search_does_not_depend_on_blocks_of_items(spark):
    docs, items = corpus(200)
    items += [(1, items[1][1]), (1, items[2][1]), (None, items[3][1])]
    assert searched(spark, docs, items, query_bytes=100) == searched(spark, docs, items) == ranked(docs, items)


def test_search_of_odd_rows(spark):
    docs = [(None, "Alpha beta"), (None, "alpha BETA"), (4, "alpha beta"), (2, None), (3, ""), (9, "--- !"), (7, "ÄLPHA älpha Ü1_x")]
    items = [(1, "ALPHA, beta"), (2, None), (3, ""), (4, "nowhere"), (5, "Älpha"), (6, "älpha x alpha alpha")]
    assert searched(spark, docs, items) == ranked(docs, items)
    assert searched(spark, docs, items, k=1) == ranked(docs, items, 1)
    assert searched(spark, docs, []) == [] and searched(spark, [], items) == []


def test_long_text_is_read_in_pieces():
    rng = random.Random(1)
    text = "-".join(rng.choice(["ab", "Cd", "é" * 3, "x" * 50_000]) for _ in range(400))
    found = list(lexical.counted_terms(pa.array(["ab ab", text, "cd"])))
    assert len(found) > 5
    total = Counter()
    for row, term, count in found:
        for r, t, c in zip(row.tolist(), term.tolist(), count.tolist()):
            total[r, t] += c
    assert sorted(total.values()) == sorted([2, 1, *Counter(terms_of(text)).values()])


def test_block_maxima_spare_blocks():
    docs, items = corpus(3000)
    batch = pa.array([t for _, t in docs])
    own = lexical._Builder()
    own.ids, own.count = [pa.array([i for i, _ in docs], pa.int64())], len(docs)
    own.found = list(lexical.counted_terms(batch))
    row = dict(zip([p.split()[0] for p in lexical.SCHEMA.split(", ")], own.row()))
    shard = lexical.Shard(row, row["with_terms"], row["tokens"])
    # Block maxima are those of the postings themselves.
    for number in range(0, len(shard.terms), 7):
        docs_of, value = shard.whole(number)
        assert np.array_equal(shard.block_max[shard.blocks_of(number)], np.maximum.reduceat(value, np.arange(0, len(value), lexical.BLOCK)))
        assert (np.diff(docs_of) > 0).all() and shard.list_max[number] == value.max()
    common = np.argsort(-np.diff(shard.first_block))[:3]
    rare = np.argsort(np.diff(shard.first_block))[:1]
    lists, weights = np.concatenate([common, rare]), np.array([1, 1, 1, 50])
    every = lexical.Shard(row, row["with_terms"], row["tokens"])
    docs_all, scores = every.best(lists, weights, 1)
    threshold = int(np.sort(scores)[-3])
    fresh = lexical.Shard(row, row["with_terms"], row["tokens"])
    docs_best, best = fresh.best(lists, weights, threshold)
    assert sorted(zip(best.tolist(), docs_best.tolist())) == sorted((s, d) for s, d in zip(scores.tolist(), docs_all.tolist()) if s >= threshold)
    assert fresh.decompressed < every.decompressed / 3


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=200))
def test_postings_come_back(values):
    raw, at = lexical.encode(np.array(values, np.int64))
    assert lexical.decode(raw).tolist() == values if values else len(raw) == 0
    assert len(at) == len(values) + 1


# --- fill in middle --------------------------------------------------------------------------------------------------


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=300))
def test_ranks_of_a_wavelet_matrix(symbols):
    matrix = WaveletMatrix(np.array(symbols, np.uint8), 2)
    places = np.arange(len(symbols) + 1)
    for s in range(4):
        assert matrix.rank(s, places).tolist() == [symbols[:p].count(s) for p in places]
    n = sum(s >= 2 for s in symbols)
    starts = [i for i, s in enumerate(symbols) if s >= 2] + [len(symbols)]
    zero, end = np.zeros(n + 1, np.int64), np.full(n + 1, len(symbols))
    assert matrix.locate((2, 3), np.arange(n + 1), zero, end).tolist() == starts


def formed(doc_id, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    spm = h4 % 100 < 20
    return doc_id, len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_plain_python(spark):
    rng = random.Random(4)
    alphabet = ["a", "Z", "word", " ", "\n", "é", "ß", "漢", "😀", "<", ">", "<P", "S>", "M", "\x00", "1"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(600)]
    rows += [(7, None), (None, "no id at all"), (None, None), (8, ""), (8, "x"), (8, "x"), (900, "holds <S> a mark"), (901, "ab " * 400_000), (902, "q" * 700_000 + "é")]
    bounded_batches(spark)
    docs = spark.createDataFrame(rows, DOCS).withColumn("form", F.lit("clash")).withColumn("n", F.lit(None))
    out = fim.transform(docs).withColumn("restored", fim.restore("output", "form"))
    got = out.collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((formed(*r) for r in rows), key=str)
    assert sorted((r["restored"] for r in got)) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(spark.createDataFrame([], DOCS)).count() == 0


# --- quality rules ---------------------------------------------------------------------------------------------------


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    five = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(five)
    covered = {i + k for i, w in enumerate(five) if times[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_of_rules_against_plain_python(spark):
    rng = random.Random(5)
    alphabet = ["a", "b", "the", "der", "é", "#", "x|y", "\n", "\t", "  ", "\x0b", "\xa0", "a\n", "*", "— ", "…"]
    rows = [(i, " ".join(rng.choice(alphabet[: rng.choice([3, 16])]) for _ in range(rng.choice([0, 4, 5, 6, 30, 200])))) for i in range(300)]
    rows += [(1, None), (None, "a b c d e a b c d e"), (2, ""), (2, "\n \n"), (3, "one two three four five " * 50_000), (4, " ".join(map(str, range(60_000))))]
    docs = spark.createDataFrame(rows, DOCS).withColumn("words", F.lit("clash")).withColumn("n_words", F.lit(1))
    got = rules.apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *counted(t)) for i, t in rows), key=str)
    assert rules.apply_rules(spark.createDataFrame([], DOCS)).count() == 0


def test_rules_are_a_table(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat and it was a good day"), (2, "## | | $$ the %% && ## | <> $ # | of"), (3, None), (4, "xq zv " * 40)], DOCS)
    own = [rules.Rule("symbols", "symbols_a_word", most=0.1), rules.Rule("short", "n_words", least=12), rules.Rule("stops", "stop_word_share", least=0.01, from_words=50)]
    got = {r["doc_id"]: (r["failed"], r["kept"]) for r in rules.apply_rules(docs, own).collect()}
    assert got == {1: ([], True), 2: (["symbols"], False), 3: (["short"], False), 4: (["stops"], False)}
    assert all(r["kept"] for r in rules.apply_rules(docs, []).collect())
    with pytest.raises(ValueError, match="none of"):
        rules.compile_rules([rules.Rule("x", "no_such_measure", most=1)])


def test_rules_are_one_projection_without_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for df in (rules.measured(docs), rules.apply_rules(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_rules_leave_clean_documents(spark):
    """Of the documents labelled good, those of ten words or more whose words hardly repeat stay."""
    folder = "/root/testdata/sf0.01"
    judged = rules.apply_rules(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    base = (F.col("n_words") >= 10) & (F.col("measures.repeat_word_share") <= 0.2)
    good, bad = judged.where("quality = 1").where(base), judged.where("quality = 0")
    assert good.where("kept").count() >= 0.99 * good.count()
    assert bad.where("kept").count() <= 0.1 * bad.count()
