"""Marks of many queries on many conversations, against plain Python, and the work that they take."""

import re

from pyspark.sql import functions as F

from convlens.operators import transcript
from convlens.plans import search


def spans(text, terms):
    """Sorted (start, end) in bytes of the words that any of (term, is_prefix) matches."""
    at = lambda i: len(text[:i].encode())
    return [(at(m.start()), at(m.end())) for m in re.finditer(r"\w+", text) if any(p and m[0].lower().startswith(t) or m[0].lower() == t for t, p in terms)]


def test_marks_of_overlapping_terms_repeated_rows_and_every_kind(spark):
    said = [
        (1, "1:0", "prose", True, "Stone stones, stonework — the STONE"), (1, "1:1", "reasoning", True, "€ the stone"), (1, "1:2", "tool_result", False, "stone"),
        (1, "1:3", "prose", True, None), (2, "2:0", "tool_call", True, "stone the"), (2, "2:1", "prose", True, ""), (3, "3:0", "prose", True, "the"),
    ]
    blocks = spark.createDataFrame([*said, said[0]], "conv_id long, id string, kind string, drawn boolean, text string")
    terms = {1: [("the", False)], 2: [("stone", False), ("sto", True)], 3: [("stone", False), ("stone", True), ("t", True)], 4: [("stones", False), ("the", False)], 5: [("s", True), ("sto", True), ("stone", False)], 6: [("nowhere", False)], 7: [(w, False) for w in ("the", "stone", "stones", "stonework", *"abcdefgh")]}
    asks = spark.createDataFrame([(q, t, p) for q, own in terms.items() for t, p in own], "qid long, term string, is_prefix boolean").groupBy("qid", "term").agg(F.max("is_prefix").alias("is_prefix"))
    pairs = [(q, c) for q in terms for c in (1, 2)] + [(1, 3), (1, 3), (9, 3)]
    got = transcript.marked(blocks, spark.createDataFrame(pairs, "qid long, conv_id long"), asks).collect()
    want = {(q, i, "unranked" if kind == "reasoning" else "ranked"): spans(text, terms[q]) for c, i, kind, drawn, text in said if drawn and text for q in terms if (q, c) in pairs}
    assert {(r["qid"], r["id"], r["mark_kind"]): [tuple(m) for m in r["marks"]] for r in got} == {k: v for k, v in want.items() if v}
    assert len(got) == len({(r["qid"], r["id"]) for r in got}) and all(r["words"] == len(r["marks"]) for r in got)
    apart = [transcript.marked(blocks, spark.createDataFrame(pairs, "qid long, conv_id long"), asks, small=n).collect() for n in (0, 2)]  # by term, and both ways
    assert all(sorted(map(tuple, a)) == sorted(map(tuple, got)) for a in apart)
    counted = transcript.marked(blocks, spark.createDataFrame(pairs, "qid long, conv_id long"), asks, spans=False).collect()
    assert sorted(map(tuple, counted)) == sorted(tuple(r)[:4] for r in got)


def test_a_text_is_read_once_however_many_queries_mark_it(spark):
    """Words of one text meet the two terms that 300 queries ask for: two rows, which the queries are joined with."""
    text = "some words here " * 200
    asks = spark.createDataFrame([(q, t, p) for q in range(300) for t, p in (("words", False), ("so", True))], "qid long, term string, is_prefix boolean")
    terms = spark.createDataFrame([(0, "words", False), (1, "so", True)], "term_id long, term string, is_prefix boolean")
    found = search.term_spans(spark.createDataFrame([(1, "1:0", text)], "conv_id long, id string, text string"), terms)
    assert {(r["term_id"], r["words"], len(r["spans"])) for r in found.collect()} == {(0, 200, 200), (1, 200, 200)} and found.count() == 2
    blocks = spark.createDataFrame([(1, "1:0", "prose", True, text)], "conv_id long, id string, kind string, drawn boolean, text string")
    out = transcript.marked(blocks, asks.select("qid", F.lit(1).cast("long").alias("conv_id")), asks)
    assert {(r["qid"], r["words"]) for r in out.collect()} == {(q, 400) for q in range(300)}
