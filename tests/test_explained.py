"""Every query with every conversation: cells of bits against the explanation of pairs one by one."""

import random

from pyspark.sql import functions as F

from convlens.operators import explain
from convlens.plans import search


def test_terms_stand_inside_words_as_in_a_search_of_the_text(spark):
    texts = ["Straße_7 straßen", "naïve naïvety ét", "漢字漢字 𝒳y𝒳 x", "a" * 300 + "b", "", None, "one-two_three 12a34"]
    rows = [(i, k, t) for i, t in enumerate(texts) for k in (("prose", "reasoning")[i % 2], "tool_call")] + [(0, "reasoning", "reason straße"), (1, "prose", "vet")]
    asks = search.prepare_queries(spark.createDataFrame([(0, "straß e_7 aß n vet ety"), (1, "t e 字漢 𝒳y y𝒳 𝒳"), (2, "a" * 299 + "b " + "a" * 301), (3, "two_t o_t ot 2a3 zz")], "qid long, q string"))
    terms = [r["term"] for r in asks.select(F.explode("terms").alias("term")).distinct().collect()]
    want = {(c, t): any(k == "prose" and t in x.lower() for c2, k, x in rows if c2 == c and x) for c, k, x in rows if k != "tool_call" and x for t in terms if t in x.lower()}
    frame = spark.createDataFrame(rows, "conv_id long, kind string, text string")
    got = explain.held_terms(asks.select(F.explode("terms").alias("term")).distinct(), frame).collect()
    assert len(got) == len(want) > 20 and {(r["conv_id"], r["term"]): r["in_prose"] for r in got} == want
    assert explain.held_terms(spark.createDataFrame([], "term string"), frame).count() == 0


def test_cells_hold_long_queries_repeated_ones_and_ones_without_terms(spark):
    pick = random.Random(3)
    words = [f"w{i:03}" for i in range(260)]
    said = [(f"{c}:{t}", c, c * 1000 + t, ("prose", "reasoning", "tool_call")[(c + t) % 3], t != 1, " ".join(pick.sample(words, 60))) for c in range(9) for t in range(4)]
    rows = spark.createDataFrame(said, "id string, conv_id long, ts_ms long, kind string, on_head_path boolean, text string")
    ask = lambda n: " ".join(pick.sample(words, n)) + " "
    lists = [(i, ask(n)) for i, n in enumerate([1, 2, 3, 5, 63, 64, 65, 128, 129, 200] * 3 + [2] * 150)] + [(900, ""), (901, "w"), (902, "w001 w001 W001 "), (903, "nowhere ")]
    asks = search.prepare_queries(spark.createDataFrame(lists, "qid long, q string"))
    found = spark.createDataFrame([(q, f"{c}:{t}", -1.0 - q - t) for q in (0, 5, 9, 40, 902) for c in range(4) for t in range(2)], "qid long, msg_id string, score double")
    convs = spark.createDataFrame([(c,) for c in range(9)], "id long")
    asked = spark.createDataFrame([(c,) for c in (*range(9), -1)], "conv_id long")
    pairs = asks.select("qid").crossJoin(asked)
    one = explain.run(pairs, asks, convs, rows, found, pairs.where("conv_id <> 4"), 10_000, most=5)
    every = explain.every(asked, asks, convs, rows, found, asked.where("conv_id <> 4"), 10_000, most=5)
    assert every.dtypes == one.dtypes
    key = lambda r: r[:2]
    got, want = sorted(map(tuple, every.collect()), key=key), sorted(map(tuple, one.collect()), key=key)
    assert got == want and len(got) == len(lists) * 10 and max(r[6] for r in got) > 64
    twice = explain.every(asked, asks.union(asks), convs, rows, found, asked.where("conv_id <> 4"), 10_000, most=5)
    assert sorted(map(tuple, twice.collect()), key=key) == sorted(got + got, key=key)  # as a join of pairs with queries gives them
    assert "contains(" not in every._jdf.queryExecution().optimizedPlan().toString().lower()  # no text is searched for each term
