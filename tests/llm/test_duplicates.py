"""Near-duplicates and substring removal against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from convlens.llm import neardup

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, component_id string, n int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(t, k):
    w = WORD.findall(lower(t or ""))
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {" ".join(w)} - {""}


def brute_components(rows, k, percent=80):
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    at = {}
    for j, (_, s) in enumerate(sets):
        for g in s:
            at.setdefault(g, []).append(j)
    for j, (i, s) in enumerate(sets):
        seen = {}
        for g in s:
            for o in at[g]:
                if o < j:
                    seen[o] = seen.get(o, 0) + 1
        for o, n in seen.items():
            if 100 * n >= percent * (len(s) + len(sets[o][1]) - n):
                a, b = find(i), find(sets[o][0])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_copies(seed, n, words=60):
    pick = random.Random(seed)
    vocabulary = ["".join(pick.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    base = [pick.choice(vocabulary) for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(pick.randrange(0, 5)):
            own[pick.randrange(len(own))] = pick.choice(vocabulary).upper()
        out.append(" ".join(own))
    return out


def fixture():
    texts = near_copies(1, 150) + near_copies(2, 30, 12) + near_copies(3, 20, 3) + [None, "", " \n\t ", "one", "ONE", "one two", "É é", "é É", "a b c d e", "a b\x0bc d\x1ce"]
    texts += ["w " * 20000, "same old text of some words here"] * 20
    rows = list(enumerate(texts, 10))
    random.Random(4).shuffle(rows)
    return rows + [(None, "same old text of some words here"), (11, "a text that shares an id"), (11, "a text that shares an id"), (3, "a text that shares an id")]


@pytest.mark.parametrize("block", [8, 256])
@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_match_brute_force(spark, block, k):
    rows = fixture()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = neardup.near_duplicates(docs, shingle=k, block=block, direct=2).collect()
    want = brute_components(rows, k)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want | {None: None}
    assert sorted((r["n_shingles"] for r in got)) == sorted(len(shingles(t, k)) for _, t in rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


def test_near_duplicates_of_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute_components([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], 4)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, shingle=4).collect()} == want
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_sketch_estimates():
    pick = np.random.default_rng(0)
    for common, extra in ((800, 100), (400, 300), (0, 500), (4, 1)):
        sets = pick.integers(0, 2**64, common + 2 * extra, dtype=np.uint64)
        a, b = np.unique(sets[: common + extra]), np.unique(np.concatenate([sets[:common], sets[common + extra :]]))
        got = neardup.estimate(neardup.sketch(a)[None], neardup.sketch(b)[None], np.array([len(a)]), np.array([len(b)]))[0, 0]
        assert abs(got - common / (common + 2 * extra)) < 0.2


def brute_removal(rows, width):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                keep[k : k + width] = [False] * width
        kept = " ".join(x for x, y in zip(w, keep) if y)
        out.append((i, len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages():
    pick = random.Random(9)
    word = lambda: "".join(pick.choice("abcdeé") for _ in range(3))
    common = [[word() for _ in range(n)] for n in (12, 30, 60, 200)]
    rows = []
    for i in range(120):
        parts = [[word() for _ in range(pick.randrange(0, 30))]]
        for _ in range(pick.randrange(0, 3)):
            parts += [common[pick.randrange(4)], [word() for _ in range(pick.randrange(0, 30))]]
        rows.append((pick.randrange(10**6), pick.choice([" ", "\n", " \t "]).join(w for p in parts for w in p)))
    again = " ".join(["x"] * 300)
    return rows + [(-1, again), (0, again), (0, again), (7, again + " y"), (7, again), (None, again), (None, None), (5, None), (6, ""), (8, " ".join(common[3])), (8, " ".join(common[3])), (9, "w " * 20000)]


@pytest.mark.parametrize("width,inner,most", [(10, 3, 4), (10, 10, 1000), (50, 12, 8)])
def test_repeats_match_brute_force(spark, width, inner, most):
    from convlens.llm import substrings

    rows = passages()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, kept string, n_words int")
    got = substrings.remove_repeats(docs, width=width, inner=inner, most_in_bucket=most)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()), key=str) == brute_removal(rows, width)


def test_repeats_of_all_documents(spark):
    from convlens.llm import substrings

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == brute_removal(rows, 50)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op3_near_duplicates", "op4_repeated_passages"])
def test_queries_match_sql(spark, name):
    import duckdb

    from convlens.llm import queries
    from convlens.llm.oracle import SQL

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    own = queries.QUERIES[name](spark, DATA)
    want = con.execute(f"select {', '.join(own.columns)} from ({SQL[name]})").fetchall()
    assert sorted(map(tuple, own.collect())) == sorted(want) and want


def test_forests_join_rows_at_once():
    """Alike copies are millions of near pairs; they are not gone through one by one."""
    rng = np.random.default_rng(4)
    for share in (0.002, 0.02, 0.3):
        a, b = rng.integers(0, 90, 50), rng.integers(0, 90, 40)
        near = rng.random((50, 40)) < share
        groups = [{x} for x in {*a.tolist(), *b.tolist()}]
        for i, j in zip(*np.nonzero(near)):
            met = [g for g in groups if a[i] in g or b[j] in g]
            groups = [g for g in groups if g not in met] + [set().union(*met)]
        assert sorted(neardup.forest(near, a, b)) == sorted((x, min(g)) for g in groups for x in g if x != min(g))
    ids = np.arange(2048)
    began = time.process_time()
    assert neardup.forest(np.ones((2048, 2048), bool), ids, ids) == [(i, 0) for i in range(1, 2048)]
    assert time.process_time() - began < 3
