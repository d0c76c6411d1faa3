"""Quality, decontamination and the pipeline: held-out accuracy and brute force over whole small tables."""

import hashlib
import math
import re

import numpy as np
import pytest
from test_duplicates import brute_components
from test_native import base_secrets

from convlens.llm import decontaminate, quality, queries
from convlens.llm.words import word_hashes

DATA = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_on_held_out_documents(spark):
    path = "/root/testdata/sf0.1"
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "quality").collect()}
    got = queries.op6_quality(spark, path).collect()
    assert len(got) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_quality_of_odd_inputs(spark):
    schema = "doc_id long, text string, label double, score string"
    rows = [(i, "good words follow in a line " * (1 + i % 3) if i % 2 else "!!! %%% ### !!! " * (1 + i % 5), None, "x") for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, None, 1.0, None), (7, "", 1.0, None), (7, "", 1.0, None), (900, "x" * 300_000, 0.0, "")], schema)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == 204
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] not in (None, 7, 900))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    assert {r["score"] for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def brute_leaks(docs, items, threshold=0.6, overlap=0.8, shingle=5):
    tests = [(i, WORD.findall(lower(t)), t) for i, t in items if t and len(WORD.findall(t)) >= shingle]
    if not tests:
        return {}
    average = sum(len(w) for _, w, _ in tests) / len(tests)
    reach = max(64, max(len(w) for _, w, _ in tests))
    df = {}
    for _, w, _ in tests:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    impacts = []
    for _, w, _ in tests:
        own = {t: math.log(1 + (len(tests) - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / average)) for t in set(w)}
        impacts.append({t: x / sum(own.values()) for t, x in own.items()})
    out = {}
    for d, text in docs:
        words = WORD.findall(lower(text or ""))
        for lo in range(-reach, len(words), reach):
            passage = words[max(0, lo) : lo + 2 * reach]
            terms = set(passage)
            for (i, w, raw), own in zip(tests, impacts):
                score = sum(x for t, x in own.items() if t in terms)
                if score < threshold - 1e-9:
                    continue
                ends = [k + 1 for k, x in enumerate(WORD.findall(raw)[:-1]) if x[-1] in ".?!:"]
                cut = ends[-1] if ends and shingle <= ends[-1] <= len(w) - 2 else len(w) - max(1, len(w) // 4)
                shares = []
                for part in (w[:cut], w[cut:]):
                    n = min(shingle, len(part))
                    mine, there = {tuple(part[k : k + n]) for k in range(len(part) - n + 1)}, {tuple(passage[k : k + n]) for k in range(len(passage) - n + 1)}
                    shares.append(len(mine & there) / len(mine))
                if min(shares) >= overlap:
                    out[d, i] = max(out.get((d, i), ()), (round(score, 9), *shares))
    return out


def leaks(df):
    out = {}
    for r in df.collect():  # of rows that share an id, the best
        out[r["doc_id"], r["item_id"]] = max(out.get((r["doc_id"], r["item_id"]), ()), (round(r["score"], 9), r["question_overlap"], r["answer_overlap"]))
    return out


def test_decontamination_matches_brute_force(spark):
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_leaks([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert want and leaks(queries.op8_decontaminate(spark, DATA)) == want


@pytest.mark.parametrize("threshold,overlap", [(0.3, 0.0), (0.6, 0.5)])
def test_decontamination_of_odd_inputs(spark, threshold, overlap):
    items = [(1, "What is the long river of the north country? It is the Tana river there."), (2, "one two three"), (3, None), (4, "same words again and again in a row without stops"), (None, "an item without id but with words. And an answer too."), (1, "Another text under one id. Short answer here.")]
    docs = [(i, f"{'pad words here ' * i} what is the long river of the north country? it is the tana river THERE. {'more ' * i}") for i in range(60)]
    docs += [(100, "same words again and again in a row without stops"), (None, "an item without id but with words. And an answer too."), (101, None), (102, ""), (103, "w " * 30000), (104, "what is the long river of the south?"), (104, "another text under one id. short answer here."), (105, "one two three")]
    docs_df = spark.createDataFrame([(*r, "x", 1.0) for r in docs], "doc_id long, text string, item_id string, score double")
    items_df = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    for block_bytes in (1 << 24, 60):
        got = leaks(decontaminate.contaminated(docs_df, items_df, threshold=threshold, overlap=overlap, block_bytes=block_bytes))
        own = brute_leaks(docs, items, threshold, overlap)
        assert own == got
        clean = decontaminate.without_leaks(docs_df, items_df, threshold=threshold, overlap=overlap, block_bytes=block_bytes)
        left = sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str)
        assert clean.columns == docs_df.columns and left == sorted((d for d in docs if not brute_leaks([d], items, threshold, overlap)), key=str)
    assert decontaminate.contaminated(docs_df.limit(0), items_df).count() == 0
    assert decontaminate.contaminated(docs_df, items_df.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs_df.limit(0), items_df).count() == 0
    assert decontaminate.without_leaks(docs_df, items_df.limit(0)).count() == len(docs)


def test_decontamination_does_not_depend_on_blocks_of_items(spark):
    """Items that share an id, rows that share one, and repeated rows: the same rows from one block, two and many."""
    items = [(1, f"which answer number {i} belongs to the question of the seven hills? it is hill number {i} of course.") for i in range(6)]
    items += [(None, "an item without id but with words. And an answer too."), (None, "another item without id but with words. And its answer too.")]
    docs = [(7, " ".join(t for _, t in items)), (7, items[3][1]), (7, items[3][1]), (8, items[0][1] + " and more"), (None, items[1][1]), (9, "nothing of it at all"), (10, None)]
    docs_df, items_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(t) for _, t in items)
    found = [
        sorted((tuple(r) for r in decontaminate.contaminated(docs_df, items_df, threshold=0.5, overlap=0.5, block_bytes=b).collect()), key=str) for b in (1 << 24, size // 2 + 1, 40)
    ]
    assert found[0] == found[1] == found[2]
    ids = [r[:2] for r in found[0]]
    assert len(ids) == 5 and set(ids) == {(7, 1), (7, None), (8, 1), (None, 1)}  # the row with all items, and of the two equal rows one


def test_word_vectors_and_features_match_plain_python(spark):
    """Random indexing and pooling by loops over tokens, and the temperature by its own grid."""
    texts = ["One fine day, one FINE day 42!!", "", None, "a b a b a", "ünd so weiter; und so", "x" * 50 + "\n\nend."] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kind = lambda b: 3 if b in b" \t\n\v\f\r" else 1 if 48 <= b <= 57 else 0 if b >= 128 or chr(b).isalpha() else 2

    def cut(text):
        raw, out = (text or "").encode(), []
        for i, b in enumerate(raw):
            if i and kind(raw[i - 1]) == kind(b):
                out[-1] += bytes([b])
            else:
                out.append(bytes([b]))
        return [t for t in out if kind(t[0]) != 3]

    def bucket(token):
        low = np.frombuffer(bytes(b + 32 if 65 <= b <= 90 else b for b in token), np.uint8)
        return int(word_hashes(low, np.array([0]), np.array([len(low)]))[0] % np.uint64(quality.BUCKETS))

    sums = np.zeros((quality.BUCKETS, quality.DIMS))
    for t in texts:
        own = [bucket(x) for x in cut(t)]
        for i, a in enumerate(own):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(own):
                    for place, sign in zip(quality._PLACES[own[j]], quality._SIGNS):
                        sums[a, place] += sign
    want = np.sign(sums) * np.log1p(np.abs(sums))
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    got = quality.word_vectors(docs)
    assert np.allclose(got, want, atol=1e-6)
    joined = "".join(t or "" for t in texts).encode()
    off = np.cumsum([0] + [len((t or "").encode()) for t in texts])
    pooled = quality.features(np.frombuffer(joined, np.uint8), off, got)
    for row, t in zip(pooled, texts):
        tokens = cut(t)
        if not tokens:
            assert not row.any()
            continue
        assert np.allclose(row[: quality.DIMS], np.mean([want[bucket(x)] for x in tokens], axis=0), atol=1e-5)
        assert np.isclose(row[-2], np.log1p(len(tokens))) and np.isclose(row[-4], np.mean([np.log1p(len(x)) for x in tokens]), atol=1e-5)

    pick = np.random.default_rng(1)
    x = pick.normal(size=(2000, 5))
    y = (x[:, 0] + pick.normal(size=2000) > 0).astype(float)
    net = quality.Network(x, y)
    order = np.random.default_rng(11).permutation(2000)[:400]
    loss = lambda t: -np.mean(np.log(np.where(y[order] == 1, 1, 0) * (p := 1 / (1 + np.exp(-net._logits(x[order]) / t))) + np.where(y[order] == 0, 1, 0) * (1 - p)))
    assert all(loss(net.temperature) <= loss(t) + 1e-9 for t in np.geomspace(0.25, 8, 61))


def test_one_document_of_a_labelled_id_trains(spark):
    docs = spark.createDataFrame([(i % 50, ("good words here " if i % 2 else "!!! %%% ") * (1 + i % 7)) for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == 2000 and all(r["predicted"] == r["doc_id"] % 2 for r in got)


def test_pipeline_stages_match_plain_python(spark):
    import corpus_pipeline as pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = pipeline.STAGES[0][1](spark, docs, SMALL)
    predicted = {r["doc_id"] for r in queries.op6_quality(spark, SMALL).collect() if r["predicted"]}
    rows = {r["doc_id"]: r["text"] for r in good.collect()}
    assert set(rows) == predicted and good.columns == docs.columns
    single = pipeline.STAGES[1][1](spark, good, SMALL)
    kept = {i for i, c in brute_components(list(rows.items()), 5).items() if i == c}
    assert {r["doc_id"] for r in single.collect()} == kept and single.columns == docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    leaked = {d for d, _ in brute_leaks([(i, rows[i]) for i in kept], items)}
    clean = pipeline.STAGES[2][1](spark, single, SMALL)
    assert {r["doc_id"] for r in clean.collect()} == kept - leaked and clean.columns == docs.columns
    redacted = {r["doc_id"]: r["text"] for r in pipeline.STAGES[3][1](spark, clean, SMALL).collect()}
    for i in kept - leaked:
        spans = sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in base_secrets(rows[i]).split(",") if s)
        assert (redacted[i] == rows[i]) == (not spans)
        assert not any(rows[i][a:b] in redacted[i] for a, b in spans)
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = {r["doc_id"]: r["ids_sha256"] for r in pipeline.run(spark, SMALL).collect()}
    assert out == {i: hashlib.sha256(",".join(map(str, own.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for i, t in redacted.items()}


def test_pipeline_writes_the_ids_and_text_of_each_document(spark):
    import corpus_pipeline as pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(1, "Two words, één naïve\n\nline."), (2, ""), (None, "token " * 300)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pipeline.STAGES[-1][1](spark, docs, SMALL).collect()}
    for i, t in docs.collect():
        assert list(out[i]["ids"]) == own.encode(t, add_special_tokens=False).ids and out[i]["decoded"] == t
        assert out[i]["n_tokens"] == len(out[i]["ids"])
