"""Recall against brute force, over every vector of the small tables, and over odd inputs."""

import numpy as np
import pytest

from convlens.llm import neighbours, queries


def brute(rows, every, k):
    rows = [(i, np.array(v, np.float64)) for i, v in rows]
    out = {}
    for i, v in rows:
        if i % every == 0:
            out[i] = sorted(((-float(v @ w), j) for j, w in rows if j != i))[:k]
    return out


def test_recall_of_the_job_where_leaves_are_left_out(spark):
    """4,000 vectors in 40 groups: most leaves are not searched, blocks are small, and nine tenths of the nearest are found."""
    x = made(4000, 40, size=32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    scores = x[::20] @ x.T
    scores[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    near = {(20 * q, int(j)) for q, best in enumerate(np.argpartition(-scores, 20, axis=1)[:, :20]) for j in best}
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, k=20, block_rows=256, block_queries=64)
    got = {(r["query_id"], r["vec_id"]) for r in found.collect()}
    assert len(got) == 4000 and len(near & got) >= 0.9 * len(near)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_over_whole_table(spark, folder):
    path = f"/root/testdata/{folder}"
    want = brute([(r[0], r[1]) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()], 20, 20)
    got = queries.op2_neighbours(spark, path).collect()
    hits = {(r["query_id"], r["vec_id"]) for r in got}
    assert sum((i, j) in hits for i, near in want.items() for _, j in near) >= 0.9 * sum(map(len, want.values()))
    for i, near in want.items():
        mine = sorted((r["rank"], r["score"], r["vec_id"]) for r in got if r["query_id"] == i)
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [(-m[1], m[2]) for m in mine] == sorted((-m[1], m[2]) for m in mine)


def test_odd_vectors_and_copies(spark):
    pick = np.random.default_rng(3)
    usual = [(i, [float(x) for x in pick.normal(size=4) * (1 + i % 3)]) for i in range(1, 60)]
    copies = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(100, 190)]
    bad = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan")] + [1.0] * 3), (204, [float("inf")] + [1.0] * 3), (205, []), (206, [1.0] * 5), (None, [1.0] * 4)]
    rows = usual + copies + bad
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + usual[:5]], "vec_id long, embedding array<double>, score int, ids string")
    got = neighbours.nearest(df, every=10, k=7, search_share=100.0)
    want = brute(usual + copies, 10, 7)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == {i: [j for _, j in near] for i, near in want.items()}
    few = neighbours.nearest(df.where("vec_id in (10, 11, 12, 200)"), every=10, k=7).collect()
    assert {r["vec_id"] for r in few} == {11, 12}
    assert neighbours.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("block_rows,block_queries", [(4096, 1024), (40, 5)])
def test_ties_between_different_vectors_go_to_smaller_ids(spark, block_rows, block_queries):
    pick = np.random.default_rng(11)
    rows = [(i, [float(x) for x in v]) for i, v in zip(pick.permutation(500).tolist(), pick.integers(-1, 2, size=(500, 6))) if v.any()]
    want = brute(rows, 10, 7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, every=10, k=7, search_share=100.0, depth=2, block_rows=block_rows, block_queries=block_queries)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert found == want


def searched(x, every=20, k=20, **more):
    """Recall of a forest's leaves, and inner products for each query as a share of the vectors."""
    forest = neighbours.Forest(x[np.random.default_rng(5).permutation(len(x))[:20_000]], len(x), float(np.linalg.norm(x, axis=1).max()), k, 4, 256, 0.95, **more)
    leaves = forest.leaves(x)
    sizes = np.stack([np.bincount(leaves[:, t], minlength=1 << forest.depth) for t in range(leaves.shape[1])])
    hits = work = asked = 0
    for i in range(0, len(x), max(every, len(x) // 300)):
        score = x @ x[i]
        score[i] = -np.inf
        near = np.argpartition(-score, k)[:k]
        found = forest.search(x[i], sizes, 1024)
        seen = np.zeros(len(x), bool)
        for t, leaf, _ in found:
            seen |= leaves[:, t] == leaf
            work += sizes[t, leaf]
        hits, asked = hits + seen[near].sum(), asked + 1
    return hits / (asked * k), work / (asked * len(x)), sizes.max()


def made(n, clusters, size=64, spread=0.3, seed=2):
    pick = np.random.default_rng(seed)
    x = pick.normal(size=(clusters, size))[pick.integers(0, clusters, n)] + spread * pick.normal(size=(n, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("folder,most", [("sf0.01", 1.3), ("sf0.1", 1.1), (None, 1.0)])
def test_share_of_vectors_scored_without_structure(folder, most):
    import pyarrow.parquet as pq

    if folder is None:
        x = made(10_000, 1, spread=1.0)
    else:
        x = np.stack(pq.read_table(f"/root/testdata/{folder}/embeddings.parquet")["embedding"].to_numpy()).astype(np.float64)
    recall, share, _ = searched(x)
    assert recall >= 0.9 and share <= most


def test_share_of_vectors_scored_falls_with_structure():
    shares = []
    for n in (10_000, 50_000):
        recall, share, largest = searched(made(n, n // 100))
        assert recall >= 0.9 and largest <= 1024
        shares.append(share * n)
    assert shares[0] < 0.15 * 10_000 and shares[1] < 0.06 * 50_000


def test_large_leaves_are_split_on(spark):
    x = made(3000, 30, size=16)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 20, 10)
    near = {(i, j) for i, found in want.items() for _, j in found}
    got = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(df, every=20, k=10, depth=1, leaf_rows=64).collect()}
    assert len(near & got) >= 0.9 * len(near)
    whole = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(df, every=20, k=10, depth=1, leaf_rows=64, search_share=100.0).collect()}
    assert whole == near

    parts = list(neighbours.within(x, x[:100], np.zeros(100, bool), len(x), 1.0, 10, 64, 0.95))
    assert max(len(p) for p, _ in parts) <= 64
    assert sum(len(p) * len(q) for p, q in parts) < 0.5 * 100 * 3000
