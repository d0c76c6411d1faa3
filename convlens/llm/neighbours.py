"""Nearest neighbours by inner product, from a forest of random-projection trees.

The forest is fitted on a bounded sample (``sample_rows``), whose size is documented by the parameter; every vector is indexed. A
tree splits the sample of a node at the median along the difference of two of its points. Vectors get one more component,
sqrt(longest^2 - length^2), so that the largest inner product becomes the smallest angle. One priority queue for all trees
orders a query's nodes by how far it lies from them: the root of the summed squares of the margins of the planes crossed.

How far a search goes is measured, not set: of the sample's own near pairs, the distance within which ``target`` of the
neighbours lie in some tree. Leaves are bounded by ``leaf_rows``: where the sample is too small to split a large table so far,
the vectors of a leaf are split on by a tree of their own in the task that scores them, down to that bound. So the inner products of a
query follow the structure of the data: few where vectors have clusters or few directions, and a constant share of the table where they
fill all directions alike. ``search_share`` makes searches longer: leaves are taken at least until they hold so many times
as many vectors as there are.

Their vectors are scored in blocks of queries against vectors of a leaf's shelf (neighbouring leaves of a tree). A product of
matrices finds what may be among the best ``k + 1`` of a block within its rounding; of these, the best by the exact measure and then by
smallest id leave the block, so ties between different vectors are decided too. Copies of a vector are one candidate that
carries its ``k + 1`` smallest ids. Shelves and their queries are cut into blocks of bounded size, so a shelf that holds a third of
all rows is many tasks.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor do those whose length
differs from the commonest one, nor rows whose id is null. Repeated rows count once; a query is never its own neighbour.
With fewer candidates than ``k`` all are returned. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlens.llm.shared import stored


def _split(points: np.ndarray, pick: np.random.Generator) -> tuple[np.ndarray, float]:
    """A plane that halves points: along the difference of two of them, at the median."""
    normal = np.subtract(*points[pick.choice(len(points), 2, replace=False)]) if len(points) > 1 else np.zeros(points.shape[1])
    if not normal.any():
        normal = pick.normal(size=points.shape[1])
    normal /= np.linalg.norm(normal)
    return normal, float(np.median(points @ normal)) if len(points) else 0.0


class Forest:
    """Complete trees of one depth: node 1 is the root, 2n and 2n + 1 are below n, leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, total: float, longest: float, k: int, trees: int, leaf_rows: int, target: float, depth: int | None = None, seed: int = 7, asked: int = 400):
        wanted = max(1, math.ceil(math.log2(max(2, total / leaf_rows))))
        # Some of the sample must be on both sides of each plane.
        self.depth = min(wanted, max(1, int(math.log2(max(2, len(sample) / 16))))) if depth is None else depth
        self.longest = longest
        points = self.lifted(sample)
        self.normals = np.zeros((trees, 1 << self.depth, points.shape[1]))
        self.cuts = np.zeros((trees, 1 << self.depth))
        for t in range(trees):
            pick = np.random.default_rng([seed, t])
            members = {1: np.arange(len(points))}
            for n in range(1, 1 << self.depth):
                mine = members.pop(n)
                self.normals[t, n], self.cuts[t, n] = _split(points[mine], pick)
                right = points[mine] @ self.normals[t, n] > self.cuts[t, n]
                members[2 * n], members[2 * n + 1] = mine[~right], mine[right]
        self._measure(sample, total, k, target, asked)

    def _measure(self, sample: np.ndarray, total: float, k: int, target: float, asked: int) -> None:
        """``reach``: the squared distance within which ``target`` of near pairs lie, for as many trees as take the fewest inner products."""
        asked = min(asked, len(sample))
        # The k-th of the table is about this one of the sample.
        near = min(len(sample) - 1, max(1, math.ceil(k * len(sample) / max(total, 1))))
        self.reach = math.inf
        if near < 1:
            return
        found = np.empty((asked, near), np.int64)
        for lo in range(0, asked, 50):
            scores = -(sample[lo : min(lo + 50, asked)] @ sample.T)
            scores[np.arange(len(scores)), lo + np.arange(len(scores))] = np.inf
            found[lo : lo + len(scores)] = np.argpartition(scores, near - 1, axis=1)[:, :near]
        leaves, queries = self.leaves(sample), self.directed(sample[:asked])
        nearest, best, far = np.full(found.shape, np.inf), math.inf, []
        for t in range(len(self.normals)):
            far.append(self.distances(queries, t))
            nearest = np.minimum(nearest, np.take_along_axis(far[t], leaves[:, t][found], axis=1))
            reach = float(np.quantile(nearest, target))
            cost = sum(np.take(np.bincount(leaves[:, u], minlength=1 << self.depth), np.nonzero(far[u] <= reach)[1]).sum() for u in range(t + 1))
            if cost < best:
                best, self.reach, count = cost, reach, t + 1
        self.normals, self.cuts = self.normals[:count], self.cuts[:count]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x**2).sum(axis=1), 0.0))
        return np.concatenate([x, rest[:, None]], axis=1) / self.longest

    @staticmethod
    def directed(queries: np.ndarray) -> np.ndarray:
        """Queries among lifted points: only their direction counts."""
        return np.concatenate([queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros((len(queries), 1))], axis=1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """[rows, trees] leaf numbers."""
        points = self.lifted(x)
        out = np.empty((len(x), len(self.normals)), np.int64)
        for t in range(len(self.normals)):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (np.einsum("ij,ij->i", points, self.normals[t, node]) > self.cuts[t, node])
            out[:, t] = node - (1 << self.depth)
        return out

    def distances(self, queries: np.ndarray, t: int) -> np.ndarray:
        """[queries, leaves] squared distances from a tree's leaves."""
        margins = queries @ self.normals[t].T - self.cuts[t]
        far = np.zeros((len(queries), 1))
        for level in range(self.depth):
            m = margins[:, 1 << level : 2 << level]
            far = np.stack([far + np.maximum(m, 0) ** 2, far + np.maximum(-m, 0) ** 2], axis=2).reshape(len(queries), -1)
        return far

    def search(self, query: np.ndarray, sizes: np.ndarray, least: float) -> list[tuple[int, int, float]]:
        """(tree, leaf, squared distance), the nearest first: all within reach, and more until they hold ``least`` vectors. sizes: [trees, leaves]."""
        margins = self.normals @ self.directed(query[None])[0] - self.cuts
        queue = [(0.0, t, 1) for t in range(len(margins))]
        found, got, first_leaf = [], 0, 1 << self.depth
        while queue and (queue[0][0] <= self.reach or got < least):
            far, t, n = heapq.heappop(queue)
            if n >= first_leaf:
                if sizes[t, n - first_leaf]:
                    found.append((t, n - first_leaf, far))
                    got += sizes[t, n - first_leaf]
                continue
            m = margins[t, n]
            heapq.heappush(queue, (far + max(-m, 0.0) ** 2, t, 2 * n + 1))
            heapq.heappush(queue, (far + max(m, 0.0) ** 2, t, 2 * n))
        return found


def within(points: np.ndarray, queries: np.ndarray, whole: np.ndarray, total: float, longest: float, k: int, leaf_rows: int, target: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(points, queries) that meet: points of one leaf split on by a tree of their own; ``whole`` queries meet them all. total: rows of the whole leaf."""
    depth = math.ceil(math.log2(len(points) / leaf_rows))
    tree = Forest(points, total, longest, k, 1, leaf_rows, (1 + target) / 2, depth, asked=128)  # its losses come on top
    near = (tree.distances(tree.directed(queries), 0) <= tree.reach) | whole[:, None]
    leaves = tree.leaves(points)[:, 0]
    for leaf in range(1 << depth):
        yield np.flatnonzero(leaves == leaf), np.flatnonzero(near[:, leaf])


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()).astype(np.float64)


def best_of_block(query_keys: np.ndarray, asked: np.ndarray, keys: np.ndarray, classes: np.ndarray, vectors: np.ndarray, got: np.ndarray, most: int, pairs: int = 1 << 16) -> pd.DataFrame:
    """query_key, key, class, score: for each query the ``most`` best vectors by exact score (summed in order), then class.

    ``got`` has the rough inner products, and -inf where a query doesn't meet a vector.
    """
    size, n = asked.shape[1], got.shape[1]
    least = np.partition(got, n - min(most, n), axis=1)[:, n - min(most, n)]
    # Twice the error of either sum, for the candidate and for the last of the best.
    slack = 4 * size * np.finfo(np.float64).eps * np.linalg.norm(asked, axis=1) * np.linalg.norm(vectors, axis=1).max()
    q, v = np.nonzero((got >= (least - slack)[:, None]) & (got > -np.inf))
    exact = np.empty(len(q))
    for lo in range(0, len(q), pairs):
        exact[lo : lo + pairs] = np.cumsum(asked[q[lo : lo + pairs]] * vectors[v[lo : lo + pairs]], axis=1)[:, -1] + 0.0
    order = np.lexsort((keys[v], classes[v], -exact, q))
    place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
    order = order[place < most]
    return pd.DataFrame({"query_key": query_keys[q[order]], "key": keys[v[order]], "class": classes[v[order]], "score": exact[order]})


def _first_of(rows: DataFrame, k: int, by: list[str], order) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", trees: int = 4,
    depth: int | None = None, leaf_rows: int = 256, target: float = 0.95, search_share: float = 0.0, sample_rows: int = 20_000, block_rows: int = 4096,
    block_queries: int = 1024,
) -> DataFrame:
    """query_id, rank, vec_id, score: for every id divisible by ``every``, its ``k`` nearest other rows."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = given.where(finite & F.exists("embedding", lambda x: x != 0))
    lengths = some.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    some = stored(some.where(F.size("embedding") == lengths["size"]).distinct(), "vectors")
    # Copies: first within salts, so that no task meets all ids of a common vector.
    salted = _first_of(some.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))), k + 1, ["embedding", "salt"], ["vec_id"])
    ids = salted.groupBy("embedding").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    copies = stored(ids.withColumn("class", F.element_at("ids", 1)).withColumn("key", F.xxhash64("embedding", "class")), "copies")
    queries = some.where(F.col("vec_id") % every == 0)

    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    total, longest = map(float, copies.agg(F.count("*"), F.max(norm)).first())
    sample = copies.orderBy(F.xxhash64("key"), "class").limit(sample_rows).select("embedding").toArrow()
    fitted = sample["embedding"].combine_chunks().flatten().to_numpy().reshape(sample.num_rows, -1)
    own = Forest(fitted, total, longest, k, trees, leaf_rows, target, depth)
    reach, deep, trees = own.reach, own.depth, len(own.normals)
    forest = spark.sparkContext.broadcast(own)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = forest.value.leaves(_matrix(batch.column(1)))
                n = leaves.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(leaves))), pa.array(leaves.reshape(-1).astype(np.int32))],
                    names=["key", "tree", "leaf"],
                )

    indexed = stored(copies.select("key", "embedding").mapInArrow(index, "key long, tree int, leaf int"), "index")
    sizes = np.zeros((trees, 1 << deep), np.int64)
    for r in indexed.groupBy("tree", "leaf").count().collect():  # trees x leaves rows, bounded by the sample
        sizes[r["tree"], r["leaf"]] = r["count"]
    # A shelf is neighbouring leaves of a tree that hold about a block of vectors.
    shelf_leaves = 1 << max(0, min(deep, int(math.log2(max(1.0, block_rows * (1 << deep) / total)))))
    # At least some leaves, and so many that k + 1 of their vectors must differ, as each is once in a tree.
    enough, asked_for = max(trees * (k + 1), 4 * leaf_rows), search_share * total

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for query, vector in zip(batch.column(0).to_pylist(), _matrix(batch.column(1)) if batch.num_rows else []):
                found = forest.value.search(vector, sizes, max(enough, asked_for))
                held = sum(int(sizes[t, leaf]) for t, leaf, far in found if far <= reach)
                whole = held < max(enough, asked_for)  # no part of a leaf is left out where reach alone gives too few
                shelves: dict[tuple[int, int], list[int]] = {}
                for t, leaf, _ in found:
                    shelves.setdefault((t, leaf // shelf_leaves), []).append(leaf)
                out += [(query, t, shelf, own, whole) for (t, shelf), own in shelves.items()]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["query_key", "tree", "shelf", "leaves", "whole"])

    asked = stored(queries.select(F.xxhash64("vec_id", "embedding").alias("query_key"), F.col("vec_id").alias("query_id"), "embedding").distinct(), "queries")
    probes = stored(
        asked.repartition("query_key").select("query_key", "embedding").mapInArrow(probe, "query_key long, tree int, shelf int, leaves array<int>, whole boolean"), "probes"
    )
    shelved = indexed.withColumn("shelf", F.floor(F.col("leaf") / shelf_leaves).cast("int"))
    # Blocks of queries against blocks of a shelf's vectors.
    size_table = shelved.groupBy("tree", "shelf").agg(F.ceil(F.count("*") / (2 * block_rows)).cast("int").alias("cuts"))
    asks = probes.groupBy("tree", "shelf").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("ask_cuts"))
    cuts = stored(size_table.join(asks, ["tree", "shelf"]), "cuts")
    place = ["tree", "shelf", "cut", "ask_cut"]
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    to = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    rows = shelved.join(cuts, ["tree", "shelf"]).withColumn("cut", mine("key", "cuts")).withColumn("ask_cut", to("ask_cuts")).join(copies.select("key", "class", "embedding"), "key").select(*place, "cuts", "leaf", "key", "class", "embedding")
    asking = probes.join(cuts, ["tree", "shelf"]).withColumn("ask_cut", mine("query_key", "ask_cuts")).withColumn("cut", to("cuts")).join(asked.select("query_key", "embedding"), "query_key").select(*place, "leaves", "whole", "query_key", "embedding")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_key": [], "key": [], "class": [], "score": []}).astype({"query_key": "int64", "key": "int64", "class": "int64", "score": "float64"})
        right = right.sort_values(["leaf", "key"])
        vectors, queries = _matrix(right["embedding"]), _matrix(left["embedding"])
        whole, cuts = left["whole"].to_numpy(), int(right["cuts"].iat[0])
        # Which queries ask each leaf.
        taken, by = np.concatenate(left["leaves"].to_numpy()), np.repeat(np.arange(len(left)), left["leaves"].str.len())
        order = np.argsort(taken, kind="stable")
        taken, by = taken[order], by[order]
        got = np.full((len(left), len(right)), -np.inf)
        leaf = right["leaf"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(leaf)) + 1), len(leaf)]
        for a, b in zip(edges, edges[1:]):
            asks = by[slice(*np.searchsorted(taken, [leaf[a], leaf[a] + 1]))]
            if not len(asks) or b - a <= 2 * leaf_rows:
                got[asks, a:b] = queries[asks] @ vectors[a:b].T
                continue
            for part, some in within(vectors[a:b], queries[asks], whole[asks], (b - a) * cuts, longest, k, leaf_rows, target):
                got[np.ix_(asks[some], a + part)] = queries[asks[some]] @ vectors[a + part].T
        # The query's own vector may be among the best.
        return best_of_block(left["query_key"].to_numpy(), queries, right["key"].to_numpy(), right["class"].to_numpy(), vectors, got, k + 1)

    scored = asking.groupBy(*place).cogroup(rows.groupBy(*place)).applyInPandas(score, "query_key long, key long, class long, score double")
    unique = scored.groupBy("query_key", "key").agg(F.max("class").alias("class"), F.max("score").alias("score"))
    # k + 1 vectors hold k ids besides the query's, each at least as good as any of the vectors left out.
    kept = _first_of(unique, k + 1, ["query_key"], [F.desc("score"), "class", "key"])
    full = kept.join(asked.select("query_key", "query_id"), "query_key").join(copies.select("key", "ids"), "key")
    each = full.select("query_key", "query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
