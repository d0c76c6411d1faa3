"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with calibrated scores.

1. Random indexing over all documents: a token's bucket (of ``BUCKETS``) gathers the sparse ternary index vectors of its
   neighbours at distance 1 and 2. A task sends its counts of integers by blocks of buckets, which are summed in a tree: first
   within ``FAN`` groups of tasks, then over the groups.
2. A document's input is the mean of its tokens' unit vectors, the mean of its shape words (upper case, repeated, digits,
   each common symbol ...), which have unit index vectors of their own, and the mean and deviation of token lengths.
3. A network of one hidden layer is trained by Adam on at most ``sample_rows`` labelled documents (the documented bound),
   those whose crc32 of the doc_id as text has a remainder other than ``held_out`` modulo ``folds``; of the documents that share
   an id, the one whose text has the smallest hash. Its temperature is fitted on a fifth of that sample left out of training.

Labels, language, source and id are no inputs of a score.

Defined results: null text counts as empty and is scored like any other; a null id stays null and is never a training row;
rows that share an id are scanned each by itself; a document with several labels has their mean; without labels of both
kinds every score is the mean label, or 0.5. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens.llm.words import LOWER, blocks, mix, word_hashes

BUCKETS, DIMS, NONZERO, BLOCK, FAN = 4096, 48, 4, 256, 256
SYMBOLS = b"%&*!$#|.,;:?\"'()[]{}<>=+-/_@\\~^`"
SHAPES = 8 + len(SYMBOLS)  # upper, title, digits, repeat of one, repeat of two before, over 20 letters, line feed, other; symbols
FEATURES = DIMS + SHAPES + 4

LETTER, DIGIT, SYMBOL, SPACE = 0, 1, 2, 3
KIND = np.full(256, SYMBOL, np.uint8)
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
KIND[48:58] = DIGIT
KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = SPACE
SYMBOL_AT = np.full(256, 7, np.int64)
SYMBOL_AT[list(SYMBOLS)] = np.arange(8, SHAPES)

_PLACES = (mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64)) % np.uint64(DIMS)).astype(np.int64).reshape(BUCKETS, NONZERO)
_SIGNS = np.where(np.arange(NONZERO) % 2 == 0, 1, -1)


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of bytes of one kind that is not white space, and each text's first token."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    kind = KIND[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    edge[0] = edge[n] = True
    edge[1:n] |= kind[1:] != kind[:-1]
    places = np.flatnonzero(edge)
    starts, ends = places[:-1], places[1:]
    keep = kind[starts] != SPACE
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, off)


def _hashed(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = tokens(raw, off)
    return starts, ends, first, word_hashes(LOWER[raw], starts, ends)


def index_counts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """[BUCKETS, DIMS] sums of the neighbours' index vectors."""
    _, _, first, hashes = _hashed(raw, off)
    bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.zeros(BUCKETS * DIMS, np.int64)
    for far in (1, 2):
        same = text[far:] == text[:-far]
        left, right = bucket[:-far][same], bucket[far:][same]
        for j in range(NONZERO):
            for here, there in ((left, right), (right, left)):
                out += _SIGNS[j] * np.bincount(here * DIMS + _PLACES[there, j], minlength=BUCKETS * DIMS)
    return out.reshape(BUCKETS, DIMS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors [BUCKETS, DIMS] from the whole of ``docs`` (text)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, DIMS), np.int64)
        for batch in batches:
            for _, _, raw, off in blocks(batch.column(0)):
                total += index_counts(raw, off)
        group = TaskContext.get().partitionId() % FAN
        yield sums_batch({(b, group): total[b * BLOCK : (b + 1) * BLOCK] for b in range(BUCKETS // BLOCK) if total[b * BLOCK : (b + 1) * BLOCK].any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for b, group, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = np.frombuffer(sums.as_buffer(), np.int64)
                totals[b, group] = totals[b, group] + own if (b, group) in totals else own.copy()
        yield sums_batch(totals)

    def sums_batch(totals: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        blocks_, groups = ([k[i] for k in totals] for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(blocks_, pa.int32()), pa.array(groups, pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["block", "group", "sums"])

    schema = "block int, group int, sums binary"
    grouped = docs.select("text").mapInArrow(gather, schema).repartition("block", "group").mapInArrow(add, schema)
    summed = grouped.withColumn("group", F.lit(0)).repartition(BUCKETS // BLOCK, "block").mapInArrow(add, schema)
    out = np.zeros((BUCKETS, DIMS))
    for r in summed.collect():  # BUCKETS x DIMS numbers, whatever the corpus
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["sums"], np.int64).reshape(BLOCK, DIMS)
    out = np.sign(out) * np.log1p(np.abs(out))
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(raw: np.ndarray, off: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """[texts, FEATURES]"""
    starts, ends, first, hashes = _hashed(raw, off)
    n = np.diff(first)
    out = np.zeros((len(n), FEATURES), np.float32)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    at = first[:-1][full]
    means = lambda x: np.add.reduceat(x, at, axis=0) / n[full].reshape(-1, *[1] * (x.ndim - 1))
    for lo in range(0, len(full), 256):  # the vectors of all tokens of a few texts at a time
        some = full[lo : lo + 256]
        a, b = first[some[0]], first[some[-1] + 1]
        pooled = np.add.reduceat(vectors[(hashes[a:b] % np.uint64(BUCKETS)).astype(np.int64)], first[some] - a, axis=0)
        out[some, :DIMS] = pooled / n[some, None]
    head, second = raw[starts], raw[np.minimum(starts + 1, len(raw) - 1)]
    size = ends - starts
    kind = KIND[head]
    big = lambda c: (c >= 65) & (c <= 90)
    before = lambda far: np.concatenate([np.zeros(min(far, len(hashes)), bool), hashes[far:] == hashes[:-far]])
    letters = kind == LETTER
    shape = [letters & big(head) & (size > 1) & big(second), letters & big(head) & ~big(second), kind == DIGIT, before(1), before(2), letters & (size > 20)]
    for i, x in enumerate(shape):
        out[full, DIMS + i] = means(x.astype(np.float32))
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    out[full, DIMS + 6] = (lines[off[1:]] - lines[off[:-1]])[full] / n[full]
    marks = kind == SYMBOL
    text = np.repeat(np.arange(len(n)), n)
    counts = np.bincount(text[marks] * SHAPES + SYMBOL_AT[head[marks]], minlength=len(n) * SHAPES).reshape(len(n), SHAPES)
    out[full, DIMS + 7 : DIMS + SHAPES] = (counts[full, 7:] / n[full, None]).astype(np.float32)
    long = np.log1p(size).astype(np.float32)
    out[full, -4], out[full, -3] = means(long), means(long * long)
    out[full, -2] = np.log1p(n[full])
    out[full, -1] = means((marks & (size > 1)).astype(np.float32))
    return out


class Network:
    """tanh hidden layer, one logit, divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 11):
        pick = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.temperature, self.constant = 1.0, None
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        order = pick.permutation(len(y))
        check, train = order[: len(y) // 5], order[len(y) // 5 :]
        n = x.shape[1]
        self.p = [pick.normal(size=(n, hidden)) / np.sqrt(n), np.zeros(hidden), pick.normal(size=hidden) / np.sqrt(hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p]
        z, step = self._scaled(x), 0
        for epoch in range(epochs):
            pick.shuffle(train)
            for lo in range(0, len(train), 256):
                mine = train[lo : lo + 256]
                h = np.tanh(z[mine] @ self.p[0] + self.p[1])
                d = (_sigmoid(h @ self.p[2] + self.p[3]) - y[mine]) / len(mine)
                back = np.outer(d, self.p[2]) * (1 - h * h)
                grads = [z[mine].T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ d + 1e-4 * self.p[2], d.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.p[i] -= 3e-3 * (1 - epoch / epochs) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if len(check) > 10:
            logit, truth = self._logits(x[check]), y[check]
            loss = lambda t: np.mean(np.logaddexp(0, logit / t) - truth * logit / t)
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._scaled(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.constant) if self.constant is not None else _sigmoid(self._logits(x) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fold(doc_id: Column, folds: int = 4) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def fit(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, sample_rows: int):
    """Broadcast word vectors and network. docs: doc_id, text; labels: doc_id, label."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    known = labels.where("doc_id is not null and label is not null").where(fold(F.col("doc_id"), folds) != held_out)
    sample = known.groupBy("doc_id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in blocks(batch.column(1)):
                own = features(raw, off, vectors.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([f.tobytes() for f in own], pa.binary())], names=["label", "features"])

    # sample_rows labels at most, so they can be sent to every task
    labelled = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    some = labelled.select("label", "text").mapInArrow(learn, "label double, features binary").collect()
    some.sort(key=lambda r: (bytes(r["features"]), r["label"]))
    x = np.frombuffer(b"".join(r["features"] for r in some), np.float32).reshape(-1, FEATURES).astype(np.float64)
    network = Network(x, np.array([r["label"] for r in some])) if some else Network(np.zeros((1, FEATURES)), np.zeros(0))
    return vectors, spark.sparkContext.broadcast(network)


def _scores(column: pa.Array, vectors, network) -> np.ndarray:
    parts = [network.value.scores(features(raw, off, vectors.value).astype(np.float64)) for _, _, raw, off in blocks(column)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", label_id: str = "doc_id",
    folds: int = 4, held_out: int = 2, least: float = 0.7, sample_rows: int = 20_000,
) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= least); one row per row of docs."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
    vectors, network = fit(rows, known, folds, held_out, sample_rows)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(batch.column(1), vectors, network)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(judge, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", label_id: str = "doc_id",
    folds: int = 4, held_out: int = 2, least: float = 0.7, sample_rows: int = 20_000,
) -> DataFrame:
    """The rows of ``docs`` that score_quality would predict to be good, with all their columns and without a join."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
    vectors, network = fit(rows, known, folds, held_out, sample_rows)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), vectors, network) >= least))

    return docs.mapInArrow(keep, docs.schema)
