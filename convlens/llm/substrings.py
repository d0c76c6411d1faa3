"""Removal of repeated passages, by partitioning windows of words as super-k-mers.

A window is ``width`` consecutive words. Its minimiser is the smallest hash of the ``inner``-word grams within it; windows in a row
with one minimiser are a super-k-mer and travel together, as one packed string, to the minimiser's bucket. Equal windows
have equal minimisers, so they meet there, and sorting the windows of a bucket finds for each the smallest doc_id.

1. Minimisers with the smallest and largest doc_id that has them: only those of more than one document go on.
2. Super-k-mers of those alone are packed and sent. A minimiser in many documents is salted: its bucket is cut by document,
   each cut reports its distinct windows with their smallest doc_id, and a second round compares the cuts.
3. Words covered by windows that also start in a smaller doc_id are struck from their document.

Windows are judged on the input. They count as equal if two 64-bit hashes of their words are.

Defined results: words are cut at ASCII white space, unchanged. Null text has no words; a text with fewer words than a
window keeps all. Rows whose doc_id is null keep all words and strike none. Rows that share a doc_id are one document:
they strike nothing from each other. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.llm.shared import attach, stored
from convlens.llm.words import as_long, blocks, grams, mix, text_buffers, word_hashes, word_spans

SECOND = np.uint64(0xD6E8FEB86659FD93)


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n values in a row."""
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :])


def super_kmers(first: np.ndarray, hashes: np.ndarray, width: int, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word of the first window, first word of the last window, minimiser) of every run of windows."""
    n = len(hashes) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    least = sliding_least(grams(hashes, inner), width - inner + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    valid = np.arange(n) + width <= first[text + 1]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    begin = np.flatnonzero(new & valid)
    stop = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]]))
    return text[begin], begin, stop, least[begin]


def _minimisers(docs: DataFrame, width: int, inner: int) -> DataFrame:
    """(doc_id, minimiser), each once for a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _, raw, off in blocks(batch.column(1)):
                starts, ends, first = word_spans(raw, off)
                text, _, _, least = super_kmers(first, word_hashes(raw, starts, ends), width, inner)
                seen = np.unique(np.stack([text.astype(np.uint64), least]), axis=1) if len(text) else np.zeros((2, 0), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + seen[0].astype(np.int64)]), pa.array(as_long(np.ascontiguousarray(seen[1])))], names=["doc_id", "minimiser"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, minimiser long")


def _packed(docs: DataFrame, width: int, inner: int) -> DataFrame:
    """Super-k-mers of the texts' shared minimisers. docs: doc_id, row_key, text, shared array<struct<minimiser,cuts>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            wanted = batch.column(3)
            for lo, _, raw, off in blocks(batch.column(2)):
                starts, ends, first = word_spans(raw, off)
                text, begin, stop, least = super_kmers(first, word_hashes(raw, starts, ends), width, inner)
                cuts = np.zeros(len(text), np.int32)  # 0: not shared
                for t in np.unique(text):
                    a, b = np.searchsorted(text, [t, t + 1])
                    own = wanted[lo + int(t)].values
                    names, its_cuts = own.field("minimiser").to_numpy(), own.field("cuts").to_numpy()
                    order = np.argsort(names)
                    at = order[np.minimum(np.searchsorted(names[order], as_long(least[a:b])), len(names) - 1)]
                    cuts[a:b] = np.where(names[at] == as_long(least[a:b]), its_cuts[at], 0)
                ok = cuts > 0
                text, begin, stop, least, cuts = text[ok], begin[ok], stop[ok], least[ok], cuts[ok]
                data = raw.tobytes()
                packed = [data[a:b] for a, b in zip(starts[begin], ends[stop + width - 1])]
                at = lo + text
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(least)), pa.array(cuts), pa.array(ids[at]), pa.array(keys[at]), pa.array((begin - first[text]).astype(np.int32)), pa.array(packed, pa.binary())],
                    names=["minimiser", "cuts", "doc_id", "row_key", "begin", "packed"],
                )

    return docs.select("doc_id", "row_key", "text", "shared").mapInArrow(run, "minimiser long, cuts int, doc_id long, row_key long, begin int, packed binary")


FOUND = "doc_id long, row_key long, begin int, length int, w1 long, w2 long"


def _judged(sent: DataFrame, width: int) -> DataFrame:
    """For each bucket (minimiser, salt): stretches of words to strike (w1 and w2 null), and from salted buckets the distinct
    windows with all their places in the smallest doc_id (length null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judge(bucket: np.ndarray, salted: np.ndarray, doc: np.ndarray, key: np.ndarray, begin: np.ndarray, packed: pa.Array) -> Iterator[pa.RecordBatch]:
            raw, off = text_buffers(packed)
            starts, ends, first = word_spans(raw, off)
            hashes = word_hashes(raw, starts, ends)
            count = np.diff(first) - width + 1  # windows of each super-k-mer
            row = np.repeat(np.arange(len(count)), count)
            step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = first[row] + step
            w1, w2 = grams(hashes, width)[at], grams(mix(hashes + SECOND), width)[at]
            own, where = doc[row], begin[row] + step
            order = np.lexsort((own, w2, w1, bucket[row]))
            b, s1, s2, d = bucket[row][order], w1[order], w2[order], own[order]
            new = np.concatenate([[True], (b[1:] != b[:-1]) | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])
            least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
            repeat = np.zeros(len(row), bool)
            repeat[order] = d > least
            # Windows to strike, in a row, become one stretch.
            hit = np.flatnonzero(repeat)
            if len(hit):
                cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(row[hit]) != 0)) + 1
                a, z = hit[np.concatenate([[0], cut])], hit[np.concatenate([cut - 1, [len(hit) - 1]])]
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[a]), pa.array(key[row[a]]), pa.array(where[a].astype(np.int32)), pa.array((where[z] - where[a] + width).astype(np.int32)), none, none],
                    names=["doc_id", "row_key", "begin", "length", "w1", "w2"],
                )
            left = np.flatnonzero(~repeat & salted[row])
            for lo in range(0, len(left), 100_000):
                i = left[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[i]), pa.array(key[row[i]]), pa.array(where[i].astype(np.int32)), pa.nulls(len(i), pa.int32()), pa.array(as_long(w1[i])), pa.array(as_long(w2[i]))],
                    names=["doc_id", "row_key", "begin", "length", "w1", "w2"],
                )

        def pieces() -> Iterator[list]:
            """Whole buckets, some MB at a time."""
            held = None
            for batch in batches:
                for lo in range(0, batch.num_rows, 2000):
                    part = batch.slice(lo, 2000)
                    ids = np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("minimiser", "salt")], axis=1)
                    now = [ids, part.column("cuts").to_numpy() > 1, *[part.column(c).to_numpy() for c in ("doc_id", "row_key", "begin")]]
                    text = part.column("packed")
                    if held is not None:
                        now = [np.concatenate(x) for x in zip(held[:-1], now)]
                        text = pa.concat_arrays([held[-1], text])
                    cut = np.flatnonzero((now[0][1:] != now[0][:-1]).any(1)) + 1
                    end = int(cut[-1]) if len(cut) else 0
                    if end:
                        yield [x[:end] for x in now] + [text.slice(0, end)]
                    held = [x[end:] for x in now] + [text.slice(end)]
            if held is not None and len(held[0]):
                yield held

        for ids, salted, doc, key, begin, packed in pieces():
            bucket = np.concatenate([[0], np.cumsum((ids[1:] != ids[:-1]).any(1))])
            yield from judge(bucket, salted, doc, key, begin, packed)

    laid = sent.select("minimiser", "salt", "cuts", "doc_id", "row_key", "begin", "packed")
    return laid.repartition("minimiser", "salt").sortWithinPartitions("minimiser", "salt").mapInArrow(run, FOUND)


def _struck(rows: DataFrame, stretches: DataFrame) -> DataFrame:
    """rows with n_words, n_removed, kept (the words left, joined by one space)."""
    gathered = stretches.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("begin", "length")).alias("strikes"))
    joined = attach(rows, gathered, "doc_id", "row_key").select("doc_id", "text", "strikes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                n, gone, kept = [], [], []
                for text, strikes in zip(part.column(1), part.column(2)):
                    words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                    n.append(len(words))
                    if strikes.is_valid:
                        edge = np.zeros(len(words) + 1, np.int64)
                        begin, length = (strikes.values.field(k).to_numpy() for k in ("begin", "length"))
                        np.add.at(edge, begin, 1)
                        np.add.at(edge, begin + length, -1)
                        stay = np.cumsum(edge)[:-1] == 0
                        words = [w for w, s in zip(words, stay) if s]
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 50, inner: int = 12, most_in_bucket: int = 512
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("row_key", F.xxhash64("text"))
    seen = stored(_minimisers(rows, width, inner), "minimisers")
    shared = seen.groupBy("minimiser").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("members")).where("low < high")
    shared = shared.select("minimiser", F.ceil(F.col("members") / most_in_bucket).cast("int").alias("cuts"))
    wanted = seen.join(shared, "minimiser").groupBy("doc_id").agg(F.collect_set(F.struct("minimiser", "cuts")).alias("shared"))
    sent = _packed(rows.join(wanted, "doc_id"), width, inner).withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_key"), F.col("cuts")).cast("int"))
    found = stored(_judged(sent, width), "found")
    # Windows of salted buckets: the cuts' smallest doc_ids against each other.
    places = found.where("length is null")
    least = places.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"))
    late = places.join(least, ["w1", "w2"]).where("doc_id > least").select("doc_id", "row_key", "begin", F.lit(width).alias("length"))
    stretches = found.where("length is not null").select("doc_id", "row_key", "begin", "length").union(late)
    return _struck(rows, stretches)
