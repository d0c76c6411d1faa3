"""Benchmark decontamination: every passage of every document as a BM25 query against an inverted index of test items.

A passage is ``2 * reach`` words, and passages start every ``reach`` words, ``reach`` being the longest item or 64; so any copy of an
item lies whole in a passage. An item's score for a passage is its BM25 score as a share of what it would have if all its
terms were there, so one threshold serves all items. Block-max WAND retrieves every item at or above it: a passage whose
terms' largest impacts within a block of items reach the threshold in sum for no block is done, which is found for many
passages at once; for the others cursors over posting lists skip to pivots, and past blocks that cannot reach it. What is retrieved is verified: the item's question (all
but its last sentence) and answer (the last sentence) must each share enough of their shingles with the passage.

Items are indexed some hundred at a time; indexes of about ``block_bytes`` of text are broadcast and meet the documents in one
pass. Items are dealt to such blocks by size, whatever their ids; where there are several, the finds of each are written before
the next is sent, so one block is in memory at a time. Statistics are those of all items.

Defined results: words are cut at ASCII white space, A-Z lower-cased. Items with null text or fewer words than a shingle take no
part; null documents have no passages; a null doc_id or item_id stays null. Rows that share an id are scanned each by itself;
rows equal in id and text report once. Items that share an id are indexed each by itself, and a row reports such an id once with
its best, whatever blocks its items were dealt to. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.llm.shared import stored
from convlens.llm.words import LOWER, blocks, grams, word_hashes, word_spans

K1, B, GROUP, ITEMS = 1.2, 0.75, 4, 512
DONE = 1 << 60


def _words(text: str) -> np.ndarray:
    raw = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]))
    return word_hashes(raw, starts, ends)


def _shingled(hashes: np.ndarray, k: int) -> np.ndarray:
    return np.unique(grams(hashes, min(k, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)


def split_item(text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of question and answer: the answer is the last sentence, or the last quarter where that is the whole."""
    words = text.split()
    ends = [i + 1 for i, w in enumerate(words[:-1]) if w[-1] in ".?!:"]
    n = len(_words(text))
    cut = ends[-1] if ends and len(words) == n else 0
    cut = cut if shingle <= cut <= n - 2 else n - max(1, n // 4)
    hashes = _words(text)
    return hashes[:cut], hashes[cut:]


class Index:
    """Posting lists with impacts that are shares of an item's own score, and their largest values by GROUP items."""

    def __init__(self, items: list[tuple[int, str]], count: int, average: float, frequency: dict[int, int], threshold: float, shingle: int):
        self.threshold, self.ids, self.parts = threshold, [i for i, _ in items], []
        lists: dict[int, list[tuple[int, float]]] = {}
        for at, (_, text) in enumerate(items):
            hashes = _words(text)
            terms, tf = np.unique(hashes, return_counts=True)
            df = np.array([frequency.get(int(t), 1) for t in terms], np.float64)
            idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(hashes) / average))
            for t, w in zip(terms.tolist(), impact / impact.sum()):
                lists.setdefault(t, []).append((at, float(w)))
            self.parts.append(tuple((min(shingle, len(h)), _shingled(h, shingle)) for h in split_item(text, shingle)))
        self.terms = np.array(sorted(lists), np.uint64)
        self.items = [[a for a, _ in lists[t]] for t in self.terms.tolist()]
        self.impacts = [[w for _, w in lists[t]] for t in self.terms.tolist()]
        self.most = np.array([max(w) for w in self.impacts])
        self.group_most = [self._groups(a, w) for a, w in zip(self.items, self.impacts)]
        # [terms, groups]; an index has few groups, so this is small
        self.bounds = np.zeros((len(self.terms), -(-len(items) // GROUP)), np.float32)
        for t, most in enumerate(self.group_most):
            self.bounds[t, list(most)] = list(most.values())
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    @staticmethod
    def _groups(items: list[int], impacts: list[float]) -> dict[int, float]:
        out: dict[int, float] = {}
        for a, w in zip(items, impacts):
            out[a // GROUP] = max(w, out.get(a // GROUP, 0.0))
        return out

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and their numbers."""
        at = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        ok = self.terms[number] == hashes[at]
        return at[ok], number[ok]

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """(item, score) of all items at or above the threshold."""
        need, out = self.threshold - 1e-9, []
        cursors = [[self.items[t][0], 0, t] for t in terms]
        while True:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, (item, _, t) in enumerate(cursors):
                if item == DONE:
                    break
                bound += self.most[t]
                if bound >= need:
                    pivot = i
                    break
            if pivot < 0:
                return out
            goal = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == goal:
                pivot += 1
            group = goal // GROUP
            if sum(self.group_most[c[2]].get(group, 0.0) for c in cursors[: pivot + 1]) < need:
                # No item of this group below the next cursor can reach the threshold.
                after = (group + 1) * GROUP
                if pivot + 1 < len(cursors):
                    after = min(after, cursors[pivot + 1][0])
                self._advance(cursors[: pivot + 1], max(after, goal + 1))
            elif cursors[0][0] == goal:
                score = math.fsum(self.impacts[c[2]][c[1]] for c in cursors[: pivot + 1])  # the same in whatever order the lists are
                if score >= need:
                    out.append((goal, score))
                self._advance(cursors[: pivot + 1], goal + 1)
            else:
                self._advance([c for c in cursors[: pivot + 1] if c[0] < goal], goal)

    def _advance(self, cursors: list[list[int]], to: int) -> None:
        for c in cursors:
            own = self.items[c[2]]
            c[1] = bisect_left(own, to, c[1])
            c[0] = own[c[1]] if c[1] < len(own) else DONE


SCHEMA = "doc_id long, row_key long, row_hash int, item_id long, score double, question_overlap double, answer_overlap double"


def _leaks(own: Index, hashes: np.ndarray, first: np.ndarray, reach: int, shingle: int, overlap: float) -> Iterator[tuple]:
    """(text, item id, score, question share, answer share)"""
    v = len(own.terms)
    at, term = own.find(hashes)
    if not len(at):
        return
    # Stretches of `reach` words are numbered over all texts; a passage is a stretch and the next one of its text.
    stretches = -(-np.diff(first) // reach)
    base = np.cumsum(stretches) - stretches
    text = np.searchsorted(first, at, side="right") - 1
    inner = at - first[text]
    stretch = base[text] + inner // reach
    later = inner >= reach
    keys = np.concatenate([stretch * v + term, (stretch[later] - 1) * v + term[later]])
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    passage, term = keys // v, keys % v
    new = np.flatnonzero(np.diff(passage, prepend=-1))
    edges = np.append(new, len(term))
    step = max(1, (1 << 22) // (own.bounds.shape[1] * 64))
    for lo in range(0, len(new), step):
        a, b = edges[lo], edges[min(lo + step, len(new))]
        bound = np.add.reduceat(own.bounds[term[a:b]], new[lo : lo + step] - a, axis=0).max(axis=1)
        for i in lo + np.flatnonzero(bound >= own.threshold - 1e-4):
            p = passage[new[i]]
            t = int(np.searchsorted(base, p, side="right") - 1)
            begin = first[t] + (p - base[t]) * reach
            words = hashes[begin : min(begin + 2 * reach, first[t + 1])]
            for item, score in own.retrieve(term[edges[i] : edges[i + 1]].tolist()):
                question, answer = (float(np.isin(part, grams(words, k)).mean()) for k, part in own.parts[item])
                if question >= overlap and answer >= overlap:
                    yield t, own.ids[item], score, question, answer


def _leaks_of(texts: pa.Array, indexes: list[Index], reach: int, shingle: int, overlap: float) -> Iterator[tuple]:
    """(row, item id, score, question share, answer share) of a column of texts."""
    for lo, _, raw, off in blocks(texts):
        raw = LOWER[raw]
        starts, ends, first = word_spans(raw, off)
        hashes = word_hashes(raw, starts, ends)
        for own in indexes:
            for t, *rest in _leaks(own, hashes, first, reach, shingle, overlap):
                yield lo + t, *rest


def _query(docs: DataFrame, indexes, reach: int, shingle: int, overlap: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[tuple[int, int | None], tuple] = {}
            for row, item_id, *told in _leaks_of(batch.column(3), indexes.value, reach, shingle, overlap):
                best[row, item_id] = max(best.get((row, item_id), (-1.0,)), tuple(told))
            kept = sorted(best, key=lambda k: (k[0], k[1] is not None, k[1] or 0))
            rows = pa.array([k[0] for k in kept], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i).take(rows) for i in range(3)],
                    pa.array([k[1] for k in kept], pa.int64()),
                    pa.array([best[k][0] for k in kept], pa.float64()),
                    pa.array([best[k][1] for k in kept], pa.float64()),
                    pa.array([best[k][2] for k in kept], pa.float64()),
                ],
                names=["doc_id", "row_key", "row_hash", "item_id", "score", "question_overlap", "answer_overlap"],
            )

    return docs.mapInArrow(run, SCHEMA)


def _indexes(tests: DataFrame, threshold: float, shingle: int, block_bytes: int) -> Iterator[tuple]:
    """(broadcast indexes, reach) of one block of test items after the other. tests: item_id, text (not null)."""
    spark = tests.sparkSession

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [_words(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(h) for h in hashes], pa.int64()), pa.array([np.unique(h).view(np.int64) for h in hashes], pa.list_(pa.int64()))], names=["words", "terms"]
            )

    measured = tests.select("text").mapInArrow(measure, "words long, terms array<long>").where(F.col("words") >= shingle)
    count, average, longest = measured.agg(F.count("*"), F.avg("words"), F.max("words")).first()
    if not count:
        return
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0]
    cuts, reach = max(1, math.ceil(size / block_bytes)), max(64, int(longest))
    frequency = measured.select(F.explode("terms").alias("term")).groupBy("term").count()
    blocked = tests if cuts == 1 else stored(tests.withColumn("block", F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(cuts))), "items")
    for block in range(cuts):
        mine = blocked if cuts == 1 else blocked.where(F.col("block") == block)
        rows_here = mine.select("item_id", "text").collect()  # about block_bytes
        texts = sorted(((r["item_id"], r["text"]) for r in rows_here if len(_words(r["text"])) >= shingle), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        if not texts:
            continue
        own_terms = mine.select("text").mapInArrow(measure, "words long, terms array<long>").select(F.explode("terms").alias("term")).distinct()
        df = {r["term"] & (2**64 - 1): r["count"] for r in frequency.join(own_terms, "term").collect()}
        sent = spark.sparkContext.broadcast([Index(texts[lo : lo + ITEMS], count, float(average), df, threshold, shingle) for lo in range(0, len(texts), ITEMS)])
        yield sent, reach


def contaminated(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    threshold: float = 0.6, overlap: float = 0.8, shingle: int = 5, block_bytes: int = 16 << 20,
) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every document that holds a test item."""
    # A row is known by its id and 96 bits of hashes of its text, in whatever pass over the documents it is met.
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), F.hash(text).alias("row_hash"), F.col(text).alias("text"))
    tests = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")

    out, before = None, None
    for sent, reach in _indexes(tests, threshold, shingle, block_bytes):
        if out is not None and before is not None:  # one block is in memory at a time
            out, before = stored(out, "leaks"), before.destroy()
        found = _query(rows, sent, reach, shingle, overlap)
        out, before = found if out is None else out.union(found), sent
    if out is None:
        out = docs.sparkSession.createDataFrame([], SCHEMA)
    told = F.struct("score", "question_overlap", "answer_overlap")
    return out.groupBy("doc_id", "row_key", "row_hash", "item_id").agg(F.max(told).alias("best")).select("doc_id", "item_id", "best.*")


def without_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", threshold: float = 0.6, overlap: float = 0.8, shingle: int = 5,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns, each judged by its own text whatever its id, without a join."""
    at = docs.columns.index(text)
    tests = items.select(F.lit(0).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    kept, several = docs, 0
    for sent, reach in _indexes(tests, threshold, shingle, block_bytes):

        def clean(batches: Iterator[pa.RecordBatch], sent=sent, reach=reach) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = {row for row, *_ in _leaks_of(batch.column(at), sent.value, reach, shingle, overlap)}
                yield batch.filter(pa.array([i not in rows for i in range(batch.num_rows)], pa.bool_())) if rows else batch

        kept = (stored(kept, "clean") if several else kept).mapInArrow(clean, docs.schema)
        several += 1
    return kept
