"""Ranked lexical search: Block-Max MaxScore over shards of an inverted index, and a merge of the shards' heaps.

Index. Documents are cut into shards of about ``SHARD_BYTES`` of text, each one row of a table: its documents, their lengths, and for
each term a list of postings in blocks of ``BLOCK``, as variable-length differences of document numbers and counts. A block keeps
beside its first document the counts and lengths that no other posting of it beats in both; from them its largest impact follows
for whatever statistics the whole corpus turns out to have. No row leaves its task, so no term or source can be a hot key.

Search. Queries go through the driver in blocks of about ``query_bytes`` of text. The documents that hold a term are summed over the
shards' lists. A task then takes its shards one after the other and keeps, for each query, a heap of the best k so far, whose last score
is the threshold. In a shard the lists of a query are ordered by their largest contribution. Those whose bounds add up to less than the
threshold are not essential: a document in none but those cannot enter the heap. The essential ones are read; what they give, plus the
maxima of the blocks in which a candidate would stand in the others, rejects candidates before these blocks are decompressed, and so again
after each list. Bounds that equal the threshold are kept, as a tie may have the smaller id. The heaps of all tasks are merged by query.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased, told apart by 64 bits of a hash. A long text
is read in pieces that end between terms.

Defined results: null texts have no terms, and documents without terms don't count; items without terms, or whose terms no document
has, give no rows; rows that share a doc_id are documents of their own and may both be listed; items that share an item_id are answered
each by itself; a null doc_id comes after all others of its score; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlens.llm.shared import stored
from convlens.llm.words import LOWER, blocks, word_hashes, word_spans

BLOCK, SHARD_BYTES, SHARD_DOCS, PIECE = 64, 4 << 20, 1 << 16, 1 << 20
PARTS = np.ones(256, bool)  # bytes that part terms
PARTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

SCHEMA = (
    "with_terms long, tokens long, doc_ids array<long>, lengths binary, terms binary, dfs binary, block_first binary, block_at binary, "
    "front_start binary, front_tf binary, front_length binary, postings binary"
)
LATE = np.iinfo(np.int64).max  # where a null id sorts


def impact(tf: np.ndarray, length: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    """What a term's weight is multiplied by: more with its count, less with the document's length."""
    m = 75 + 25 * length * documents // max(tokens, 1)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


# --- terms -----------------------------------------------------------------------------------------------------------


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets); a long text comes in several pieces, each cut where no term is."""
    for lo, hi, raw, off in blocks(column):
        if hi - lo > 1 or len(raw) <= 2 * PIECE:
            yield lo, raw, off
            continue
        begin = 0
        while begin < len(raw):
            end = min(begin + PIECE, len(raw))
            while end < len(raw):  # on to the next byte that parts terms
                ahead = np.flatnonzero(PARTS[raw[end : end + PIECE]])
                if len(ahead):
                    end += int(ahead[0])
                    break
                end = min(end + PIECE, len(raw))
            yield lo, raw[begin:end], np.array([0, end - begin])
            begin = end


def counted_terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, term hash, count), by text and hash within each piece."""
    for lo, raw, off in _pieces(column):
        raw = LOWER[raw]
        starts, ends, first = word_spans(raw, off, PARTS)
        if not len(starts):
            continue
        hashes = word_hashes(raw, starts, ends)
        text = np.repeat(np.arange(len(off) - 1), np.diff(first))
        order = np.lexsort((hashes, text))
        text, hashes = text[order], hashes[order]
        new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])]))
        yield lo + text[new], hashes[new], np.diff(np.append(new, len(text)))


# --- index -----------------------------------------------------------------------------------------------------------


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of seven bits each, the last of a value without the highest bit; and where each value begins (with a closing entry)."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1) << np.uint64(7 * k)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        byte = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[:-1][has] + k] = byte | np.where(size[has] > k + 1, np.uint64(128), np.uint64(0))
    return out, at


def decode(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    if len(last) == len(raw):
        return raw.astype(np.int64)
    within = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * within), first)


class _Builder:
    """Documents gathered until they make a shard."""

    def __init__(self):
        self.ids, self.found, self.count, self.bytes = [], [], 0, 0

    def row(self) -> list:
        lengths = np.zeros(self.count, np.int64)
        doc, term, tf = (np.concatenate(x) for x in zip(*self.found)) if self.found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        np.add.at(lengths, doc, tf)
        self.found = []
        order = np.argsort(term, kind="stable")  # documents were added in order
        doc, term, tf = doc[order].astype(np.int64), term[order], tf[order].astype(np.int64)
        if len(doc):  # pieces of one text
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])]))
            doc, term, tf = doc[new], term[new], np.add.reduceat(tf, new)
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(term)), bool), term[1:] != term[:-1]]))
        df = np.diff(np.append(starts, len(term)))
        place = np.arange(len(term)) - np.repeat(starts, df)
        opens = np.flatnonzero(place % BLOCK == 0)
        block = np.cumsum(place % BLOCK == 0) - 1
        step = np.diff(doc, prepend=0)
        step[opens] = 0
        raw, at = encode(np.stack([step, tf], 1).ravel())
        # Of each block the counts that no posting of a shorter document reaches.
        length = lengths[doc]
        by = np.lexsort((-tf, length, block))
        b, t = block[by], tf[by]
        height = b * (int(tf.max(initial=0)) + 1) + t
        front = np.concatenate([np.ones(min(1, len(by)), bool), height[1:] > np.maximum.accumulate(height)[:-1]])
        front_start = np.searchsorted(b[front], np.arange(len(opens) + 1))
        ids = pa.concat_arrays(self.ids) if self.ids else pa.array([], pa.int64())
        wide = lambda x: x.astype(np.int64).tobytes()
        narrow = lambda x: x.astype(np.uint32).tobytes()
        return [
            int((lengths > 0).sum()), int(lengths.sum()), ids.to_pylist(), wide(lengths), term[starts].tobytes(), narrow(df), narrow(doc[opens]), narrow(at[2 * opens]),
            narrow(front_start), narrow(t[front]), narrow(length[by][front]), raw.tobytes(),
        ]


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The shards of an index of all documents, one row each. It is read several times, so write it."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 9]

    def shard(built: _Builder) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(built.row(), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Builder()
        for batch in batches:
            # A batch may hold many shards' text, so it is added by slices.
            for lo, hi, raw, _ in blocks(batch.column(1), max(1, shard_bytes // 4)):
                ids, texts = batch.slice(lo, hi - lo).columns
                own.ids.append(ids)
                own.found += [((own.count + doc).astype(np.int32), term, tf.astype(np.int32)) for doc, term, tf in counted_terms(texts)]
                own.count += hi - lo
                own.bytes += len(raw)
                if own.bytes >= shard_bytes or own.count >= SHARD_DOCS:
                    yield shard(own)
                    own = _Builder()
        if own.count:
            yield shard(own)

    return rows.mapInArrow(run, SCHEMA)


# --- search ----------------------------------------------------------------------------------------------------------


class Shard:
    """A shard opened for the statistics of the whole corpus; lists are decompressed when they are asked for."""

    def __init__(self, row: dict, documents: int, tokens: int):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids = row["doc_ids"]
        self.lengths, self.terms = read("lengths", np.int64), read("terms", np.uint64)
        df = read("dfs", np.uint32).astype(np.int64)
        self.first_block = np.concatenate([[0], np.cumsum(-(-df // BLOCK))])
        self.block_first = read("block_first", np.uint32).astype(np.int64)
        self.postings = read("postings", np.uint8)
        self.block_at = np.append(read("block_at", np.uint32).astype(np.int64), len(self.postings))
        self.statistics, self.open = (documents, tokens), {}
        self.decompressed = 0  # blocks, for tests
        best = impact(read("front_tf", np.uint32).astype(np.int64), read("front_length", np.uint32).astype(np.int64), documents, tokens)
        start = read("front_start", np.uint32).astype(np.int64)
        self.block_max = np.maximum.reduceat(best, start[:-1]) if len(best) else best
        self.list_max = np.maximum.reduceat(self.block_max, self.first_block[:-1]) if len(best) else best

    def blocks_of(self, number: int) -> slice:
        return slice(int(self.first_block[number]), int(self.first_block[number + 1]))

    def read(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of blocks, which are given in order."""
        self.decompressed += len(wanted)
        sizes = self.block_at[wanted + 1] - self.block_at[wanted]
        if len(wanted) and wanted[-1] - wanted[0] + 1 == len(wanted):
            raw = self.postings[self.block_at[wanted[0]] : self.block_at[wanted[-1] + 1]]
        else:
            ends = np.cumsum(sizes)
            raw = self.postings[np.arange(ends[-1]) + np.repeat(self.block_at[wanted] - ends + sizes, sizes)]
        pairs = decode(raw).reshape(-1, 2)
        # A block's first difference is 0 but no other is, so zeros tell where blocks begin.
        run, begins = np.cumsum(pairs[:, 0]), np.flatnonzero(pairs[:, 0] == 0)
        count = np.diff(np.append(begins, len(pairs)))
        docs = run + np.repeat(self.block_first[wanted] - run[begins], count)
        return docs, impact(pairs[:, 1], self.lengths[docs], *self.statistics)

    def whole(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        if number not in self.open:
            own = self.blocks_of(number)
            self.open[number] = self.read(np.arange(own.start, own.stop))
        return self.open[number]

    def best(self, lists: np.ndarray, weights: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of all that score ``threshold`` or more over some of the shard's lists."""
        bound = weights * self.list_max[lists]
        order = np.argsort(bound, kind="stable")
        lists, weights, sums = lists[order], weights[order], np.cumsum(bound[order])
        essential = int(np.searchsorted(sums, threshold))
        if essential == len(lists):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = np.zeros(len(self.lengths), np.int64)
        for number, weight in zip(lists[essential:].tolist(), weights[essential:].tolist()):
            docs, value = self.whole(number)
            total[docs] += weight * value
        docs = np.flatnonzero(total)
        score = total[docs]
        if not essential:
            ok = score >= threshold
            return docs[ok], score[ok]
        ok = score + sums[essential - 1] >= threshold
        docs, score = docs[ok], score[ok]
        # The maxima of the blocks in which the candidates would stand.
        block, most = np.zeros((essential, len(docs)), np.int64), np.zeros((essential, len(docs)), np.int64)
        for i in range(essential):
            own = self.blocks_of(int(lists[i]))
            at = np.searchsorted(self.block_first[own], docs, side="right") - 1
            block[i] = own.start + at
            most[i] = np.where(at >= 0, weights[i] * self.block_max[own][at], 0)
        rest = most.sum(axis=0)
        for i in range(essential - 1, -1, -1):
            ok = score + rest >= threshold
            if not ok.all():
                docs, score, rest, block, most = docs[ok], score[ok], rest[ok], block[:, ok], most[:, ok]
            if not len(docs):
                break
            rest = rest - most[i]
            number = int(lists[i])
            if number in self.open:
                held, value = self.open[number]
            else:
                wanted = np.unique(block[i][most[i] > 0])
                if not len(wanted):
                    continue
                held, value = self.read(wanted)
            at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            score = score + np.where(held[at] == docs, weights[i] * value[at], 0)
        ok = score >= threshold
        return docs[ok], score[ok]


class _Heap:
    """The best k of a query so far, best first."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def threshold(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def push(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]


class _Questions:
    """A block of items: their distinct terms, and for each item the numbers and weights of its own."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        self.ids, found = ids, list(counted_terms(pa.array(texts, pa.string())))
        item, term, self.times = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.terms, self.number = np.unique(term, return_inverse=True)
        self.first = np.searchsorted(item, np.arange(len(ids) + 1))
        self.weights = np.zeros(len(self.terms), np.int64)


def _frequencies(index: DataFrame, asked: np.ndarray) -> dict[int, int]:
    """In how many documents each term stands: sums over a task's shards, then over tasks. At most one row for each term comes back."""
    sent = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        count = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                held, df = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["dfs"], np.uint32)
                if len(held):
                    at = np.minimum(np.searchsorted(held, terms), len(held) - 1)
                    count += np.where(held[at] == terms, df[at], 0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(count[some], pa.int64())], names=["term", "df"])

    parts = index.select("terms", "dfs").mapInArrow(run, "term long, df long")
    return {r["term"]: r["df"] for r in parts.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def _blocks_of_items(items: DataFrame, query_bytes: int) -> Iterator[list]:
    """Lists of (item_id, text) of about ``query_bytes``, whatever the ids."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    cuts = max(1, math.ceil(size / query_bytes))
    dealt = items if cuts == 1 else stored(items.withColumn("block", F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(cuts))), "items")
    for block in range(cuts):
        rows = (dealt if cuts == 1 else dealt.where(F.col("block") == block)).select("item_id", "text").collect()  # about query_bytes
        if rows:
            yield rows


FOUND = "query long, item_id long, doc_id long, score long"


def search(index: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", text: str = "text", query_bytes: int = 4 << 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item. index: what ``build_index`` made, written."""
    spark = index.sparkSession
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text is not null")
    documents, tokens = index.agg(F.coalesce(F.sum("with_terms"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    out, begun = None, 0
    for rows in _blocks_of_items(asked, query_bytes):
        questions = _Questions([r["item_id"] for r in rows], [r["text"] for r in rows])
        for term, df in _frequencies(index, questions.terms).items():
            questions.weights[term] = term_weight(documents, df)
        found = _search_block(index, spark.sparkContext.broadcast(questions), documents, tokens, k, begun)
        begun += len(rows)
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(index: DataFrame, sent, documents: int, tokens: int, k: int, begun: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        heaps = [_Heap(k) for _ in asked.ids]
        for batch in batches:
            for i in range(batch.num_rows):
                answer(Shard({n: batch.column(n)[i].as_py() for n in batch.schema.names}, documents, tokens), asked, heaps)
        rows = [(begun + q, asked.ids[q], None if d == LATE else d, s) for q, h in enumerate(heaps) for d, s in zip(h.ids.tolist(), h.scores.tolist())]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, FOUND)


def answer(shard: Shard, asked: _Questions, heaps: list[_Heap]) -> None:
    """Every query over one shard."""
    if not len(shard.terms) or not len(asked.terms):
        return
    at = np.minimum(np.searchsorted(shard.terms, asked.terms), len(shard.terms) - 1)
    held = (shard.terms[at] == asked.terms) & (asked.weights > 0)
    ids = np.array([LATE if i is None else i for i in shard.ids], np.int64)
    for q, heap in enumerate(heaps):
        own = slice(asked.first[q], asked.first[q + 1])
        number = asked.number[own]
        some = held[number]
        if not some.any():
            continue
        number, times = number[some], asked.times[own][some]
        docs, scores = shard.best(at[number], asked.weights[number] * times, heap.threshold)
        if len(docs):
            heap.push(scores, ids[docs])
