"""Token ids of every document in binary files of patched frame-of-reference blocks.

A file holds documents in ascending id order::

    "PFR1" | u32 block length | u64 documents | u64 ids | i64 document id each | u64 end of each document in ids
           | u64 start byte of each block | blocks

A block holds ``block length`` ids (the last one may hold fewer)::

    u32 minimum | u8 width | u16 exceptions | ids less the minimum, packed at that width
                | u16 place of each exception | u32 value of each exception

The width is that of the chosen percentile of a block, so a few large ids do not widen the rest: they are exceptions.

Documents are dealt by ranges of their id and sorted within; each task writes files of at most ``ids_a_file`` ids (one
longer document stands alone), under a name that depends on partition and order alone, and by renaming. A task that
runs again after a lost executor writes the same bytes under the same name.

Defined results: null text counts as empty, an empty text is the end id alone; null ids come first (kept as the lowest
long in files); rows that share an id are ordered by the first 32 characters of the text, then
its hash, and all kept; extra columns are ignored; an empty table gives no file and no rows.
"""

from __future__ import annotations

import io
import json
import struct
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlens.llm.memo import Memo
from convlens.llm.shared import shared_dir
from convlens.llm.words import blocks, text_buffers

MAGIC = b"PFR1"
NO_ID = -(2**63)


# --- blocks ---------------------------------------------------------------------------------------------------------


def _lanes(width: int) -> Iterator[tuple[int, int, int, int]]:
    """(value of eight, byte, shift, place in that value) for each byte that eight values of ``width`` bits touch."""
    for lane in range(8):
        byte, shift = divmod(lane * width, 8)
        for k in range((shift + width + 7) // 8):
            yield lane, byte + k, shift, 8 * k


def pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Each row of non-negative integers below 2**width as packed bytes, low bits first."""
    if width in (8, 16, 32):
        return np.ascontiguousarray(rows.astype(f"<u{width // 8}")).view(np.uint8).reshape(len(rows), -1)
    eights = -(-rows.shape[1] // 8)
    values = np.zeros((len(rows), eights * 8), np.uint64)
    values[:, : rows.shape[1]] = rows
    values = values.reshape(len(rows), eights, 8)
    out = np.zeros((len(rows), eights, width), np.uint8)
    for lane, byte, shift, at in _lanes(width):
        out[:, :, byte] |= (values[:, :, lane] << np.uint64(shift) >> np.uint64(at)).astype(np.uint8)
    return out.reshape(len(rows), -1)[:, : -(-rows.shape[1] * width // 8)]


def unpack(rows: np.ndarray, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.ascontiguousarray(rows).view(f"<u{width // 8}").astype(np.uint32)
    if not width:
        return np.zeros((len(rows), n), np.uint32)
    eights = -(-n // 8)
    packed = np.zeros((len(rows), eights * width), np.uint8)
    packed[:, : rows.shape[1]] = rows
    packed = packed.reshape(len(rows), eights, width)
    out = np.zeros((len(rows), eights, 8), np.uint64)
    for lane, byte, shift, at in _lanes(width):
        out[:, :, lane] |= packed[:, :, byte].astype(np.uint64) << np.uint64(at) >> np.uint64(shift)
    return (out.reshape(len(rows), -1)[:, :n] & np.uint64((1 << width) - 1)).astype(np.uint32)


def encode_blocks(ids: np.ndarray, block: int, percentile: float) -> list[bytes]:
    out: list[bytes] = []
    for lo in range(0, len(ids), block * 64):
        part = ids[lo : lo + block * 64].astype(np.uint32)
        full = len(part) // block
        for rows in [part[: full * block].reshape(full, block)] * bool(full) + [part[None, full * block :]] * bool(len(part) % block):
            least = rows.min(axis=1)
            rest = rows - least[:, None]
            k = min(rows.shape[1] - 1, int(percentile * rows.shape[1]))
            widths = np.array([int(x).bit_length() for x in np.partition(rest, k, axis=1)[:, k]])
            made: list[bytes] = [b""] * len(rows)
            for w in np.unique(widths):
                mine = np.flatnonzero(widths == w)
                odd = rest[mine] >> np.uint32(w) > 0 if w < 32 else np.zeros((len(mine), rows.shape[1]), bool)
                packed = pack(np.where(odd, np.uint32(0), rest[mine]), int(w)) if w else np.zeros((len(mine), 0), np.uint8)
                for i, r in enumerate(mine):
                    at = np.flatnonzero(odd[i])
                    made[r] = b"".join(
                        (struct.pack("<IBH", least[r], w, len(at)), packed[i].tobytes(), at.astype("<u2").tobytes(), rest[r][at].astype("<u4").tobytes())
                    )
            out += made
    return out


def write_file(doc_ids: Sequence[int] | np.ndarray, ends: Sequence[int] | np.ndarray, ids: np.ndarray, block: int = 1024, percentile: float = 0.9) -> bytes:
    if not 0 < block < 2**16:
        raise ValueError("a block holds 1 to 65,535 ids")
    blocks = encode_blocks(ids, block, percentile)
    starts = np.cumsum([0] + [len(b) for b in blocks])[:-1] if blocks else np.zeros(0)
    out = io.BytesIO()
    out.write(MAGIC + struct.pack("<IQQ", block, len(doc_ids), len(ids)))
    for a, kind in ((doc_ids, "<i8"), (ends, "<u8"), (starts, "<u8")):
        out.write(np.asarray(a).astype(kind).tobytes())
    for b in blocks:
        out.write(b)
    return out.getvalue()


class TokenFile:
    """Reads a file's documents; ``ids(lo, hi)`` unpacks only the blocks that hold them, found by the block index."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        self.data = np.frombuffer(data, np.uint8)
        self.block, n, self.n_ids = struct.unpack_from("<IQQ", data, 4)
        at = 24
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.ends = np.frombuffer(data, "<u8", n, at + 8 * n).astype(np.int64)
        blocks = -(-self.n_ids // self.block)
        self.starts = np.frombuffer(data, "<u8", blocks, at + 16 * n).astype(np.int64)
        self.body = at + 16 * n + 8 * blocks

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        hi = self.n_ids if hi is None else hi
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block, (hi - 1) // self.block
        out = np.empty((last - first + 1) * self.block, np.uint32)
        heads = [struct.unpack_from("<IBH", self.data, self.body + int(self.starts[b])) for b in range(first, last + 1)]
        sizes = [min(self.block, self.n_ids - b * self.block) for b in range(first, last + 1)]
        for kind in set(zip((h[1] for h in heads), sizes)):
            width, n = kind
            mine = [i for i, h in enumerate(heads) if (h[1], sizes[i]) == kind]
            packed = -(-n * width // 8)
            begin = self.body + self.starts[[first + i for i in mine]] + 7
            values = unpack(self.data[begin[:, None] + np.arange(packed)], width, n)
            for j, i in enumerate(mine):
                least, _, odd = heads[i]
                if odd:
                    at = int(begin[j]) + packed
                    values[j][np.frombuffer(self.data, "<u2", odd, at)] = np.frombuffer(self.data, "<u4", odd, at + 2 * odd)
                out[i * self.block : i * self.block + n] = values[j] + np.uint32(least)
        return out[lo - first * self.block : hi - first * self.block]


# --- texts to ids ---------------------------------------------------------------------------------------------------


# Fixed value: the pattern by which the tokenizer cuts a lower-cased text into words.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Fixed value: how it normalises a text before that.
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WHITE, LETTER, NUMBER, OTHER = range(4)
_CHARS = [chr(b) for b in range(256)]
KIND = np.array([WHITE if c.isspace() and not "\x1c" <= c <= "\x1f" else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER) for c in _CHARS], np.uint8)
LOWER = np.array([ord(c.lower()) for c in _CHARS], np.uint8)


def cut_words(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a lower-cased Latin-1 text: which characters belong to words, and where words begin, as ``CUTS`` has it."""
    kind = KIND[text]
    before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
    first = (kind != WHITE) & ((kind != before) | (kind == NUMBER))
    # A quote that begins a word takes a short ending with it.
    quotes = np.flatnonzero(first & (text == ord("'")))
    if len(quotes):
        after = np.concatenate([text, np.zeros(2, np.uint8)])
        one, two = after[quotes + 1], after[quotes + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = np.isin(one.astype(np.uint16) << 8 | two, np.frombuffer(b"revell", ">u2"))
        first[quotes[short | long] + 1] = False
        rest = np.concatenate([quotes[short] + 2, quotes[long] + 3])
        rest = rest[rest < len(text)]
        first[rest[kind[rest] == LETTER]] = True
    return kind != WHITE, first


class WordEncoder:
    """Ids of texts by their distinct words. One for each Python worker.

    A batch of Latin-1 texts is cut into words as one array of characters, the distinct words are looked up, new ones go
    to the tokenizer's merges many at a time, and ids are laid out by the words' numbers. Other texts, and those that may
    hold the string of a special token, go part by part between white space through the tokenizer itself.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.memo = Memo(self._part, most // 8)
        self.most = most
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_part = cuts_at_white_space(spec)
        self.by_word = self.by_part
        self.marks = [t["content"] for t in spec["added_tokens"]]
        if self.by_word:
            self.marks = sorted({m[:2].lower() for m in self.marks})
            split, *rest = spec["pre_tokenizer"]["pretokenizers"]
            bare = {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *rest]}}
            self.merges = Tokenizer.from_str(json.dumps(spec | bare))
            suffix = spec["model"].get("end_of_word_suffix")
            vocab = spec["model"]["vocab"]
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
            self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.ends = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _part(self, part: str) -> bytes:
        return np.array(self.own.encode(part.removeprefix("\x01"), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[bytes], at_once: int = 256) -> None:
        """Ids of new words, which stand in ``pool`` up to ``ends`` in the order of their numbers."""
        groups = [words[lo : lo + at_once] for lo in range(0, len(words), at_once)]
        ids, sizes = [self.pool], [np.zeros(0, np.int64)]
        for group, coded in zip(groups, self.merges.encode_batch_fast([b" ".join(g).decode("latin-1") for g in groups], add_special_tokens=False)):
            got = np.array(coded.ids, np.uint32)
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) != len(group) or ends[-1] != len(got):  # the last tokens of words don't tell them apart here
                single = [e.ids for e in self.merges.encode_batch_fast([w.decode("latin-1") for w in group], add_special_tokens=False)]
                got, ends = np.array(sum(single, []), np.uint32), np.cumsum([len(s) for s in single])
            ids.append(got)
            sizes.append(np.diff(ends, prepend=0))
        self.known.update(zip(words, range(len(self.ends), len(self.ends) + len(words))))
        so_far = self.ends[-1] if len(self.ends) else 0
        self.pool, self.ends = np.concatenate(ids), np.concatenate([self.ends, so_far + np.cumsum(np.concatenate(sizes))])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.pool) > 8 * self.most:
            self.forget()
        out = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(self.known) + int((out < 0).sum()) > self.most and self.known:
            self.forget()
            out[:] = -1
        places = np.flatnonzero(out < 0)
        new = [words[i] for i in places]
        if new:
            out[places] = np.arange(len(self.ends), len(self.ends) + len(new))
            self.learn(new)
        for w in new:
            if len(w) > 200:  # long words hardly repeat and would take the memory of many
                del self.known[w]
        return out

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of Latin-1 texts in a row, and how many each has."""
        line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), " ")[0].as_py()
        line = LOWER[np.frombuffer(line.encode("latin-1"), np.uint8)]
        inside, first = cut_words(line)
        begins = np.flatnonzero(first)
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        chars = line[inside]
        offsets = np.append((np.cumsum(inside, dtype=np.int32) - 1)[begins], len(chars)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(chars)]).dictionary_encode()
        word = self.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        size = np.diff(self.ends, prepend=0)[word]
        upto = np.cumsum(size)
        ids = self.pool[np.repeat(self.ends[word] - upto, size) + np.arange(upto[-1])]
        edges = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy().astype(np.int64) + 1)])
        return ids, np.diff(np.concatenate([[0], upto])[np.searchsorted(begins, edges)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has. Nulls count as empty."""
        texts = texts.fill_null("")
        if not self.by_word:
            apart = np.ones(len(texts), bool)
        else:
            raw, off = text_buffers(texts)
            apart = np.zeros(len(texts), bool)
            apart[np.searchsorted(off, np.flatnonzero(raw > 0xC3), side="right") - 1] = True  # beyond Latin-1
            for mark in self.marks:
                apart |= pc.match_substring(texts, mark, ignore_case=True).to_numpy(zero_copy_only=False)
        if not apart.any():
            return self._by_words(texts)
        others = [np.frombuffer(b, "<u4") for b in self._each(texts.filter(pa.array(apart)).to_pylist())]
        if apart.all():
            return np.concatenate(others) if others else np.zeros(0, np.uint32), np.array([len(b) for b in others], np.int64)
        ids, counts = self._by_words(texts.filter(pa.array(~apart)))
        plain, rest = iter(np.split(ids, np.cumsum(counts)[:-1])), iter(others)
        mixed = [next(rest) if a else next(plain) for a in apart]
        return np.concatenate(mixed), np.array([len(m) for m in mixed], np.int64)

    def _each(self, texts: list[str]) -> list[bytes]:
        if self.by_part:
            memo = self.memo
            return [b"".join([memo[p] for p in _parts(t)]) for t in texts]
        return [np.array(e.ids, "<u4").tobytes() for e in self.own.encode_batch(texts, add_special_tokens=False)]


@lru_cache(2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _parts(text: str) -> list[str]:
    """Pieces of a text between white space. A \x01 is put before those that begin with one."""
    if not text:
        return []
    parts = text.replace("\n", " ").split(" ")
    return ["\x01" + p if p.startswith("\x01") else p for p in parts] if "\x01" in text else parts


def cuts_at_white_space(spec: dict) -> bool:
    """Whether a tokenizer normalises and cuts exactly as is known here, so that parts between white space can be encoded apart; else the library encodes whole texts."""
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    first, *rest = pre.get("pretokenizers") or [pre]
    cut = {"type": "Split", "pattern": {"Regex": CUTS}, "behavior": "Removed", "invert": True}
    return normal == NORMAL and first == cut and [r.get("type") for r in rest] == ["ByteLevel"] and not rest[0].get("add_prefix_space") and not rest[0].get("use_regex")


# --- the job --------------------------------------------------------------------------------------------------------


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, to: str | None = None, doc_id: str = "doc_id", text: str = "text",
    block: int = 1024, percentile: float = 0.9, ids_a_file: int = 1 << 21,
) -> tuple[str, DataFrame]:
    """Encode, write, and return the folder with its manifest (part, file, n_docs, n_ids), itself a table in that folder."""
    spark = docs.sparkSession
    to = to or shared_dir(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(to)
        part, made = TaskContext.get().partitionId(), []
        held: list[np.ndarray] = []  # ids of whole documents in a row
        keys: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        room = ids_a_file

        def flush() -> None:
            ids, sizes_here = np.concatenate(held), np.concatenate(sizes)
            name = f"part-{part:06d}-{len(made):06d}.pfr"
            store.create_dir(f"{root}/files")
            own = f"{root}/files/.{name}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(own) as out:
                out.write(write_file(np.concatenate(keys), np.cumsum(sizes_here), ids, block, percentile))
            store.move(own, f"{root}/files/{name}")
            made.append({"part": part, "file": len(made), "n_docs": len(sizes_here), "n_ids": len(ids)})
            held.clear(), keys.clear(), sizes.clear()

        for batch in batches:
            for begin, end, _, _ in blocks(batch.column(1), 8 << 20):
                ids, counts = _encoder(tokenizer).encode(batch.column(1).slice(begin, end - begin))
                upto = np.cumsum(counts + 1)
                whole = np.full(upto[-1], end_id, np.uint32)
                whole[np.delete(np.arange(upto[-1]), upto - 1)] = ids
                names = batch.column(0).slice(begin, end - begin).fill_null(NO_ID).to_numpy()
                lo, before = 0, 0
                while lo < len(upto):
                    hi = int(np.searchsorted(upto, before + room, side="right"))
                    if hi == lo and not held:
                        hi = lo + 1  # a document longer than a file stands alone
                    if hi > lo:
                        held.append(whole[before : upto[hi - 1]])
                        keys.append(names[lo:hi])
                        sizes.append(counts[lo:hi] + 1)
                        room -= int(upto[hi - 1]) - before
                        lo, before = hi, int(upto[hi - 1])
                    if lo < len(upto):
                        flush()
                        room = ids_a_file
        if held:
            flush()
        yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("part", pa.int32()), ("file", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id"), F.substring("text", 1, 32), F.xxhash64("text")]  # also parts the rows of a common id
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    made = ordered.mapInArrow(write, "part int, file int, n_docs long, n_ids long")
    made.write.parquet(f"{to}/manifest")
    return to, spark.read.schema(made.schema).parquet(f"{to}/manifest")


SUMMARY = T.StructType(
    [T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("file", T.IntegerType()), ("doc_id", T.LongType()), ("begin", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()))]
)


def read_token_files(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document read back from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                _, part, file = path.as_py().rsplit("/", 1)[-1].removesuffix(".pfr").split("-")
                own = TokenFile(content.as_buffer())
                ids = own.ids()
                begins = np.concatenate([[0], own.ends[:-1]]).astype(np.int64)
                sums = [zlib.crc32(ids[a:b].astype("<u4", copy=False)) for a, b in zip(begins, own.ends)]
                n = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, int(part), np.int32)),
                        pa.array(np.full(n, int(file), np.int32)),
                        pa.array(own.doc_ids, mask=own.doc_ids == NO_ID),
                        pa.array(begins),
                        pa.array(own.ends - begins),
                        pa.array(np.array(sums, np.int64)),
                    ],
                    names=SUMMARY.names,
                )

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfr").load(f"{folder}/files").select("path", "content")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Partitions in a row by one task, a row for each; the files of a partition by many.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("part_start"))
    starts = manifest.withColumn("file_start", before(Window.partitionBy("part").orderBy("file"))).join(parts, "part")
    return (
        files.mapInArrow(read, SUMMARY)
        .join(starts.select("part", "file", (F.col("part_start") + F.col("file_start")).alias("base")), ["part", "file"])
        .select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
    )
