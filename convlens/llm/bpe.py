"""Byte-level BPE by dynamic programming over prefixes, and decoding.

For each prefix of a word exactly one token can end its encoding: among the vocabulary's matches that end there (found
by one automaton run over the word), the one that is compatible with the last token of the prefix before it. Two tokens
are compatible if merging their joined bytes gives the two again. The last tokens are kept for every prefix; following
them back from the end gives the ids.

Defined results: null text counts as empty, an empty text has no ids and decodes to itself; a null id stays null; rows
that share an id are encoded each by itself; extra columns are ignored; an empty table gives an empty result. The time
for a word grows with its length times the vocabulary matches that end at a place, so very long words stay linear.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.llm.memo import Memo, stops_apart

# Fixed value: the pattern that cuts a text into words before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves, the others from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    """A vocabulary with its automaton and merge order."""

    def __init__(self, path: str, most: int = 150_000):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_of_letter()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for order, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = order
            self.parts.setdefault(whole, (a, b, order))
        self.left_edge, self.right_edge = lru_cache(1 << 16)(self._left_edge), lru_cache(1 << 16)(self._right_edge)
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if token not in self.special and self._stands(i):
                own = self.bytes[i].decode("latin-1")
                self.automaton.add_word(own, (len(own), i))
        self.automaton.make_automaton()
        self.words = regex.compile(WORDS)
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.word, self.part = Memo(self._word, most // 8), Memo(self._part, most)
        n = max(self.bytes) + 1
        self.lengths = {i: len(b) for i, b in self.bytes.items()}
        self.decimal = {i: str(i) for i in self.bytes}
        size = np.array([len(self.bytes.get(i, b"")) for i in range(n)], np.int64)
        self.size, self.first = size, np.cumsum(size) - size
        self.all_bytes = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(n)), np.uint8)

    def _left_edge(self, token: int) -> tuple[tuple[int, float], ...]:
        """Tokens that have stood at the left end while ``token`` was made, each with the order of the merge that took it."""
        out = [(token, float("inf"))]
        while token in self.parts:
            token, _, taken = self.parts[token]
            out.append((token, taken))
        return tuple(out)

    def _right_edge(self, token: int) -> tuple[tuple[int, float], ...]:
        out = [(token, float("inf"))]
        while token in self.parts:
            _, token, taken = self.parts[token]
            out.append((token, taken))
        return tuple(out)

    def _crossing(self, a: int, b: int, before: float) -> bool:
        """Whether some merge over the border of a and b comes ahead of both sides' own, and ahead of ``before``.

        Of equal merges the leftmost goes first: one inside a precedes one over the border, which precedes one inside b.
        """
        for x, x_taken in self.right_edge(a):
            for y, y_taken in self.left_edge(b):
                order = self.rank.get((x, y))
                if order is not None and order < before and order < x_taken and order <= y_taken:
                    return True
        return False

    def _stands(self, token: int) -> bool:
        """Whether the bytes of a token encode to that token."""
        if token not in self.parts:
            return len(self.bytes[token]) == 1
        a, b, order = self.parts[token]
        return not self._crossing(a, b, order) and self._stands(a) and self._stands(b)

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= 1 << 20:
            self.pairs.clear()
        known = self.pairs[a << 32 | b] = not self._crossing(a, b, float("inf"))
        return known

    def encode_word(self, word: bytes) -> list[int]:
        last = [-1] * (len(word) + 1)
        known = self.pairs.get
        for end, (length, token) in self.automaton.iter(word.decode("latin-1")):
            end += 1
            if last[end] < 0:
                before = last[end - length]
                if length == end:
                    last[end] = token
                else:
                    fits = known(before << 32 | token)
                    if fits or fits is None and self.compatible(before, token):
                        last[end] = token
        out, at = [], len(word)
        while at:
            token = last[at]
            out.append(token)
            at -= self.lengths[token]
        out.reverse()
        return out

    def _word(self, word: str) -> str:
        return ",".join([self.decimal[i] for i in self.encode_word(word.encode())])

    def _part(self, part: str) -> str:
        """Ids of a stretch between spaces: with its leading space, unless a \\x01 says that none stood there."""
        text = part[1:] if part[:1] == "\x01" else part if part == "\n" else " " + part
        if part.isalpha():  # letters after a space are one word
            return self._word(text)
        return ",".join([self.word[w] for w in self.words.findall(text)])

    #: Texts in which white space is single spaces and line feeds between other characters are cut there at once.
    UNEVEN = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u3000\ufeff]")

    def _even(self, text: str) -> bool:
        ends = text[0] in " \n" or text[-1] in " \n"
        return not (ends or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or self.UNEVEN.search(text))

    def _plain(self, text: str) -> str:
        if not text:
            return ""
        if self._even(text):
            memo = self.part
            return ",".join([memo[p] for p in ("\x01" + stops_apart(text).replace("\n", " \n \x01")).split(" ")])
        return ",".join([self.word[w] for w in self.words.findall(text)])

    def encode(self, text: str) -> str:
        """Ids as decimal numbers joined by commas. The strings of special tokens are those tokens."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        done, at = [], 0
        for m in self.cut.finditer(text):
            done += [self._plain(text[at : m.start()]), str(self.special[m[0]])]
            at = m.end()
        done.append(self._plain(text[at:]))
        return ",".join(filter(None, done))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become U+FFFD."""
        if not len(ids):
            return b""
        size = self.size[ids]
        ends = np.cumsum(size)
        raw = self.all_bytes[np.repeat(self.first[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()
        return raw


@lru_cache(2)
def vocabulary(path: str) -> Bpe:
    """One for each Python worker."""
    return Bpe(path)


def encode_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids array<int>, decoded string on request), without a shuffle."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(tokenizer)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                rows = []
                for t in piece.column(1).to_pylist():
                    told = own.encode(t or "")
                    ids = np.fromstring(told, np.int64, sep=",") if told else np.zeros(0, np.int64)
                    decoded = own.decode(ids)
                    rows.append((len(ids), sha(told.encode()), sha(decoded), *((ids.astype(np.int32), decoded.decode()) if with_ids else ())))
                columns = [piece.column(0).cast(pa.int64()), *[pa.array(c, f[1]) for c, f in zip(zip(*rows), fields[1:])]]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    more = ", ids array<int>, decoded string" if with_ids else ""
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
