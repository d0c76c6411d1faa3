"""Fill-in-middle transformation: documents cut into prefix, middle and suffix, written in one of two orders, and back.

A unit is a run of letters A-Z, a-z or any other single code point, so no such word is ever cut. Bytes of whole batches of texts
fall into four classes - continuation bytes, letters within a run, letters that begin one, other first bytes - over which a
wavelet matrix is built. Ranks of the last two classes add up to units, ranks of the last three to code points; both cuts of all
texts of a batch are found by bisection on those ranks. Cuts alone come back from Python with the texts; outputs are put together
and taken apart by Spark expressions.

Draws come from the hex sha256 of ``seed:doc_id``: its first four groups of eight digits as unsigned integers h1 to h4. The
prefix ends after the smaller, the middle after the larger of h1 % (n + 1) and h2 % (n + 1) units; h3 % 100 decides whether a
text is transformed, h4 % 100 in which order. A text that holds a mark stays plain, so marks in an output are those put there.

Defined results: null text counts as empty, and empty texts stay plain; a null doc_id draws as the empty text; rows that share an id
share its draws; columns of documents other than the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens.llm.wavelet import WaveletMatrix
from convlens.llm.words import blocks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CONTINUES, INNER, FIRST, OTHER = range(4)
UNITS, POINTS = (FIRST, OTHER), (INNER, FIRST, OTHER)

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def classes(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The class of every byte; runs of letters end with their text."""
    letter = LETTER[raw]
    after = np.zeros(len(raw), bool)
    after[1:] = letter[:-1]
    after[off[:-1][off[:-1] < len(raw)]] = False
    out = np.where((raw & 0xC0) == 0x80, CONTINUES, OTHER).astype(np.uint8)
    out[letter] = FIRST
    out[letter & after] = INNER
    return out


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))


def _cuts(ids: list[int | None], raw: np.ndarray, off: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
    """Units, prefix and middle in code points, h3 and h4 for each text."""
    matrix = WaveletMatrix(classes(raw, off), 2)
    lo, hi = off[:-1], off[1:]
    before, points = matrix.count(UNITS, off), matrix.count(POINTS, off)
    n = np.diff(before)
    h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    first = matrix.locate(UNITS, before[:-1] + np.minimum(one, two), lo, hi)
    second = matrix.locate(UNITS, before[:-1] + np.maximum(one, two), lo, hi)
    at_first, at_second = matrix.count(POINTS, first), matrix.count(POINTS, second)
    return n, at_first - points[:-1], at_second - at_first, h[:, 2], h[:, 3]


def cut_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """doc_id, text (never null), n (units), prefix_chars, middle_chars (code points), h3, h4 for every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            parts = [_cuts(ids[lo:hi], raw, off, seed) for lo, hi, raw, off in blocks(batch.column(1))]
            told = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in told]], names=["doc_id", "text", "n", "prefix_chars", "middle_chars", "h3", "h4"]
            )

    return rows.mapInArrow(run, "doc_id long, text string, n long, prefix_chars long, middle_chars long, h3 long, h4 long")


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""
    cut = cut_documents(docs, doc_id, text, seed)
    t = F.col("text")
    marked = t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE)
    form = F.when((t == "") | marked | (F.col("h3") % 100 >= plain_from), "plain").when(F.col("h4") % 100 < spm_below, "spm").otherwise("psm")
    formed = cut.select("*", form.alias("form"))
    p, m = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle, suffix = F.substring(t, F.lit(1), p), F.substring(t, p + 1, m), F.substring(t, p + m + 1, F.length(t))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    told = lambda c: F.when(F.col("form") != "plain", F.col(c)).alias(c)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(t)
    return formed.select("doc_id", "n", "form", told("prefix_chars"), told("middle_chars"), output.alias("output"))


def restore(output: Column | str, form: Column | str) -> Column:
    """The text that an output and its form were made of."""
    output = F.col(output) if isinstance(output, str) else output
    form = F.col(form) if isinstance(form, str) else form
    # No part holds a mark and no mark's end is another's beginning, so the first of a mark is the one put there.
    head = F.substring_index(output, MIDDLE, 1)
    middle = _after(output, MIDDLE)
    prefix_first = F.concat(F.substring(F.substring_index(head, SUFFIX, 1), len(PREFIX) + 1, 1 << 30), middle, _after(head, SUFFIX))
    suffix_first = F.concat(_after(head, PREFIX), middle, F.substring(F.substring_index(head, PREFIX, 1), len(SUFFIX) + 1, 1 << 30))
    return F.when(form == "psm", prefix_first).when(form == "spm", suffix_first).otherwise(output)


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``."""
    return F.substring(text, F.instr(text, F.lit(mark)) + len(mark), F.length(text))
