"""MinHash near-duplicates by HyperMinHash sketches, with every link confirmed on full shingle sets.

1. Each document's distinct word shingles are hashed to 64 bits. Documents with one set form a class, whose smallest
   doc_id stands for it; the rest of the work is on classes.
2. A class's sketch has 128 registers of 16 bits. The top bits of a shingle's hash choose the register; it keeps the
   leading-zero count (6 bits) and the next 10 bits (mantissa) of the smallest remaining hash. An empty register takes the
   value of a non-empty one, found along a fixed random walk of its own.
3. Registers are banded by 4: a pair at similarity 0.8 shares none of the 32 bands once in 20 million.
4. Bands held by several classes are cut into blocks of members; within a pair of blocks, members whose
   collision-corrected estimate comes within six deviations of the threshold are joined to a forest. Forest edges alone
   leave a task. In a band of more than 8 blocks, first every block is held against itself and the first one, and then
   only members outside the band's most frequent component against all blocks. The components are the suspects' groups.
5. Groups are cut into blocks of texts; exact intersections within each pair of blocks confirm links, of which again a
   forest alone leaves the task. A group in one block needs no more; forests of larger groups go through components().
   In a group of many blocks, first every block is held against itself and the first one, and then only members
   outside the group's largest component against all blocks.

No task holds more than two blocks and no bucket is capped.

Defined results: A-Z are lower-cased and words are cut at ASCII white space. Null or empty text has an empty set and is
linked with nothing; fewer words than a shingle are one shingle. Rows whose doc_id is null keep a null component and are
linked with nothing. Rows that share a doc_id are one document for linking. Extra columns are ignored; an empty table gives
an empty result. Shingles count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.llm.components import components
from convlens.llm.shared import stored
from convlens.llm.words import LOWER, as_long, blocks, grams, mix, word_hashes, word_spans

REGISTERS, BAND, MANTISSA = 128, 4, 10
BANDS = REGISTERS // BAND
EMPTY = 0xFFFF
#: For each register the walk over registers that fills it when it is empty.
WALK = (mix(np.arange(REGISTERS * 512, dtype=np.uint64)) % np.uint64(REGISTERS)).astype(np.int64).reshape(REGISTERS, 512)
FULL = mix(np.array([7], np.uint64))[0]


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi, raw, off in blocks(column):
        raw = LOWER[raw]
        starts, ends, first = word_spans(raw, off)
        hashes = word_hashes(raw, starts, ends)
        all_grams = grams(hashes, k)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                yield np.unique(all_grams[a : b - k + 1])
            elif b > a:
                yield grams(hashes[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)


def registers(least: np.ndarray) -> np.ndarray:
    """Leading-zero count and mantissa of 64-bit values, as 16 bits."""
    top = (least >> np.uint64(11)).astype(np.float64)  # 53 bits are exact
    zeros = np.where(top > 0, 53 - np.frexp(top)[1], 53).astype(np.uint64)
    mantissa = ((least << zeros) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def sketch(shingles: np.ndarray) -> np.ndarray:
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if len(shingles):
        place = (shingles >> np.uint64(57)).astype(np.int64)
        new = np.flatnonzero(np.diff(place, prepend=-1))  # sorted, so the first in a register is its smallest
        out[place[new]] = registers(shingles[new] << np.uint64(7))
        empty = np.flatnonzero(out == EMPTY)
        if len(empty):
            full = out != EMPTY
            steps = full[WALK[empty]]
            out[empty] = np.where(steps.any(1), out[WALK[empty, steps.argmax(1)]], out[place[new[0]]])
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """[n, BANDS] 64-bit keys."""
    own = sketches.astype(np.uint64).reshape(len(sketches), BANDS, BAND)
    key = np.zeros(own.shape[:2], np.uint64)
    for i in range(BAND):
        key = (key << np.uint64(16)) | own[:, :, i]
    return mix(mix(key) + np.arange(1, BANDS + 1, dtype=np.uint64) * FULL)


def _octaves(n: np.ndarray) -> np.ndarray:
    """[40, n] how likely the minimum of n/128 uniform values falls in each octave."""
    n, z = np.maximum(n / REGISTERS, 1e-9), np.arange(40)[:, None]
    inner = (1 - 2.0 ** -(z + 1)) ** n
    return inner - np.where(z > 0, (1 - 2.0**-z) ** n, 0)


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """About how often registers of two disjoint sets of n and m elements are equal by chance.

    A minimum of n/128 uniform values falls in an octave with some probability; within it, one of 2^10 mantissas agrees.
    """
    return (_octaves(n) * _octaves(m)).sum(axis=0) / 2**MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of all pairs of two blocks of sketches."""
    equal = np.empty((len(a), len(b)), np.float32)
    for i in range(len(a)):  # equal registers are bytes of 1, added by eights; no sum goes beyond 128
        eights = (a[i] == b).view(np.uint64).sum(axis=1, dtype=np.uint64)
        equal[i] = (eights * np.uint64(0x0101010101010101)) >> np.uint64(56)
    equal /= REGISTERS
    chance = (_octaves(n).T @ _octaves(m) / 2**MANTISSA).astype(np.float32)
    return (equal - chance) / (1 - chance)


def forest(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (member, smallest member) that connect what ``near`` (a boolean [a, b] matrix) connects. A row is joined as a whole."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    top = np.arange(len(names))  # the smallest that a name is known to be connected with
    for i in np.flatnonzero(near.any(axis=1)):
        met, own = top[right[near[i]]], top[left[i]]
        if (met != own).any():
            joined = np.append(met, own)
            to = np.arange(len(names))
            to[joined] = joined.min()
            top = to[top]
    member = np.flatnonzero(top != np.arange(len(names)))
    return list(zip(names[member].tolist(), names[top[member]].tolist()))


def intersections(a: list[np.ndarray], b: list[np.ndarray], most: int = 1 << 24) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets: a product of 0/1 matrices over the shingles both sides have."""
    one, two = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(one, two)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(shared):
        return out
    step = max(1, most // (len(a) + len(b)) // 4)
    row_a, row_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    at_a, at_b = np.searchsorted(shared, one), np.searchsorted(shared, two)
    is_a = shared[np.minimum(at_a, len(shared) - 1)] == one
    is_b = shared[np.minimum(at_b, len(shared) - 1)] == two
    for lo in range(0, len(shared), step):
        left, right = (np.zeros((len(x), min(step, len(shared) - lo)), np.float32) for x in (a, b))
        for m, row, at, ok in ((left, row_a, at_a, is_a), (right, row_b, at_b, is_b)):
            mine = ok & (at >= lo) & (at < lo + step)
            m[row[mine], at[mine] - lo] = 1
        out += left @ right.T
    return out


def links_batch(found) -> pa.RecordBatch:
    found = sorted(found)
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], names=["a", "b"])


def sketch_documents(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, h1, h2 (128 bits that name the set), registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, regs = [], [], [], []
            for own in shingle_sets(batch.column(1), k):
                n.append(len(own))
                h1.append(own.sum(dtype=np.uint64))
                h2.append(mix(own + FULL).sum(dtype=np.uint64))
                regs.append(sketch(own).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(as_long(np.array(h1, np.uint64))), pa.array(as_long(np.array(h2, np.uint64))), pa.array(regs, pa.binary())],
                names=["doc_id", "n", "h1", "h2", "registers"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, registers binary")


def _suspects(classes: DataFrame, least: float, block: int, direct: int = 8) -> DataFrame:
    """Edges (a, b) of a forest over classes that share a band and look similar enough. classes: rep, n, registers."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            flat = as_long(np.ascontiguousarray(band_keys(regs)).reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(flat)], names=["rep", "key"])

    bands = classes.select("rep", "registers").mapInArrow(keys, "rep long, key long")
    crowded = stored(bands.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "bands")
    members = bands.join(crowded, "key")
    # A band's members are dealt to blocks of about `block`.
    count = F.ceil(F.col("members") / block).cast("int")
    dealt = members.withColumn("count", count).withColumn("own", F.pmod(F.xxhash64("rep", "key"), F.col("count")).cast("int"))
    slots = 1 << 20
    slot = F.pmod(F.xxhash64("key", "x", "y"), F.lit(slots)).alias("slot")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups lie in a row, sorted; the last of a batch waits for the next one. Pairs go all at once, other groups one by one."""

        def edges(ids: np.ndarray, rep: np.ndarray, n: np.ndarray, regs: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
            lo, hi = cuts[:-1], cuts[1:]
            own, found = ids[:, 3], []
            pairs = lo[(hi - lo == 2)]
            pairs = pairs[(ids[pairs, 1] == ids[pairs, 2]) | (own[pairs] != own[pairs + 1])]
            if len(pairs):
                chance = collision_rate(n[pairs], n[pairs + 1])
                ok = ((regs[pairs] == regs[pairs + 1]).mean(axis=1) - chance) / (1 - chance) >= least
                one, two = rep[pairs[ok]], rep[pairs[ok] + 1]
                found = np.stack([np.maximum(one, two), np.minimum(one, two)], axis=1).tolist()
            for a, b in zip(lo[hi - lo > 2], hi[hi - lo > 2]):
                x, y = ids[a, 1], ids[a, 2]
                left, right = (a + np.flatnonzero(own[a:b] == x), a + np.flatnonzero(own[a:b] == y)) if x != y else (np.arange(a, b),) * 2
                if len(left) and len(right):
                    found += forest(estimate(regs[left], regs[right], n[left], n[right]) >= least, rep[left], rep[right])
            return links_batch(set(map(tuple, found)))

        held = None
        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "x", "y", "own")], axis=1)
            regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            now = [ids, batch.column("rep").to_numpy(), batch.column("n").to_numpy().astype(np.float64), regs]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            cuts = np.flatnonzero((held[0][1:, :3] != held[0][:-1, :3]).any(1)) + 1
            if len(cuts):
                yield edges(*[x[: cuts[-1]] for x in held], np.concatenate([[0], cuts]))
                held = [x[cuts[-1] :] for x in held]
        if held is not None and len(held[0]):
            yield edges(*held, np.array([0, len(held[0])]))

    def edges_of(met: DataFrame) -> DataFrame:
        """met: rep, key, own, x, y: blocks x and y of a band meet."""
        told = met.join(classes.select("rep", "n", "registers"), "rep")
        laid = told.select("key", "x", "y", "own", "rep", "n", "registers", slot).repartition("slot").sortWithinPartitions("key", "x", "y")
        return laid.drop("slot").mapInArrow(near, "a long, b long").distinct()

    # Every block against all others where they are few, else against itself and the first.
    every = F.sequence(F.lit(0), F.col("count") - 1)
    others = F.when((F.col("own") == 0) | (F.col("count") <= direct), every).otherwise(F.array(F.lit(0), F.col("own")))
    pairs = dealt.select("rep", "key", "own", F.explode(others).alias("other"))
    first = stored(edges_of(pairs.select("rep", "key", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))), "suspects")
    if crowded.where(F.col("members") > direct * block).isEmpty():
        return first
    # What is outside the most frequent component of its band is then held against all its blocks.
    known = stored(components(first), "known")
    wide = dealt.where(F.col("count") > direct).join(known.select(F.col("node").alias("rep"), F.col("component").alias("name")), "rep", "left")
    wide = stored(wide.select("rep", "key", "own", "count", F.coalesce("name", "rep").alias("name")), "wide")
    top = wide.groupBy("key", "name").agg(F.count("*").alias("size")).groupBy("key").agg(F.max_by("name", F.struct("size", "name")).alias("top"))
    stray = stored(wide.join(top, "key").where(F.col("name") != F.col("top")).drop("top"), "stray")
    strays = stray.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("stray_blocks"))
    asked = stray.join(strays, "key").withColumn("mine", -1 - F.pmod(F.xxhash64("rep"), F.col("stray_blocks")).cast("int"))
    asked = asked.select("rep", "key", F.col("mine").alias("own"), F.col("mine").alias("x"), F.explode(F.expr("sequence(0, count - 1)")).alias("y"))
    answers = wide.join(strays, "key").select("rep", "key", "own", F.explode(F.expr("transform(sequence(1, stray_blocks), i -> -i)")).alias("x"), F.col("own").alias("y"))
    # What is known comes as stars, which components() is done with at once.
    return known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(edges_of(asked.union(answers)))


def _links(groups: DataFrame, docs: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """Edges (a, b) of a forest over confirmed links. groups: (node, component) of suspects; docs: (doc_id, h1, h2, text)."""
    sizes = stored(groups.groupBy("component").agg(F.count("*").alias("members")), "sizes")
    counted = groups.join(sizes, "component").select(
        "node", "component", F.ceil(F.col("members") / block).cast("int").alias("count")
    ).withColumn("own", F.pmod(F.xxhash64("node"), F.col("count")).cast("int"))
    placed = stored(counted, "groups")
    texts = stored(docs.join(placed.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), "texts")

    def confirm(pairs: DataFrame) -> DataFrame:
        """pairs: node, component, own, asks (bool), x, y: blocks x and y meet; rows that ask are held against all others."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            key = None

            def edges() -> list[tuple[int, int]]:
                rows = pa.Table.from_batches(held)
                names, own = rows.column("node").to_numpy(), rows.column("own").to_numpy()
                asks = rows.column("asks").to_numpy()
                sets = [s for c in rows.column("text").chunks for s in shingle_sets(c, k)]
                keep = {}
                for i, name in enumerate(names):  # a doc_id with several texts is one node, with all its sets
                    keep.setdefault((name, own[i], len(sets[i]), int(sets[i].sum(dtype=np.uint64))), i)
                pick = np.array(sorted(keep.values()))
                _, x, y = key
                a = pick if x == y else pick[(own[pick] == x)]
                b = pick if x == y else pick[(own[pick] == y)]
                a = a[asks[a]]
                if not len(a) or not len(b):
                    return []
                n, m = np.array([len(sets[i]) for i in a], np.float64), np.array([len(sets[i]) for i in b], np.float64)
                inner = intersections([sets[i] for i in a], [sets[i] for i in b]).astype(np.float64)
                return forest(100 * inner >= percent * (n[:, None] + m[None, :] - inner), names[a], names[b])

            for batch in batches:
                ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("component", "x", "y")], axis=1)
                cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1), len(ids)]
                found = []
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    if lo == hi:
                        continue
                    if held and tuple(ids[lo]) != key:
                        found += edges()
                        held = []
                    key = tuple(ids[lo])
                    held.append(batch.slice(lo, hi - lo))
                yield links_batch(found)
            if held:
                yield links_batch(edges())

        told = pairs.join(texts.select(F.col("doc_id").alias("node"), "text"), "node")
        laid = told.select("component", "x", "y", "node", "own", "asks", "text", F.xxhash64("component", "x", "y").alias("slot"))
        return laid.repartition("slot").sortWithinPartitions("component", "x", "y").drop("slot").mapInArrow(run, "a long, b long")

    met = lambda df, other: df.select("node", "component", "own", "asks", F.least("own", other).alias("x"), F.greatest("own", other).alias("y"))
    asking = placed.withColumn("asks", F.lit(True))
    # Every block against itself and against the first.
    first = met(asking, F.col("own")).union(met(asking.where("own > 0"), F.lit(0))).union(
        met(asking.where("count > 1 and own = 0").withColumn("other", F.explode(F.expr("sequence(1, count - 1)"))), F.col("other"))
    )
    links = stored(confirm(first), "confirmed")
    if not placed.where("count > 2").count():
        return links
    # What is outside the largest component of its group is then held against all blocks.
    wide = placed.where("count > 2")
    known = stored(components(links), "known")
    named = wide.join(known.select("node", F.col("component").alias("name")), "node", "left").withColumn("name", F.coalesce("name", "node"))
    top = named.groupBy("component", "name").agg(F.count("*").alias("size")).groupBy("component").agg(F.max_by("name", F.struct("size", "name")).alias("top"))
    marked = named.join(top, "component").withColumn("asks", F.col("name") != F.col("top")).drop("name", "top")
    stray = stored(marked.where("asks"), "stray")
    # A block of strays (numbered below zero) meets each block of its group.
    strays = stray.groupBy("component").agg(F.count("*").alias("strays"))
    rows = stray.join(strays, "component").withColumn("mine", -1 - F.pmod(F.xxhash64("node"), F.ceil(F.col("strays") / block)).cast("int"))
    asked = rows.select("node", "component", F.col("mine").alias("own"), "asks", F.col("mine").alias("x"), F.explode(F.expr("sequence(0, count - 1)")).alias("y"))
    met_blocks = strays.withColumn("mine", F.explode(F.expr(f"sequence(1, cast(ceil(strays / {block}) as int))")))
    answers = wide.join(met_blocks, "component").select(
        "node", "component", "own", F.lit(False).alias("asks"), (-F.col("mine")).cast("int").alias("x"), F.col("own").alias("y")
    )
    return known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(stored(confirm(asked.union(answers)), "confirmed"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, block: int = 256, direct: int = 8
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Links have 100 * intersection >= percent * union."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = stored(sketch_documents(rows, shingle), "sketches")
    some = sketched.where("n > 0 and doc_id is not null")
    # Copies: one row per distinct set, the smallest doc_id standing for all; counted on both sides of the shuffle.
    own = stored(some.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.first("registers").alias("registers")), "classes")
    deviation = math.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)
    suspects = _suspects(own, percent / 100 - 6 * deviation, 4 * block, direct)
    confirmed = _links(components(suspects), rows.where("doc_id is not null"), shingle, percent, block)
    # Rows of one doc_id with several sets link the classes of those sets.
    several = some.groupBy("doc_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("doc_id")
    same = some.join(several, "doc_id").join(own.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(confirmed.union(same)).select(F.col("node").alias("rep"), "component")
    named = own.join(found, "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component_id"))
    keys = [sketched[c] == named[c] for c in ("h1", "h2", "n")]
    joined = sketched.join(named, keys, "left").select(sketched["doc_id"], sketched["n"].alias("n_shingles"), "component_id")
    own_id = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return joined.withColumn("component_id", own_id).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` less near-duplicates, with all their columns: of each group the one with the smallest id stays.

    Every row counts for itself: equal rows and rows that share an id are copies if their texts are, rows without an id too
    (they go before those with one). Rows without words are no copies of each other.
    """
    row = next(name for name in (f"__row{i}" for i in range(len(docs.columns) + 1)) if name not in docs.columns)
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(keyed, row, text, shingle, percent).select(F.col("doc_id").alias("row"), "component_id")
    named = stored(found.join(keyed.select(F.col(row).alias("row"), F.col(doc_id).alias("id")), "row"), "named")
    best = named.groupBy("component_id").agg(F.count("*").alias("size"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")).where("size > 1")
    best = stored(best.select("component_id", F.col("first.row").alias("first")), "best")
    gone = named.join(best, "component_id").where("row <> first").select(F.col("row").alias(row))
    return keyed.join(gone, row, "left_anti").select(*docs.columns)
