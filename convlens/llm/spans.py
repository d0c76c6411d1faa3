"""Places of pattern matches as Spark columns: arrays of (start, end) in code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens.functions.arrays import running

def NO_SPANS() -> Column:
    return F.expr("cast(array() as array<struct<start:int,kind:string,end:int>>)")


def with_matches(rows: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """``rows`` with a column for each name: array<struct<start,end,text>> of the leftmost non-overlapping matches, in code points.

    patterns: name to (pattern, guard); where the guard is false the array is empty. Matches and the pieces between them
    alternate, so their running lengths are the places. Each step is a projection of its own, so that no pattern runs twice.
    """
    none = F.expr("cast(array() as array<string>)")
    own, cut = list(rows.columns), rows
    cut = cut.select(
        *own,
        *[F.when(guard, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"__hits_{n}") for n, (p, guard) in patterns.items()],
    )
    cut = cut.select(
        "*", *[F.when(F.size(f"__hits_{n}") > 0, F.slice(F.split(text, p), 1, F.size(f"__hits_{n}"))).otherwise(none).alias(f"__pieces_{n}") for n, (p, _) in patterns.items()]
    )
    cut = cut.select(
        *own,
        *[
            F.zip_with(f"__pieces_{n}", f"__hits_{n}", lambda p, h: F.struct(F.length(p).alias("skip"), F.length(h).alias("take"), h.alias("text"))).alias(f"__laid_{n}")
            for n in patterns
        ],
    )
    cut = cut.select("*", *[F.transform(f"__laid_{n}", lambda x: x["skip"] + x["take"]).alias(f"__size_{n}") for n in patterns])
    cut = cut.select("*", *[running(f"__size_{n}").alias(f"__at_{n}") for n in patterns])
    place = lambda x, at: F.struct((at + x["skip"]).alias("start"), (at + x["skip"] + x["take"]).alias("end"), x["text"].alias("text"))
    return cut.select(*own, *[F.zip_with(f"__laid_{n}", f"__at_{n}", place).alias(n) for n in patterns])


def laid_out(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def in_order(spans: Column, kinds: list[str], kind_first: bool = False) -> Column:
    """Spans by start, then kind as listed; or by kind as listed, then start."""
    place = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    rank = lambda s: F.element_at(place, s["kind"])
    key = lambda s: F.struct(rank(s).alias("a"), s["start"].alias("b")) if kind_first else F.struct(s["start"].alias("a"), rank(s).alias("b"))
    keyed = F.transform(spans, lambda s: F.struct(key(s).alias("key"), s["end"].alias("end"), s["kind"].alias("kind"), s["start"].alias("start")))
    return F.transform(
        F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    )


def spans_text(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


CHUNK = 1024


def chunked(text: Column) -> Column:
    """The text in chunks of ``CHUNK`` code points, so that a stretch of it is found without counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def stretch(chunks: str, start: Column, end: Column) -> Column:
    """Code points start to end, exclusive, of a text whose chunks are a column; it is named twice here, so it stays a step of its own."""
    first = F.floor(start / CHUNK).cast("int")
    some = F.slice(chunks, first + 1, F.least(F.greatest(F.floor((end - 1) / CHUNK).cast("int") - first + 1, F.lit(1)), F.size(chunks)))
    return F.when(end > start, F.substring(F.array_join(some, ""), start - first * CHUNK + 1, end - start)).otherwise("")
