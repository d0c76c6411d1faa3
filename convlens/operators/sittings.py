"""Records close in time read as one sitting, and other splits of a timeline at its gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlens.lineage import stored

SITTING_GAP_MS = 30 * 60_000
SPAN_MS = 7 * 86_400_000


def gap_islands(rows: DataFrame, keys: list[str], at: str, tie: str, gap_ms: int, inclusive: bool = True) -> DataFrame:
    """rows with ``island`` (1, 2, ... within keys): a new one begins without a predecessor or after a gap (>=, or > if not inclusive).

    Undated rows have a null island. Keys are as fine as the caller's groups; see gap_islands_wide for groups beyond one task.
    """
    w = Window.partitionBy(*keys).orderBy(at, tie)
    gap = F.col(at) - F.lag(at).over(w)
    opens = F.when(gap.isNull() | (gap >= gap_ms if inclusive else gap > gap_ms), 1).otherwise(0)
    dated = rows.where(F.col(at).isNotNull()).withColumn("__opens", opens).withColumn("island", F.sum("__opens").over(w)).drop("__opens")
    return dated.unionByName(rows.where(F.col(at).isNull()).withColumn("island", F.lit(None).cast("long")))


def gap_islands_wide(rows: DataFrame, keys: list[str], at: str, tie: str, gap_ms: int, span_ms: int = SPAN_MS, inclusive: bool = True) -> DataFrame:
    """As gap_islands, where one key may hold a third of the log: windows run within (keys, span of time), and only the first
    and last instant and the number of openings of each span are compared across spans. Undated rows have a null island here too."""
    apart = (lambda gap: gap >= gap_ms) if inclusive else (lambda gap: gap > gap_ms)
    spanned = rows.where(F.col(at).isNotNull()).withColumn("__span", F.floor(F.col(at) / span_ms))
    inner = Window.partitionBy(*keys, "__span").orderBy(at, tie)
    gap = F.col(at) - F.lag(at).over(inner)
    marked = spanned.withColumn("__opens", F.when(apart(gap), 1).otherwise(0)).withColumn("__inner", F.sum("__opens").over(inner))
    spans = marked.groupBy(*keys, "__span").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.sum("__opens").alias("opens"))
    outer = Window.partitionBy(*keys).orderBy("__span")
    between = F.col("lo") - F.lag("hi").over(outer)
    first = F.when(between.isNull() | apart(between), 1).otherwise(0)
    started = spans.withColumn("first", first)
    before = F.coalesce(F.sum(F.col("first") + F.col("opens")).over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = started.select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.col("__span").alias("__at"), (before + F.col("first")).alias("__base"))
    on = marked["__span"] == carried["__at"]
    for k in keys:  # a null key is a key
        on = on & marked[k].eqNullSafe(carried[f"__key_{k}"])
    dated = marked.join(carried, on).withColumn("island", F.col("__base") + F.col("__inner")).select(*rows.columns, "island")
    return dated.unionByName(rows.where(F.col(at).isNull()).withColumn("island", F.lit(None).cast("long")))


def result_runs(found: DataFrame, dated: DataFrame, gap_ms: int = 12 * 3_600_000) -> DataFrame:
    """(qid, run, started, ended, rows, sources, crossed): a query's results in runs without a gap, newest run first; undated ones are run null.

    found: (qid, row_id); dated: (id, ended_at, source). A run that has several sources has crossed.
    """
    rows = found.join(dated.select(F.col("id").alias("row_id"), "ended_at", "source"), "row_id").select("qid", "row_id", "ended_at", "source")
    islands = gap_islands_wide(rows, ["qid"], "ended_at", "row_id", gap_ms)
    newest = islands.groupBy("qid").agg(F.max("island").alias("last"))
    counted = islands.groupBy("qid", "island").agg(F.min("ended_at").alias("started"), F.max("ended_at").alias("ended"), F.count("*").alias("rows"), F.countDistinct("source").alias("sources"))
    return counted.join(newest, "qid").select("qid", (F.col("last") - F.col("island") + 1).alias("run"), "started", "ended", "rows", "sources", (F.col("sources") > 1).alias("crossed"))


def build(
    records: DataFrame, keys: list[str], at: str = "ended_at", tie: str = "id", gap_ms: int = SITTING_GAP_MS, weights: str = "msg_count", span_ms: int = SPAN_MS, allow: DataFrame | None = None,
) -> DataFrame:
    """Members of sittings of two or more: keys, id, sitting_id (its opener), members, position, message_offset.

    allow: keys whose records are folded at all, as (source, surface); all by default. Places and sums have two levels: each (keys,
    island, span of time) is counted within itself, and the counts of a span are added to those after it, of which there is one row each.
    """
    if allow is not None:
        known = allow.select(*[F.col(c).alias(f"__{c}") for c in allow.columns]).distinct()
        same = [records[c].eqNullSafe(known[f"__{c}"]) for c in allow.columns]
        records = records.join(known, same, "left_semi")
    islands = stored(gap_islands_wide(records, keys, at, tie, gap_ms, span_ms).where("island is not null").select(*keys, "id", at, *({tie} - {"id", at}), weights, "island"), "islands")
    spanned = islands.withColumn("__span", F.floor(F.col(at) / span_ms))
    part = [*keys, "island", "__span"]
    sums = spanned.groupBy(*part).agg(F.count("*").alias("n"), F.sum(weights).alias("weight"), F.min_by("id", F.struct(at, tie)).alias("first"))
    whole = Window.partitionBy(*keys, "island")
    earlier = whole.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        *[F.col(k).alias(f"__key_{k}") for k in part],
        F.sum("n").over(whole).alias("members"),
        F.first("first").over(whole.orderBy("__span")).alias("sitting_id"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__placed"),
        F.coalesce(F.sum("weight").over(earlier), F.lit(0)).alias("__told"),
    ).where("members > 1")
    inner = Window.partitionBy(*part).orderBy(at, tie)
    own = spanned.withColumn("__n", F.row_number().over(inner)).withColumn("__sum", F.coalesce(F.sum(weights).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    on = [own[k].eqNullSafe(carried[f"__key_{k}"]) for k in part]
    return own.join(carried, on).select(
        *keys, "id", at, weights, "sitting_id", "members", (F.col("__placed") + F.col("__n")).cast("int").alias("position"), (F.col("__told") + F.col("__sum")).alias("message_offset")
    )


def resolve(members: DataFrame, asked: DataFrame, key: str = "id") -> DataFrame:
    """asked (id) with ``sitting_id`` and its records: any member leads to its sitting, what is in none to itself. key, sitting_id, member, position."""
    own = asked.select(key).distinct().join(members.select(F.col("id").alias(key), "sitting_id"), key, "left").withColumn("sitting_id", F.coalesce("sitting_id", key))
    each = members.select("sitting_id", F.col("id").alias("member"), "position")
    return own.join(each, "sitting_id", "left").select(key, "sitting_id", F.coalesce("member", key).alias("member"), F.coalesce("position", F.lit(1)).alias("position"))


def totals(members: DataFrame, at: str = "ended_at", weights: str = "msg_count") -> DataFrame:
    return members.groupBy("sitting_id").agg(F.max(at).alias(at), F.sum(weights).alias(weights), F.count("*").alias("members"))


def attach(records: DataFrame, members: DataFrame, key: str = "id") -> DataFrame:
    """group_id: the sitting, or the record itself; message_offset 0 outside sittings; opens: whether it stands for its group."""
    own = members.select(F.col("id").alias(key), "sitting_id", "message_offset")
    joined = records.join(own, key, "left")
    return joined.select(
        *records.columns, F.coalesce("sitting_id", key).alias("group_id"), F.coalesce("message_offset", F.lit(0)).alias("message_offset"),
        (F.coalesce("sitting_id", key) == F.col(key)).alias("opens"),
    )


def bounded_sessions(rows: DataFrame, keys: list[str], at: str, tie: str, gap_ms: int, span_ms: int, source: str = "source") -> DataFrame:
    """Sessions that end after a gap above gap_ms or beyond span_ms from their start: keys, session start, end, items, sources.

    Rows of one instant share a session, so ``tie`` decides nothing. Windows run within (keys, span of time). Each instant points
    to the first one beyond its span, if no gap comes before; the starts are what can be reached from the instants after gaps,
    found by jumping, and each row falls to the last start before it.
    """
    counted = rows.where(F.col(at).isNotNull()).groupBy(F.struct(*keys).alias("__key"), F.col(at).alias("at"), F.col(source).alias("source")).agg(F.count("*").alias("n"))
    each = stored(counted.withColumn("__span", F.floor(F.col("at") / span_ms)), "instants")
    instants = each.select("__key", "__span", "at").distinct()
    # The edges of spans alone are compared across spans.
    edges = instants.groupBy("__key", "__span").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    across = Window.partitionBy("__key").orderBy("__span")
    edges = stored(edges.select("__key", "__span", "lo", F.lag("hi").over(across).alias("before"), F.lead("lo").over(across).alias("after"), F.lead("__span").over(across).alias("next_span")), "edges")
    inner = Window.partitionBy("__key", "__span").orderBy("at")
    since = F.col("at") - F.coalesce(F.lag("at").over(inner), F.col("before"))
    opened = instants.join(edges.select("__key", "__span", "before"), ["__key", "__span"]).withColumn("opens", since.isNull() | (since > gap_ms)).drop("before")
    opened = stored(opened, "opened")
    # The first instant beyond at + span_ms lies in the span after the instant's own, or is the first of the next span that has any.
    probes = opened.select("__key", (F.col("__span") + 1).alias("__span"), (F.col("at") + span_ms).alias("place"), F.lit(0).alias("own"), F.col("at").alias("asks"), F.lit(None).cast("long").alias("at"))
    placed = opened.select("__key", "__span", F.col("at").alias("place"), F.lit(1).alias("own"), F.lit(None).cast("long").alias("asks"), "at")
    later = Window.partitionBy("__key", "__span").orderBy(F.desc("place"), "own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = probes.union(placed).withColumn("next", F.last("at", ignorenulls=True).over(later)).where("own = 0").select("__key", (F.col("__span") - 1).alias("__span"), F.col("asks").alias("at"), "next")
    # Behind the next span at once: the first of the first span after it.
    ahead = edges.select("__key", "__span", "after", "next_span").join(
        edges.select("__key", F.col("__span").alias("next_span"), F.col("after").alias("after_next")), ["__key", "next_span"], "left"
    )
    far = F.when(F.col("next_span") > F.col("__span") + 1, F.col("after")).otherwise(F.col("after_next"))
    pointed = beyond.join(ahead, ["__key", "__span"], "left").select("__key", "at", F.coalesce("next", far).alias("next"))
    # What opens after a gap starts a session in any case, and ends the walk from before it.
    islands = _starts_of_islands(opened)
    known = pointed.where("next is not null").join(islands, ["__key", "at"])
    jumps = stored(known.join(islands.select("__key", F.col("at").alias("next"), F.col("island").alias("there")), ["__key", "next"]).where("island = there").select("__key", "at", "next"), "jumps")
    starts = stored(opened.where("opens").select("__key", "at"), "starts")
    while not jumps.isEmpty():
        starts = stored(starts.union(starts.join(jumps, ["__key", "at"]).select("__key", F.col("next").alias("at"))).distinct(), "starts")
        jumps = stored(jumps.join(jumps.select("__key", F.col("at").alias("next"), F.col("next").alias("far")), ["__key", "next"]).select("__key", "at", F.col("far").alias("next")), "jumps")
    # A row's start lies in its own span or the one before.
    own_span = F.floor(F.col("at") / span_ms)
    begun = starts.select("__key", F.explode(F.array(own_span, own_span + 1)).alias("__span"), "at", F.col("at").alias("started"), F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("n"))
    last = Window.partitionBy("__key", "__span").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = begun.unionByName(each.withColumn("started", F.lit(None).cast("long"))).withColumn("started", F.last("started", ignorenulls=True).over(last)).where("n > 0")
    out = told.groupBy("__key", "started").agg(F.max("at").alias("ended"), F.sum("n").alias("items"), F.countDistinct("source").alias("sources"))
    return out.select(*[F.col("__key")[k].alias(k) for k in keys], "started", "ended", "items", "sources")


def _starts_of_islands(opened: DataFrame) -> DataFrame:
    """__key, at, island: the instant that opened the run without a gap, carried over spans by one row for each."""
    first = F.when(F.col("opens"), F.col("at"))
    latest = opened.groupBy("__key", "__span").agg(F.max(first).alias("latest"))
    before = Window.partitionBy("__key").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select("__key", "__span", F.last("latest", ignorenulls=True).over(before).alias("carried"))
    inner = Window.partitionBy("__key", "__span").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return opened.join(carried, ["__key", "__span"]).select("__key", "at", F.coalesce(F.last(first, ignorenulls=True).over(inner), F.col("carried")).alias("island"))


def lineages(rows: DataFrame, key: str, at: str, tie: str, gap_ms: int = 3 * 86_400_000, least: int = 2) -> DataFrame:
    """Runs of one directory without a gap above three days: key, started, ended, size."""
    islands = gap_islands_wide(rows.where(F.col(key).isNotNull()), [key], at, tie, gap_ms, inclusive=False).where("island is not null")
    return islands.groupBy(key, "island").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("size")).where(F.col("size") >= least)


def top(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return rows.orderBy(*order).limit(n)
