"""Filters of conversations by source, directory and civil dates, and civil time itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def by_source(include: list[str], exclude: list[str], source: str = "source") -> Column:
    """Included sources united, excluded ones gone; no include means all."""
    return (F.col(source).isin(include) if include else F.lit(True)) & ~(F.col(source).isin(exclude) if exclude else F.lit(False))


def by_substring(include: list[str], exclude: list[str], column: str = "cwd") -> Column:
    """Literal, case-insensitive: any include, no exclude. A null fails an include and passes an exclude."""
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    some = reduce(lambda a, b: a | b, [low.contains(x.lower()) for x in include]) if include else F.lit(True)
    none = reduce(lambda a, b: a | b, [low.contains(x.lower()) for x in exclude]) if exclude else F.lit(False)
    return some & ~none


def inside(window: tuple[int | None, int | None], at: str = "ended_at") -> Column:
    """Half-open [from, until); an undated row is not inside."""
    low, high = window
    out = F.col(at).isNotNull()
    out = out & (F.col(at) >= low) if low is not None else out
    out = out & (F.col(at) < high) if high is not None else out
    return F.coalesce(out, F.lit(False))


def by_windows(windows: list[tuple[int | None, int | None, bool]], at: str = "ended_at") -> Column:
    """All windows hold; a negated one holds where the instant is not inside, so for undated rows too."""
    return reduce(lambda a, b: a & b, [~inside(w[:2], at) if w[2] else inside(w[:2], at) for w in windows], F.lit(True))


# --- civil time -----------------------------------------------------------------------------------------------------


def to_instant(local: Column, tz: str) -> Column:
    """Epoch ms of a local timestamp. Of two instants the earlier; a time the clock skips gives the first minute after the gap."""
    utc = F.to_utc_timestamp(local, tz)
    back = F.from_utc_timestamp(utc, tz)
    # In a gap the way back lands later by the width of the gap: the gap ends at the last civil minute that comes back unmoved.
    steps = F.transform(F.sequence(F.lit(1), F.lit(180)), lambda m: F.timestamp_add("MINUTE", m, local))
    first = F.try_element_at(F.filter(steps, lambda t: F.from_utc_timestamp(F.to_utc_timestamp(t, tz), tz) == t), F.lit(1))
    return F.unix_millis(F.when(back == local, utc).otherwise(F.to_utc_timestamp(F.date_trunc("minute", first), tz)))


def local_time(ms: Column, tz: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(ms), tz)


def day_start(ms: Column, tz: str) -> Column:
    return to_instant(F.date_trunc("day", local_time(ms, tz)), tz)


def civil_date(ms: Column, tz: str) -> Column:
    return F.date_format(local_time(ms, tz), "yyyy-MM-dd")


def shift_days(ms: Column, days: Column, tz: str) -> Column:
    return to_instant(F.timestamp_add("DAY", days, local_time(ms, tz)), tz)


def shift_months(ms: Column, months: Column, tz: str) -> Column:
    """The wall clock stays; the day of the month is clamped."""
    return to_instant(F.timestamp_add("MONTH", months, local_time(ms, tz)), tz)


def resolve_windows(specs: DataFrame, now_ms: int, tz: str) -> DataFrame:
    """Date specs to windows. specs: spec string ('day:N', 'younger:AGE', 'older:AGE', 'YYYY-MM-DD', 'A..B' with either end
    open); AGE is a number and m, h (durations), d, w, mo or y (civil steps). Adds from_ms, until_ms, rejected."""
    now = F.lit(now_ms).cast("long")
    part = lambda group: F.regexp_extract("spec", r"^(day|younger|older):(\d+)(mo|[mhdwy]?)$", group)
    kind, unit = part(1), part(3)
    n = F.expr(r"try_cast(regexp_extract(spec, '^(day|younger|older):(\\d+)(mo|[mhdwy]?)$', 2) as int)")
    ago = (
        F.when(unit == "m", now - n.cast("long") * 60_000)
        .when(unit == "h", now - n.cast("long") * 3_600_000)
        .when(unit.isin("d", "w"), shift_days(now, -n * F.when(unit == "w", 7).otherwise(1), tz))
        .when(unit.isin("mo", "y"), shift_months(now, -n * F.when(unit == "y", 12).otherwise(1), tz))
    )
    that_day = shift_days(day_start(now, tz), -n, tz)
    end = lambda i: F.nullif(F.regexp_extract("spec", r"^(\d{4}-\d{2}-\d{2})?\.\.(\d{4}-\d{2}-\d{2})?$", i), F.lit(""))
    midnight = lambda text: to_instant(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), tz)
    lone = F.nullif(F.regexp_extract("spec", r"^(\d{4}-\d{2}-\d{2})$", 1), F.lit(""))
    from_ms = F.when((kind == "day") & (unit == ""), that_day).when(kind == "younger", ago).when(lone.isNotNull(), midnight(lone)).otherwise(midnight(end(1)))
    until = (
        F.when((kind == "day") & (unit == ""), shift_days(that_day, F.lit(1), tz))
        .when(kind == "older", ago)
        .when(lone.isNotNull(), shift_days(midnight(lone), F.lit(1), tz))
        .otherwise(midnight(end(2)))
    )
    out = specs.withColumn("from_ms", from_ms).withColumn("until_ms", until)
    empty = F.col("from_ms").isNull() & F.col("until_ms").isNull()
    return out.withColumn("rejected", empty | F.coalesce(F.col("until_ms") <= F.col("from_ms"), F.lit(False)))


def window_text(from_ms: Column, until_ms: Column, tz: str) -> Column:
    """'from..until': a date at midnight, else date and time; ends rounded outwards to seconds, an open end empty."""

    def side(ms: Column) -> Column:
        t = local_time(ms, tz)
        return F.coalesce(F.when(F.date_trunc("day", t) == t, F.date_format(t, "yyyy-MM-dd")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")), F.lit(""))

    return F.concat(side(F.floor(from_ms / 1000) * 1000), F.lit(".."), side(F.ceil(until_ms / 1000) * 1000))
