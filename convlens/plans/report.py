"""One report over a corpus: projects, lineages, sessions across sources, and topics, as (section, name, n)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.operators import projects, sittings

HOUR_MS = 3_600_000


def corpus_report(conversations: DataFrame, seeds: DataFrame) -> DataFrame:
    """conversations: id, source, cwd, ended_at, text. Each part is one aggregate of its own operator."""
    named = projects.project_of(conversations)
    own = projects.rollup(named).select(F.lit("project").alias("section"), F.col("project").alias("name"), "n")
    runs = sittings.lineages(named, "project", "ended_at", "id").groupBy("project").agg(F.count("*").alias("n")).select(F.lit("lineage"), "project", "n")
    lasting = sittings.bounded_sessions(named.where("project is not null"), ["project"], "ended_at", "id", 2 * HOUR_MS, 6 * HOUR_MS)
    crossed = lasting.where("items >= 3 and sources >= 2").groupBy("project").agg(F.count("*").alias("n")).select(F.lit("session"), "project", "n")
    topics = projects.topic_report(projects.topic_hits(conversations, seeds)).select(F.lit("topic"), "topic", F.col("members"))
    return reduce(DataFrame.union, [own, runs, crossed, topics])
