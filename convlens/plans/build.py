"""A build of the two tables from several readers, which counts what it writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from convlens.operators import model
from convlens.sources import tables


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """``df`` that counts while it is read or written, by ``Observation``: no second scan. Take the counts after the first action over it."""
    own = Observation(name)
    return df.observe(own, *[c.alias(k) for k, c in counts.items()]), own


def build_tables(sources: dict[str, tuple[DataFrame, DataFrame]], columns: list[str], path: str) -> DataFrame:
    """Several readers' conversations and messages merged and written in one go, and the report of it: what was counted while they were written.

    sources: name to (heads, messages) as readers give them: heads (file, conv_id, columns), messages (id, conv_id, file, seq, kind, text, ...). Per source: files (that
    gave messages or metadata), conversations, merged (further heads of a conversation that is there already), messages, prose, duplicates, text_bytes and a reason
    where there are no rows. Sources are a short list by name; the counts of all are columns of three observations. What is ordered by range is
    sampled before it is written, so messages are counted behind that step.
    """
    names = list(sources)
    # A file's place among its conversation's files: the first one of each file counts it, so nothing distinct is gathered.
    first = Window.partitionBy("source", "file").orderBy("conv_id")
    heads = reduce(DataFrame.unionByName, [h.select("conv_id", "file", *columns).withColumn("source", F.lit(n)) for n, (h, _) in sources.items()])
    rows = reduce(DataFrame.unionByName, [m.withColumn("source", F.lit(n)) for n, (_, m) in sources.items()])
    one = lambda i, cond=None: (F.col("source") == names[i]) if cond is None else (F.col("source") == names[i]) & cond
    numbered = heads.withColumn("__n", F.row_number().over(first))
    seen, of_heads = observed(numbered, "heads", **{f"{k}_{i}": F.count_if(c) for i in range(len(names)) for k, c in (("files", one(i, F.col("__n") == 1)), ("objects", one(i)))})
    convs = model.merge_conversations(seen.drop("__n"), ["file"], [*columns, "source"], "conv_id")
    convs, of_convs = observed(convs, "conversations", **{f"conversations_{i}": F.count_if(one(i)) for i in range(len(names))})
    merged, of_rows = observed(
        tables.laid_out(model.merge_messages(rows, ["file", "seq"])), "messages",
        **{
            f"{k}_{i}": c
            for i in range(len(names))
            for k, c in (
                ("messages", F.count_if(one(i))), ("prose", F.count_if(one(i, F.col("kind") == "prose"))),
                ("duplicates", F.coalesce(F.sum(F.when(one(i), F.col("copies") - 1)), F.lit(0))), ("text_bytes", F.coalesce(F.sum(F.when(one(i), F.octet_length("text").cast("long"))), F.lit(0))),
            )
        },
    )
    tables.publish(convs.sparkSession, path, {"conversation": convs, "message": merged.drop("copies")})
    got = of_heads.get | of_convs.get | of_rows.get
    report = []
    for i, name in enumerate(names):
        n = {k: int(got[f"{k}_{i}"] or 0) for k in ("files", "objects", "conversations", "messages", "prose", "duplicates", "text_bytes")}
        report.append((name, n["files"], n["conversations"], n["objects"] - n["conversations"], n["messages"], n["prose"], n["duplicates"], n["text_bytes"], "ok" if n["messages"] else "no rows"))
    kinds = "source string, files long, conversations long, merged long, messages long, prose long, duplicates long, text_bytes long, reason string"
    return convs.sparkSession.createDataFrame(report, kinds)
