"""Secret scan with multipart credential linking, by DataFrame expressions alone.

Base kinds (assign, access, hex) are reported wherever their pattern matches. Weak candidates are reported only when
complementary parts stand near each other in one document, within ``scope`` code points:

* ``weak_secret`` - a string of 24 or more letters, digits, ``+/_-`` with letters and digits mixed; needs an access identifier
  or an endpoint in scope;
* ``weak_access`` - an upper-case identifier of 12 or more letters and digits; needs an access identifier's complement,
  that is a secret (assign, hex, or a weak secret apart from it) and an endpoint in scope;
* ``endpoint`` - an URL or a host name with port; needs an access identifier, a secret, or a weak identifier together with a
  weak secret apart from it, in scope.

The distance of two spans is from the end of one to the start of the other, 0 where they overlap. The interval join is an
equi-join on (document, bin of ``scope`` code points): a part stands in every bin from the one before its start to the one after
its end, and a candidate looks at the bins that it covers. So no document's parts are paired all with all.

Defined results: null text counts as empty; a null id stays null; rows that share an id are scanned each by itself;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.functions.arrays import running_max
from convlens.llm.shared import attach, stored
from convlens.llm.spans import NO_SPANS, chunked, in_order, laid_out, stretch, with_matches

# The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
# Patterns of the weak kinds.
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+(?![A-Za-z0-9+/_-])"
WEAK_ACCESS = r"(?<![A-Za-z0-9])[A-Z0-9]{12,}+(?![A-Za-z0-9])"
ENDPOINT = r"(?<![A-Za-z0-9])(?:https?://[A-Za-z0-9./_-]++|[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)++:[0-9]{2,5}+)"
BASE_KINDS = ["assign", "access", "hex"]
WEAK_KINDS = ["weak_secret", "weak_access", "endpoint"]


def _matches(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    hits = with_matches(
        docs.withColumn("row_key", F.xxhash64("text")),
        "text",
        {
            "assign": (ASSIGN, text.rlike("[:=]")),
            "access": (ACCESS, text.contains("AKIA")),
            "hex": (HEX, F.lit(True)),
            "weak_secret": (WEAK_SECRET, F.lit(True)),
            "weak_access": (WEAK_ACCESS, F.lit(True)),
            "endpoint": (ENDPOINT, text.rlike(r"://|:[0-9]")),
        },
    )
    value = lambda s: F.regexp_extract(s["text"], ASSIGN, 2)
    return hits.select(
        "doc_id",
        "row_key",
        laid_out(F.filter("assign", lambda s: F.length(value(s)) >= 8), "assign").alias("assign"),
        laid_out(F.filter("access", lambda s: F.length(s["text"]) >= 16), "access").alias("access"),
        laid_out(F.col("hex"), "hex").alias("hex"),
        laid_out(F.filter("weak_secret", lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]")), "weak_secret").alias("weak_secret"),
        laid_out(F.filter("weak_access", lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Z]") & ~s["text"].startswith("AKIA")), "weak_access").alias("weak_access"),
        laid_out(F.col("endpoint"), "endpoint").alias("endpoint"),
    )


def _linked(hits: DataFrame, scope: int) -> DataFrame:
    """(doc_id, row_key, linked array of spans) for rows with weak candidates whose complement is in scope."""
    weak = F.concat(*WEAK_KINDS)
    some = hits.where(F.size(weak) > 0)
    key = ["doc_id", "row_key"]
    parts = some.select(*key, F.explode(F.array_distinct(F.concat("assign", "access", "hex", *WEAK_KINDS))).alias("s")).select(*key, "s.start", "s.kind", "s.end")
    part = F.when(F.col("kind").isin("assign", "hex"), "secret").otherwise(F.col("kind"))
    covered = lambda more: F.explode(F.sequence(F.floor(F.col("start") / scope) - more, F.floor(F.col("end") / scope) + more))
    spread = parts.select(*key, covered(1).alias("bin"), part.alias("part"), F.struct("start", "end").alias("place"))
    by_bin = spread.groupBy(*key, "bin").agg(*[F.collect_set(F.when(F.col("part") == p, F.col("place"))).alias(f"near_{p}") for p in ("access", "secret", *WEAK_KINDS)])
    candidates = parts.where(F.col("kind").isin(*WEAK_KINDS)).withColumn("bin", covered(0))
    apart = lambda x: F.greatest(x["start"] - F.col("end"), F.col("start") - x["end"])
    near = lambda p: F.bool_or(F.coalesce(F.exists(f"near_{p}", lambda x: apart(x) <= scope), F.lit(False))).alias(p)
    # Of the weak parts in scope and apart from the candidate, the first end and the last start: two of them are apart if one's ends before the other's starts.
    beside = lambda p: F.filter(f"near_{p}", lambda x: (apart(x) >= 0) & (apart(x) <= scope))
    first_end = lambda p: F.min(F.array_min(F.transform(beside(p), lambda x: x["end"]))).alias(f"{p}_end")
    last_start = lambda p: F.max(F.array_max(F.transform(beside(p), lambda x: x["start"]))).alias(f"{p}_start")
    seen = attach(candidates, by_bin, *key, "bin").groupBy(*key, "start", "kind", "end").agg(
        near("access"), near("secret"), near("endpoint").alias("beside_endpoint"), *[f(p) for p in ("weak_secret", "weak_access") for f in (first_end, last_start)]
    )
    both = (F.col("weak_secret_end") <= F.col("weak_access_start")) | (F.col("weak_access_end") <= F.col("weak_secret_start"))
    rule = (
        ((F.col("kind") == "weak_secret") & (F.col("access") | F.col("beside_endpoint")))
        | ((F.col("kind") == "weak_access") & (F.col("secret") | F.col("weak_secret_end").isNotNull()) & F.col("beside_endpoint"))
        | ((F.col("kind") == "endpoint") & (F.col("access") | F.col("secret") | both))
    )
    kept = seen.where(rule).select(*key, F.struct("start", "kind", "end").alias("s"))
    return kept.groupBy(*key).agg(F.collect_set("s").alias("linked"))


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = 256) -> DataFrame:
    """One row per document: doc_id, row_key, base and linked spans (array<struct<start,kind,end>>) sorted by start, then kind."""
    clean = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hits = stored(_matches(clean), "secrets")  # spans alone, so that patterns run once
    linked = _linked(hits, scope)
    joined = attach(hits, linked, "doc_id", "row_key").withColumn("linked", F.coalesce("linked", NO_SPANS()))
    return joined.select(
        "doc_id",
        "row_key",
        in_order(F.concat("assign", "access", "hex"), BASE_KINDS).alias("base"),
        in_order(F.concat("assign", "access", "hex", "linked"), BASE_KINDS + WEAK_KINDS).alias("spans"),
    )


def redact(docs: DataFrame, scanned: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``[kind]``; overlapping spans melt into the first. Columns stay as they are."""
    rows = docs.withColumn("__doc_id", F.col(doc_id)).withColumn("__row_key", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    spans = scanned.where(F.size("spans") > 0).select(F.col("doc_id").alias("__doc_id"), F.col("row_key").alias("__row_key"), F.col("spans").alias("__spans"))
    joined = attach(rows, spans.dropDuplicates(["__doc_id", "__row_key"]), "__doc_id", "__row_key")
    # Where the spans before one end at the latest: it is kept if it begins there or later, and what stands between is text.
    told = joined.withColumn("__ends", F.transform("__spans", lambda x: x["end"])).withColumn("__chunks", F.when(F.col("__spans").isNotNull(), chunked(F.col(text))))
    told = told.withColumn("__before", running_max("__ends"))
    laid = F.zip_with("__spans", "__before", lambda x, m: F.struct(m.alias("after"), x["start"].alias("start"), x["kind"].alias("kind")))
    told = told.withColumn("__laid", F.filter(laid, lambda x: x["start"] >= x["after"]))
    marked = F.transform("__laid", lambda x: F.concat(stretch("__chunks", x["after"], x["start"]), F.lit("["), x["kind"], F.lit("]")))
    last = stretch("__chunks", F.array_max("__ends"), F.length(text))
    return told.withColumn(text, F.when(F.col("__spans").isNotNull(), F.concat(F.array_join(marked, ""), last)).otherwise(F.col(text))).select(*docs.columns)
