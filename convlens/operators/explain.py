"""Why a conversation was not returned for a query, for many pairs in one job."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlens.lineage import stored
from convlens.plans.search import DECAY, best_first, decayed

MOST = 500  # places of the ranker that an explanation looks at
BUCKET = 1024  # queries, about, that are numbered together
WORDS = 4  # of 64 bits, at least, in a cell: with two terms a query, 128 queries that meet a conversation in one row
CELL = ("bucket", "room", "part")  # what names a cell of queries


def _placed(matches: DataFrame, messages: DataFrame, now_ms: int, most: int, decay: float) -> DataFrame:
    """The first ``most`` messages of each query by decayed score, off-path ones too. The window is by query, and Spark keeps ``most`` rows of each before it shuffles."""
    placed = matches.join(messages.select(F.col("id").alias("msg_id"), "conv_id", "ts_ms"), "msg_id").withColumn("score", decayed(F.col("score"), F.col("ts_ms"), now_ms, decay))
    return placed.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(best_first(), "msg_id"))).where(F.col("rank") <= most)


def _best(placed: DataFrame) -> DataFrame:
    return placed.groupBy("qid", "conv_id").agg(F.min("rank").alias("rank"), F.min("score").alias("score"))


def best_ranks(pairs: DataFrame, matches: DataFrame, messages: DataFrame, now_ms: int, most: int = MOST, decay: float = DECAY) -> DataFrame:
    """(qid, conv_id, rank, score): the best place of a conversation's messages among the first ``most`` of the query."""
    return _best(_placed(matches, messages, now_ms, most, decay).join(pairs.select("qid", "conv_id").distinct(), ["qid", "conv_id"], "left_semi"))


def term_hits(pairs: DataFrame, queries: DataFrame, messages: DataFrame) -> DataFrame:
    """(qid, conv_id, term, indexed, unindexed): in how many messages of a conversation each term of a query stands, in prose and in the kind without postings.

    A text is searched once for a term, however many queries ask: counts are of (conv_id, term), and joined back to the pairs.
    """
    terms = queries.select("qid", F.explode(F.array_distinct("terms")).alias("term"))
    texts = messages.where(F.col("kind").isin("prose", "reasoning")).select("conv_id", "kind", F.lower("text").alias("low"))
    asked = pairs.select("qid", "conv_id").distinct().join(terms, "qid")
    held = asked.select("conv_id", "term").distinct().join(texts, "conv_id").where(F.col("low").contains(F.col("term"))).groupBy("conv_id", "term").agg(
        F.count_if(F.col("kind") == "prose").alias("indexed"), F.count_if(F.col("kind") == "reasoning").alias("unindexed")
    )
    return asked.join(held, ["conv_id", "term"], "left").select("qid", "conv_id", "term", _zero("indexed"), _zero("unindexed"))


def _zero(c: str) -> Column:
    return F.coalesce(c, F.lit(0)).alias(c)


def _counts(messages: DataFrame) -> DataFrame:
    indexed = F.col("kind").isin("prose", "tool_call", "tool_result")
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.count_if(F.col("kind") == "prose").alias("prose"), F.count_if(indexed).alias("indexed"), F.count_if(~F.col("on_head_path")).alias("off_path")
    )


def _verdicts(out: DataFrame) -> DataFrame:
    """The first verdict that holds for each row."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    verdict = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("passes").isNull(), "filtered out")
        .when(zero("prose") == 0, "no indexed prose")
        .when(F.col("mode") != "searchable", "filters only")
        .when((zero("terms_any") > 0) & (zero("terms_indexed") == 0), "only in unindexed kind")
        .when(zero("terms_any") == 0, "no term anywhere")
        .when(F.col("best").isNull(), "present but unmatched")
        .when(zero("off_path") > 0, "ranked, off path too")
        .otherwise("ranked")
    )
    return out.select("qid", "conv_id", _zero("messages"), _zero("prose"), _zero("indexed"), _zero("off_path"), _zero("terms_any"), "best_rank", "best", verdict.alias("verdict"))


def run(
    pairs: DataFrame, queries: DataFrame, conversations: DataFrame, messages: DataFrame, matches: DataFrame, kept: DataFrame, now_ms: int, most: int = MOST, decay: float = DECAY,
) -> DataFrame:
    """pairs (qid, conv_id) with counts, the best place and score, and a verdict, the first that holds.

    queries: prepared; matches: (qid, msg_id, score), undecayed, off-path included; kept: (qid, conv_id) that pass the filters. terms_any: terms that
    stand in prose or in the kind without postings. A conversation beyond the first ``most`` messages of a query is unmatched.
    """
    known = conversations.select(F.col("id").alias("conv_id"), F.lit(True).alias("found"))
    counts = _counts(messages.join(pairs.select("conv_id").distinct(), "conv_id", "left_semi"))
    hits = term_hits(pairs, queries, messages).groupBy("qid", "conv_id").agg(
        F.count_if(F.col("indexed") > 0).alias("terms_indexed"), F.count_if(F.col("indexed") + F.col("unindexed") > 0).alias("terms_any")
    )
    best = best_ranks(pairs, matches, messages, now_ms, most, decay).select("qid", "conv_id", F.col("rank").alias("best_rank"), F.col("score").alias("best"))
    out = (
        pairs.join(known, "conv_id", "left").join(counts, "conv_id", "left").join(queries.select("qid", "mode"), "qid", "left")
        .join(hits, ["qid", "conv_id"], "left").join(best, ["qid", "conv_id"], "left").join(kept.select("qid", "conv_id", F.lit(True).alias("passes")), ["qid", "conv_id"], "left")
    )
    return _verdicts(out)


def _dealt(queries: DataFrame) -> tuple[DataFrame, int, int]:
    """(qid, mode, terms, slots) and the cell of each query; how many buckets there are, and words of 64 bits in a cell.

    A cell has a bit for each term of its queries, repeated or not: ``WORDS`` words of them, or as many as the longest query needs. Queries of about as many
    terms lie together, the number rounded up to a power of two, so a long one takes no room from the others.
    """
    own = queries.select("qid", "mode", F.array_distinct("terms").alias("terms"))
    count, most = own.agg(F.count("*"), F.max(F.size("terms"))).first()
    words = max(WORDS, -(-(most or 0) // 64))
    bits = 64 * words
    room = F.coalesce(*[F.when(F.size("terms") <= n, n) for n in (*(2**i for i in range(bits.bit_length() - 1)), bits)])
    buckets = count // BUCKET + 1
    placed = own.withColumn("room", room).withColumn("bucket", F.pmod(F.xxhash64("qid"), F.lit(buckets)).cast("int"))
    n, each = F.col("n"), F.floor(F.lit(bits) / F.col("room"))
    placed = placed.withColumn("n", F.row_number().over(Window.partitionBy("bucket", "room").orderBy("qid")) - 1).withColumn("part", F.floor(n / each).cast("int"))
    first = (n % each * F.col("room")).cast("int")
    return placed.withColumn("slots", F.transform("terms", lambda _, i: first + i)).select("qid", "mode", "terms", "slots", *CELL), buckets, words


def _bit(slot: Column, word: int) -> Column:
    """The slot's bit in a word of its cell, 0 in the others."""
    return F.when(F.floor(slot / 64) == word, F.call_function("shiftleft", F.lit(1).cast("long"), slot % 64)).otherwise(F.lit(0).cast("long"))


def held_terms(terms: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv_id, term, in_prose): the terms (once each, as prepared queries have them) that stand in a conversation's prose or in the kind without postings.

    Such a term is of word characters alone, so it stands in a text where it stands in one of its words. Each word of the vocabulary is read once: at each of
    its places it meets the terms by equality, in the lengths that they have.
    """
    texts = messages.where(F.col("kind").isin("prose", "reasoning")).select("conv_id", "kind", F.lower("text").alias("low"))
    each = texts.select("conv_id", "kind", F.explode(F.regexp_extract_all("low", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word"))
    words = stored(each.groupBy("conv_id", "word").agg(F.max(F.col("kind") == "prose").alias("in_prose")), "words")
    lengths = sorted(r[0] for r in terms.select(F.length("term")).distinct().collect())  # no more than the longest term has letters
    ahead = rf"(?=([\p{{L}}\p{{N}}_]{{1,{max(lengths, default=1)}}}))"
    heads = words.select("word").distinct().select("word", F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit(ahead), F.lit(1)))).alias("head"))
    starts = heads.select("word", "head", F.explode(F.lit(lengths).cast("array<int>")).alias("n")).where(F.length("head") >= F.col("n")).select("word", F.substring("head", F.lit(1), F.col("n")).alias("term"))
    holds = starts.join(terms.select("term"), "term").select("word", "term").distinct()
    return words.join(holds, "word").groupBy("conv_id", "term").agg(F.max("in_prose").alias("in_prose"))


def every(
    asked: DataFrame, queries: DataFrame, conversations: DataFrame, messages: DataFrame, matches: DataFrame, kept: DataFrame, now_ms: int, most: int = MOST, decay: float = DECAY,
) -> DataFrame:
    """As ``run``, for each query with each conversation of ``asked`` (conv_id, once each); kept: (conv_id) that pass the filters, which all queries share.

    Queries are dealt to cells. A conversation meets a cell as one row, with bits of the terms that it holds and the places that it has with the cell's
    queries; the rows of its pairs are made from that, after the last shuffle, by counting the bits of each query.
    """
    dealt, buckets, words = _dealt(queries)
    dealt = stored(dealt, "dealt")
    each = dealt.select(*CELL, F.explode(F.arrays_zip("terms", "slots")).alias("x")).select(*CELL, F.col("x.terms").alias("term"), F.col("x.slots").alias("slot"))
    bits = each.groupBy("term", *CELL).agg(*[F.bit_or(_bit(F.col("slot"), w)).alias(f"bits_{w}") for w in range(words)])
    held = held_terms(each.select("term").distinct(), messages).repartition("conv_id")  # the rows of a cell's conversation come together
    holds = held.join(bits, "term").groupBy("conv_id", *CELL).agg(
        *[F.bit_or(f"bits_{w}").alias(f"any_{w}") for w in range(words)], *[F.bit_or(F.when(F.col("in_prose"), F.col(f"bits_{w}"))).alias(f"prose_{w}") for w in range(words)]
    )
    place = F.struct("qid", F.struct("rank", "score").alias("place"))
    best = _best(_placed(matches, messages, now_ms, most, decay)).join(dealt.select("qid", *CELL).distinct(), "qid")
    places = best.groupBy("conv_id", *CELL).agg(F.map_from_entries(F.collect_list(place)).alias("places"))
    told = (
        asked.join(conversations.select(F.col("id").alias("conv_id"), F.lit(True).alias("found")), "conv_id", "left").join(_counts(messages), "conv_id", "left")
        .join(kept.select("conv_id", F.lit(True).alias("passes")), "conv_id", "left")
    )
    met = told.select("*", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")).join(dealt.select(*CELL).distinct(), "bucket")
    known = met.join(holds, ["conv_id", *CELL], "left").join(places, ["conv_id", *CELL], "left")
    zero = F.lit(0).cast("long")
    mask = lambda w: F.aggregate("slots", zero, lambda a, s: a.bitwiseOR(_bit(s, w)))
    groups = dealt.select(*CELL, F.struct("qid", "mode", *[mask(w).alias(f"mask_{w}") for w in range(words)]).alias("query")).groupBy(*CELL).agg(F.collect_list("query").alias("queries"))
    pairs = known.join(groups, list(CELL)).withColumn("query", F.explode("queries")).select("*", "query.*")
    counted = lambda name: reduce(add, [F.bit_count(F.coalesce(f"{name}_{w}", zero).bitwiseAND(F.col(f"mask_{w}"))) for w in range(words)]).cast("long")
    at = F.col("places")[F.col("qid")]
    return _verdicts(pairs.withColumns({"terms_any": counted("any"), "terms_indexed": counted("prose"), "best_rank": at["rank"], "best": at["score"]}))
