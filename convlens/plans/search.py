"""Batches of ranked searches: many queries over one corpus in a job.

Queries meet postings by equi-joins on terms; ranks are made of ids and numbers alone, and texts are joined for the rows
that are shown. A prefix meets the vocabulary by its own prefixes, never by comparing all with all.
"""

from __future__ import annotations

import bisect
import itertools
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlens.functions.arrays import running
from convlens.functions.text import fold, squeeze
from convlens.lineage import stored
from convlens.operators import filters
from convlens.operators import postings as P

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
DECAY, YEAR_MS = 0.3, 365 * 86_400_000
REPEAT_WEIGHT = 0.25
WORD = r"[\p{L}\p{N}\p{M}]+"  # of a text whose words are marked
DIGITS = 9  # of a score, so that sums in another order are still ties


def prepare_queries(queries: DataFrame, known_sources: DataFrame | None = None, now_ms: int | None = None, tz: str = "UTC") -> DataFrame:
    """queries (qid, q[, sources, dirs, dates arrays]) with terms in order and with repeats, last_is_prefix, mode and, where filters are given, ``rejected``.

    rejected: the filters that select nothing, sorted: sources that are not known, by name; blank directories, as 'dir:'; dates that name no window
    (with ``now_ms``), as 'date:' and the text. Each distinct date is resolved once, whatever the number of queries.
    """
    text = F.lower(F.coalesce("q", F.lit("")))
    terms = F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda t: t != "")
    open_end = F.coalesce(F.rlike("q", F.lit(r"[\p{L}\p{N}_]$")), F.lit(False))
    last = F.coalesce(F.length(F.try_element_at("terms", F.lit(-1))), F.lit(0))
    out = queries.withColumn("terms", terms).withColumn("last_is_prefix", open_end & ((last >= 3) | (F.size("terms") > 1)))
    mode = F.when(F.size("terms") == 0, "empty").when((F.size("terms") == 1) & (last < 3) & open_end, "too_short").otherwise("searchable")
    out = out.withColumn("mode", mode)
    parts = []
    if known_sources is not None:
        parts.append(out.select("qid", F.explode("sources").alias("source")).join(known_sources.select("source").distinct(), "source", "left_anti").select("qid", F.col("source").alias("token")))
    if "dirs" in queries.columns:
        parts.append(out.select("qid", F.explode("dirs").alias("dir")).where(F.trim(F.coalesce("dir", F.lit(""))) == "").select("qid", F.lit("dir:").alias("token")))
    if "dates" in queries.columns and now_ms is not None:
        dates = out.select("qid", F.explode("dates").alias("spec"))
        bad_dates = filters.resolve_windows(dates.select("spec").distinct(), now_ms, tz).where("rejected").select("spec")
        parts.append(dates.join(bad_dates, "spec", "left_semi").select("qid", F.concat(F.lit("date:"), F.col("spec")).alias("token")))
    if not parts:
        return out
    bad = reduce(DataFrame.unionByName, parts).groupBy("qid").agg(F.sort_array(F.collect_set("token")).alias("rejected"))
    return out.join(bad, "qid", "left").withColumn("rejected", F.coalesce("rejected", F.expr("cast(array() as array<string>)")))


def marking_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, is_prefix) once each, a prefix winning over the same term whole."""
    return query_terms(queries).groupBy("qid", "term").agg(F.max("is_prefix").alias("is_prefix"))


def query_terms(queries: DataFrame, stemmed: bool = False) -> DataFrame:
    """(qid, place, term, is_prefix) with repeats; terms folded, and stemmed but for prefixes, as postings are."""
    each = queries.where("mode = 'searchable'").select("qid", "last_is_prefix", F.size("terms").alias("n"), F.posexplode("terms").alias("place", "raw"))
    rows = each.select("qid", "place", fold(F.col("raw")).alias("term"), (F.col("last_is_prefix") & (F.col("place") == F.col("n") - 1)).alias("is_prefix"))
    if not stemmed:
        return rows
    return P.stem_terms(rows.where("not is_prefix")).select(*rows.columns).union(rows.where("is_prefix"))


def term_hits(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """(term, is_prefix, msg_id, tf) of the distinct terms asked for, written. An underscore parts a term into words in a row.

    However many queries ask for a term, its postings are here once.
    """
    asked = stored(terms.select("term", "is_prefix").distinct(), "terms")
    single = asked.where(~F.col("term").contains("_"))
    exact = single.where("not is_prefix").join(postings.select("term", "msg_id", "tf"), "term").select("term", "is_prefix", "msg_id", "tf")
    # A word meets the prefixes asked for by equality with its own beginnings, of the lengths that are asked for.
    lengths = sorted(r[0] for r in single.where("is_prefix").select(F.length("term")).distinct().collect())  # no more than the longest word has letters
    vocabulary = postings.select(F.col("term").alias("word")).distinct()
    starts = F.filter(F.array(*[F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in lengths]), lambda x: x.isNotNull()) if lengths else F.expr("cast(array() as array<string>)")
    prefixes = vocabulary.select("word", F.explode(starts).alias("term"))
    wider = single.where("is_prefix").join(prefixes, "term")
    opened = wider.join(postings.select(F.col("term").alias("word"), "msg_id", "tf"), "word").groupBy("term", "is_prefix", "msg_id").agg(F.sum("tf").alias("tf"))
    hits = exact.unionByName(opened)
    if not asked.where(F.col("term").contains("_")).isEmpty():
        hits = hits.unionByName(_phrases(asked, postings))
    return stored(hits, "hits")


def frequencies(hits: DataFrame) -> DataFrame:
    """(term, is_prefix, df)"""
    return hits.groupBy("term", "is_prefix").agg(F.count("*").alias("df"))


def candidates(wanted: DataFrame, hits: DataFrame, known: DataFrame, most_heavy: int = 1000, least_heavy: int = 50_000, salts: int = 64) -> DataFrame:
    """(qid, msg_id, term, is_prefix, times, tf, df): the messages of each query's rarest term, with that term.

    wanted: (qid, term, is_prefix, times); known: ``frequencies`` of the hits, written. Queries with a term that nothing holds have none. Terms
    with more than a ``most_heavy``-th of all hits are heavy, so there are fewer than ``most_heavy`` of them, which bounds what is
    broadcast; their hits are dealt over ``salts`` parts, and the queries led by them are there once for each part.
    """
    own = wanted.join(known, ["term", "is_prefix"], "left")
    lead = F.min_by(F.struct("term", "is_prefix", "times", "df"), F.struct("df", "term", "is_prefix")).alias("lead")
    led = own.groupBy("qid").agg(lead, F.bool_and(F.col("df").isNotNull()).alias("all_held")).where("all_held").select("qid", "lead.*")
    total = known.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    edge = max(least_heavy, total // most_heavy)
    heavy = known.where(F.col("df") > edge).select("term", "is_prefix", F.lit(True).alias("heavy"))
    spread = hits.join(F.broadcast(heavy), ["term", "is_prefix"], "left")  # fewer than most_heavy rows
    dealt = spread.withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("msg_id"), F.lit(salts)).cast("int")).otherwise(0)).drop("heavy")
    asks = led.withColumn("salt", F.explode(F.when(F.col("df") > edge, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return asks.join(dealt, ["term", "is_prefix", "salt"]).select("qid", "msg_id", "term", "is_prefix", "times", "tf", "df")


def _phrases(asked: DataFrame, postings: DataFrame) -> DataFrame:
    # Phrases: a word's places less its number in the phrase agree for all words.
    words = asked.where(F.col("term").contains("_")).select("term", "is_prefix", F.filter(F.split("term", "_"), lambda w: w != "").alias("words"))
    each = words.select("term", "is_prefix", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    at = each.join(postings.select(F.col("term").alias("word"), "msg_id", F.explode("positions").alias("p")), "word").withColumn("start", F.col("p") - F.col("i"))
    whole = at.groupBy("term", "is_prefix", "msg_id", "start", "n").agg(F.count("*").alias("found")).where("found = n")
    return whole.groupBy("term", "is_prefix", "msg_id").agg(F.count("*").alias("tf"))


def bm25(tf: Column, df: Column, length: Column, messages: Column, average: Column) -> Column:
    """Negative: the smaller, the better."""
    idf = F.greatest(F.log((messages - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
    return -(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average)))


def decayed(score: Column, ts_ms: Column, now_ms: int, decay: float) -> Column:
    """Older is worse: a negative score is divided. Undated rows do not decay."""
    age = F.greatest(F.lit(0), F.lit(now_ms) - F.coalesce(ts_ms, F.lit(now_ms))) / YEAR_MS
    return score / (1 + decay * age)


def match(queries: DataFrame, postings: DataFrame, field: str = "prose", stemmed: bool = False) -> DataFrame:
    """(qid, msg_id, score): messages with every distinct term of a query; each occurrence of a repeated term adds.

    Candidates are the messages of each query's rarest term; the other terms are looked up for those alone, by term and message, so
    a common word is no hot key and costs no more than the rare one beside it. Postings are read several times and should be
    written (postings.write, or stored). stemmed: they hold stems, so terms are stemmed too; a prefix, whose word is not
    complete, then opens stems.
    """
    own = postings.where(F.col("field") == field)
    terms = query_terms(queries, stemmed)
    hits = term_hits(terms, own)
    known = stored(frequencies(hits), "frequencies")
    wanted = stored(terms.groupBy("qid", "term", "is_prefix").agg(F.count("*").alias("times")), "wanted")
    first = stored(candidates(wanted, hits, known), "candidates")
    others = wanted.join(known, ["term", "is_prefix"])
    lead = first.select("qid", F.col("term").alias("__term"), F.col("is_prefix").alias("__prefix"), "msg_id")
    looked = lead.join(others, "qid").where((F.col("term") != F.col("__term")) | (F.col("is_prefix") != F.col("__prefix")))
    held = looked.join(hits, ["term", "is_prefix", "msg_id"]).select(first.columns)
    part = F.struct("term", "is_prefix", "tf", "df", "times")
    met = first.unionByName(held).groupBy("qid", "msg_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # no more than a query has terms
    need = wanted.groupBy("qid").agg(F.count("*").alias("need"))
    whole = met.join(need, "qid").where(F.size("parts") == F.col("need"))
    lengths = P.doc_stats(own)
    stats = lengths.groupBy("field").agg(F.count("*").alias("messages"), F.avg("length").alias("average_length")).select("messages", "average_length")
    placed = whole.join(lengths.select("msg_id", "length"), "msg_id").crossJoin(F.broadcast(stats))  # one row
    weight = lambda x: bm25(x["tf"], x["df"], F.col("length"), F.col("messages"), F.col("average_length")) * x["times"]
    return placed.select("qid", "msg_id", F.aggregate("parts", F.lit(0.0), lambda total, x: total + weight(x)).alias("score"))


def flat(matches: DataFrame, messages: DataFrame, now_ms: int, limit: int, decay: float = DECAY, off_path: bool = False) -> DataFrame:
    """The best messages of each query: qid, rank, msg_id, conv_id, score."""
    rows = messages if off_path else messages.where("on_head_path")
    joined = matches.join(rows.select(F.col("id").alias("msg_id"), "conv_id", "ts_ms"), "msg_id")
    scored = joined.select("qid", "msg_id", "conv_id", decayed(F.col("score"), F.col("ts_ms"), now_ms, decay).alias("score"))
    return ranked(scored, limit, [best_first(), "msg_id"])


def best_first(score: str = "score") -> Column:
    """Scores in order, those alike to nine digits being ties; the scores themselves stay as they are."""
    return F.round(score, DIGITS)


def ranked(rows: DataFrame, limit: int, order: list[Column | str]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= limit)


def group_scores(scored: DataFrame, repeat_weight: float = REPEAT_WEIGHT) -> DataFrame:
    """(qid, row_id, score, match_count, positions) from scored messages (qid, row_id, position, score)."""
    best, total = F.min("score"), F.sum("score")
    return scored.groupBy("qid", "row_id").agg(
        (best + repeat_weight * (total - best)).alias("score"), F.count("*").alias("match_count"), F.sort_array(F.collect_list("position")).alias("positions")
    )


def grouped(
    matches: DataFrame, messages: DataFrame, now_ms: int, limit: int, decay: float = DECAY, repeat_weight: float = REPEAT_WEIGHT,
    off_path: bool = False, ceiling: int | None = None, groups: DataFrame | None = None, keep: DataFrame | None = None,
) -> DataFrame:
    """The best conversations (or sittings) of each query: qid, rank, row_id, score, match_count, positions.

    groups: (conv_id, group_id, message_offset). keep: (conv_id) that pass the query's filters. ceiling: messages per query that
    take part at all; none by default, so counts are exact.
    """
    rows = messages if off_path else messages.where("on_head_path")
    rows = rows if keep is None else rows.join(keep.select("conv_id"), "conv_id", "left_semi")
    joined = matches.join(rows.select(F.col("id").alias("msg_id"), "conv_id", "seq", "ts_ms"), "msg_id")
    scored = joined.withColumn("score", decayed(F.col("score"), F.col("ts_ms"), now_ms, decay))
    if ceiling is not None:
        scored = ranked(scored, ceiling, [best_first(), "msg_id"]).drop("rank")
    if groups is not None:
        scored = scored.join(groups, "conv_id", "left").withColumn("row_id", F.coalesce("group_id", "conv_id")).withColumn("position", F.col("seq") + F.coalesce("message_offset", F.lit(0)))
    else:
        scored = scored.withColumn("row_id", F.col("conv_id")).withColumn("position", F.col("seq"))
    return ranked(group_scores(scored, repeat_weight), limit, [best_first(), "row_id"])


def nested(matches: DataFrame, messages: DataFrame, shown: DataFrame, now_ms: int, each: int = 3, decay: float = DECAY) -> DataFrame:
    """The best messages within each shown row, in the ranker's own order: qid, row_id, n, msg_id, score (decayed)."""
    rows = messages.where("on_head_path").select(F.col("id").alias("msg_id"), F.col("conv_id").alias("row_id"), "ts_ms")
    own = matches.join(rows, "msg_id").join(shown.select("qid", "row_id"), ["qid", "row_id"]).withColumn("score", decayed(F.col("score"), F.col("ts_ms"), now_ms, decay))
    return own.withColumn("n", F.row_number().over(Window.partitionBy("qid", "row_id").orderBy(best_first(), "msg_id"))).where(F.col("n") <= each).select("qid", "row_id", "n", "msg_id", "score")


def totals(matches: DataFrame, messages: DataFrame, limit: int, groups: DataFrame | None = None, ceiling: int | None = None) -> DataFrame:
    """(qid, total, shown, settled): rows that match, whatever the limit, and how many of them the limit shows.

    groups: (conv_id, group_id), by which conversations are one row. With a ``ceiling`` on the messages looked at, a query with more of them has
    a total that is only a lower bound, and is not settled.
    """
    rows = matches.join(messages.where("on_head_path").select(F.col("id").alias("msg_id"), "conv_id"), "msg_id")
    if ceiling is not None:
        counts = rows.groupBy("qid").agg((F.count("*") <= ceiling).alias("settled"))
        rows = ranked(rows, ceiling, [best_first(), "msg_id"]).drop("rank").join(counts, "qid")
    else:
        rows = rows.withColumn("settled", F.lit(True))
    if groups is not None:
        rows = rows.join(groups.select("conv_id", "group_id"), "conv_id", "left").withColumn("conv_id", F.coalesce("group_id", "conv_id"))
    counted = rows.groupBy("qid").agg(F.countDistinct("conv_id").alias("total"), F.first("settled").alias("settled"))
    return counted.select("qid", "total", F.least("total", F.lit(limit)).alias("shown"), "settled")


def recent(conversations: DataFrame, limit: int, at: str = "ended_at", keep: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Newest first, undated last, ties by id. keep: (conv_id) that pass the filters. groups: (conv_id, group_id, opens, ended): a sitting is
    one row, that of the conversation which opens it, dated by the whole; filters are tested on that conversation."""
    rows = conversations if keep is None else conversations.join(keep.select(F.col("conv_id").alias("id")).distinct(), "id", "left_semi")
    if groups is not None:
        own = groups.select(F.col("conv_id").alias("id"), "opens", F.col("ended").alias("__ended"))
        rows = rows.join(own, "id", "left").where(F.coalesce("opens", F.lit(True))).withColumn(at, F.coalesce("__ended", at)).drop("opens", "__ended")
    return rows.orderBy(F.desc_nulls_last(at), "id").limit(limit)


def answer(queries: DataFrame, found: DataFrame, conversations: DataFrame, limit: int) -> DataFrame:
    """(qid, rank, row_id): ranked rows for searchable queries, the recent list for the others."""
    listed = recent(conversations, limit).select(F.row_number().over(Window.orderBy(F.desc_nulls_last("ended_at"), "id")).alias("rank"), F.col("id").alias("row_id"))
    plain = queries.where("mode <> 'searchable'").select("qid").crossJoin(F.broadcast(listed))  # at most `limit` rows
    return found.select("qid", "rank", "row_id").unionByName(plain.select("qid", "rank", "row_id"))


def envelope(queries: DataFrame, totals: DataFrame, conversations: DataFrame, limit: int) -> DataFrame:
    """(qid, mode, count, total, settled, rejected): one row for each query, whatever it turns out to be.

    A query that cannot be searched is answered out of the recent list, whose total is exact. rejected: filters that were not applied, as
    prepare_queries names them.
    """
    every = conversations.agg(F.count("*").alias("every"))
    joined = queries.join(totals.select("qid", "total", "settled"), "qid", "left").crossJoin(F.broadcast(every))  # one row
    plain = F.col("mode") != "searchable"
    total = F.when(plain, F.col("every")).otherwise(F.coalesce("total", F.lit(0)))
    rejected = F.col("rejected") if "rejected" in queries.columns else F.expr("cast(array() as array<string>)")
    return joined.select("qid", "mode", F.least(total, F.lit(limit)).alias("count"), total.alias("total"), (plain | F.coalesce("settled", F.lit(True))).alias("settled"), rejected.alias("rejected"))


def match_histogram(shown: DataFrame, sizes: DataFrame, cells: int = 10) -> DataFrame:
    """(qid, row_id, cell, level): matches over ten equal stretches of a row, in levels 0, 1, 2 (2-3) and 3 (4 or more)."""
    at = shown.join(sizes.select(F.col("conv_id").alias("row_id"), "msg_count"), "row_id").select("qid", "row_id", "msg_count", F.explode("positions").alias("p"))
    cell = F.least(F.floor(F.col("p") * cells / F.greatest("msg_count", F.lit(1))), F.lit(cells - 1)).cast("int")
    counts = at.select("qid", "row_id", cell.alias("cell")).groupBy("qid", "row_id", "cell").count()
    return counts.select("qid", "row_id", "cell", F.when(F.col("count") == 1, 1).when(F.col("count") <= 3, 2).otherwise(3).alias("level"))


def group_by_axis(found: DataFrame, axis: DataFrame) -> DataFrame:
    """Groups of results in order of first appearance, rows without an axis value last: qid, value, first_rank, rows, place."""
    heads = found.join(axis.select(F.col("id").alias("row_id"), "value"), "row_id", "left").groupBy("qid", "value").agg(F.min("rank").alias("first_rank"), F.count("*").alias("rows"))
    return heads.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("value").isNull(), "first_rank")))


# --- spans and snippets of the rows that are shown -------------------------------------------------------------------


def placed_words(texts: DataFrame) -> DataFrame:
    """Each word of ``text`` as a row, folded, with start and end in UTF-8 bytes, beside the other columns."""
    keys = [c for c in texts.columns if c != "text"]
    piece, hit = F.split("text", WORD, -1), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = texts.select(*keys, piece.alias("pieces"), hit.alias("words"))
    laid = F.zip_with(F.slice("pieces", 1, F.size("words")), "words", lambda p, h: F.struct(F.octet_length(p).alias("skip"), F.octet_length(h).alias("take"), h.alias("word")))
    sized = cut.select(*keys, laid.alias("laid")).select("*", F.transform("laid", lambda x: x["skip"] + x["take"]).alias("sizes"))
    told = sized.select(*keys, "laid", running("sizes").alias("at"))
    place = lambda x, at: F.struct((at + x["skip"]).alias("start"), (at + x["skip"] + x["take"]).alias("end"), x["word"].alias("word"))
    return told.select(*keys, F.explode(F.zip_with("laid", "at", place)).alias("w")).select(*keys, "w.start", "w.end", fold(F.col("w.word")).alias("word"))


def match_spans(shown: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, msg_id, start, end) in UTF-8 bytes of the words that match. shown: qid, msg_id, text; terms: qid, term, is_prefix.

    For rows that are shown: a text is read once for each query. ``term_spans`` reads it once for all of them.
    """
    words = placed_words(shown.select("qid", "msg_id", "text"))
    exact = words.join(terms.where("not is_prefix").select("qid", F.col("term").alias("word")), ["qid", "word"]).select("qid", "msg_id", "start", "end")
    opened = words.join(terms.where("is_prefix"), "qid").where(F.col("word").startswith(F.col("term"))).select("qid", "msg_id", "start", "end")
    return exact.union(opened).distinct()


def disjoint_terms(terms: DataFrame) -> DataFrame:
    """(qid, term, is_prefix) of ``marking_terms`` without those that begin with another prefix of their query, whose words that prefix marks too.

    No word matches two of what is left, so the words of a query are those of its terms put together.
    """
    wider = terms.where("is_prefix").select("qid", F.col("term").alias("__wider"))
    covered = (F.col("term") != F.col("__wider")) & F.col("term").startswith(F.col("__wider"))
    within = terms.join(wider, "qid").where(covered).select("qid", "term").distinct()
    return terms.join(within, ["qid", "term"], "left_anti")


def term_spans(texts: DataFrame, terms: DataFrame, spans: bool = True) -> DataFrame:
    """(columns of texts but text, term_id, words[, spans]): in each text the words that a term matches, counted and as sorted (start, end).

    texts: a row once each; terms: (term_id, term, is_prefix) once each, written. However many queries ask for a term, its words are found once. A word of the
    vocabulary meets the prefixes asked for by equality with its own beginnings, as in ``term_hits``.
    """
    keys = [c for c in texts.columns if c != "text"]
    plain = texts.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    words = placed_words(texts) if spans else plain.withColumn("word", fold(F.col("word")))
    lengths = sorted(r[0] for r in terms.where("is_prefix").select(F.length("term")).distinct().collect())  # no more than the longest word has letters
    vocabulary = plain.select("word").distinct().select(fold(F.col("word")).alias("word")).distinct()
    starts = vocabulary.select("word", F.explode(F.lit(lengths).cast("array<int>")).alias("n")).where(F.length("word") >= F.col("n")).select("word", F.substring("word", F.lit(1), F.col("n")).alias("term"))
    opens = starts.join(terms.where("is_prefix"), "term").select("word", "term_id").unionByName(terms.where("not is_prefix").select(F.col("term").alias("word"), "term_id"))
    laid = [F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")] if spans else []
    return words.join(opens, "word").groupBy(*keys, "term_id").agg(F.count("*").alias("words"), *laid)


def snippet(text: str, spans: list[tuple[int, int]], width: int = 160) -> tuple[str, list[tuple[int, int]]]:
    """A window of ``width`` characters on the densest cluster of matches, the earliest of equals; spans in its characters.

    The window slides by two ends over the spans in order. A mark that the cut halves keeps the half that is shown.
    """
    if not spans:
        return (text if len(text) <= width else text[: width - 1] + "…"), []
    spans, best, last = sorted(spans), (0, 0, 0), 0
    most = 0  # the latest end of spans up to ``last``; later spans begin later, and words do not overlap
    for i, (lo, hi) in enumerate(spans):
        if last < i:
            last, most = i, 0
        while last < len(spans) and spans[last][1] - lo <= width - 2:
            most = spans[last][1]
            last += 1
        if last - i > best[0]:
            best = (last - i, lo, most)
    if not best[0]:  # no match fits: the first one is clipped
        best = (1, *spans[0])
    _, lo, hi = best
    start = max(0, min((lo + hi) // 2 - width // 2, len(text) - width))
    start = max(0, min(start, lo - 1))
    end = min(len(text), start + width)
    left, right = "…" if start else "", "…" if end < len(text) else ""
    first, past = start + len(left), end - len(right)
    shift = len(left) - first
    begin = bisect.bisect_left(spans, (first - max(b - a for a, b in spans), 0))
    kept = []
    for a, b in itertools.islice(spans, begin, None):
        if a >= past:
            break
        if b > first:
            kept.append((max(a, first) + shift, min(b, past) + shift))
    return left + text[first:past] + right, kept


def snippets(shown: DataFrame, terms: DataFrame, width: int = 160) -> DataFrame:
    """(qid, msg_id, snippet, marks) for the rows shown, in Arrow batches."""
    listed = terms.groupBy("qid").agg(F.collect_list(F.struct("term", "is_prefix")).alias("terms"))
    schema = T.StructType([T.StructField("snippet", T.StringType()), T.StructField("marks", T.ArrayType(T.ArrayType(T.IntegerType())))])

    @F.pandas_udf(schema)
    def cut(text: pd.Series, folded: pd.Series, asked: pd.Series) -> pd.DataFrame:
        out = []
        for t, low, want in zip(text, folded, asked):
            low = low if len(low) == len(t) else t.lower()
            exact = {w["term"] for w in want if not w["is_prefix"]}
            open_ = tuple(w["term"] for w in want if w["is_prefix"])
            spans = [m.span() for m in re.finditer(r"[^\W_]+", low) if m[0] in exact or open_ and m[0].startswith(open_)]
            body, marks = snippet(t, spans, width)
            out.append((body, [list(m) for m in marks]))
        return pd.DataFrame(out, columns=["snippet", "marks"])

    flat_text = shown.select("qid", "msg_id", squeeze(F.col("text")).alias("text")).join(listed, "qid")
    return flat_text.select("qid", "msg_id", cut("text", fold(F.col("text")), "terms").alias("x")).select("qid", "msg_id", "x.snippet", "x.marks")
