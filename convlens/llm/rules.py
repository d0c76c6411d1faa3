"""Quality rules: a table of thresholds compiled into one projection of ratios, by Spark expressions alone.

A rule bounds one measure of a document from below, from above or both; ``compile_rules`` makes one column of all of them: the
array of the names of the rules that fail. A new rule is a row, a new measure an expression in ``_measures``.

Measures. Words are ``[^\\x20\\x09-\\x0D]+``, lines are split at ``\\n`` and count if they hold a word. ``word_chars`` is the
number of code points in words, ``n_symbols`` of characters among ``#*$%&|<>``, ``n_dup_lines`` of lines equal to an earlier
one, ``n_repeat_words`` of words in windows of five words that the text holds twice or more, the first one included. Windows are
told apart by 96 bits of hashes; where all are different, which a hash set tells in one pass, nothing is sorted. Else windows are
sorted with their places, and the stretches that repeated ones cover are summed by the distance to the next.

Defined results: null text counts as empty; a text without words has ratios of 0; a null id stays null; rows that share an id are
judged each by itself; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens.llm.shared import stored

WINDOW = 5
WHITE, SYMBOLS = r"\x20\x09-\x0D", "#*$%&|<>"  # of character classes
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = """
    the of and to in a is that for it as with on by this are be or an at from have not but which you
    der die das und ist von den dem ein eine zu mit im auf sich nicht des es für wie
    le la les et de un une est dans que qui pour par sur pas au ce se en
    el los las y una por con no su para del al lo como más
"""


@dataclass(frozen=True)
class Rule:
    """A document fails where ``measure`` is below ``least`` or above ``most``; documents under ``from_words`` words are not judged by it."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: What ``kept`` asks for besides the base.
RULES = [
    Rule("too short", "n_words", least=10),
    Rule("repeated words", "repeat_word_share", most=0.20),
    Rule("word length", "mean_word_chars", least=2.0, most=12.0),
    Rule("symbols", "symbols_a_word", most=0.10),
    Rule("few stop words", "stop_word_share", least=0.01, from_words=50),
    Rule("repeated lines", "dup_line_share", most=0.30),
    Rule("bullets", "bullet_line_share", most=0.90),
    Rule("unfinished lines", "ellipsis_line_share", most=0.30),
    Rule("few letters", "letter_share", least=0.60),
]


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part).cast("double") / F.col(whole)).otherwise(0.0)


def _measures() -> dict[str, Column]:
    """Measures by name, over the counts that ``measured`` makes."""
    return {
        "n_words": F.col("n_words"),
        "repeat_word_share": _share("n_repeat_words", "n_words"),
        "mean_word_chars": _share("word_chars", "n_words"),
        "symbols_a_word": _share("n_symbols", "n_words"),
        "stop_word_share": _share("n_stop_words", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "bullet_line_share": _share("n_bullet_lines", "n_lines"),
        "ellipsis_line_share": _share("n_ellipsis_lines", "n_lines"),
        "letter_share": _share("n_letters", "word_chars"),
    }


def compile_rules(rules: list[Rule]) -> Column:
    """array<string> of the names of the rules that fail, in the order of the table."""
    known = _measures()
    fails = []
    for r in rules:
        if r.measure not in known:
            raise ValueError(f"rule {r.name!r} asks for {r.measure!r}, which is none of {sorted(known)}")
        value = known[r.measure]
        out = F.lit(False)
        if r.least is not None:
            out = out | (value < r.least)
        if r.most is not None:
            out = out | (value > r.most)
        fails.append(F.when(out & (F.col("n_words") >= r.from_words), F.lit(r.name)))
    return F.filter(F.array(*fails), lambda x: x.isNotNull()) if fails else F.expr("cast(array() as array<string>)")


def _repeated(n: Column, words: str, kept: list[str], rows: DataFrame) -> DataFrame:
    """``rows`` with n_repeat_words. Each step is a projection of its own, whose array the next reads more than once."""
    at = lambda i, k: F.get(words, i + k)
    own = lambda i: [at(i, k) for k in range(WINDOW)]
    none = F.expr("cast(array() as array<bigint>)")
    starts = F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0)).cast("int"))
    hashed = rows.withColumn("__h", F.when(n >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*own(i)))).otherwise(none))
    # Only where a hash comes twice: all windows in order of hash, a second hash and place.
    keyed = F.transform(starts, lambda i: F.struct(F.get("__h", i).alias("h"), F.hash(*own(i)).alias("g"), i.alias("i")))
    several = F.size(F.array_distinct("__h")) < F.size("__h")
    ordered = hashed.withColumn("__s", F.when(several, F.sort_array(keyed))).drop("__h", words)
    same = lambda x, y: y.isNotNull() & (x["h"] == y["h"]) & (x["g"] == y["g"])
    beside = F.filter("__s", lambda x, i: same(x, F.get("__s", i - 1)) | same(x, F.get("__s", i + 1)))
    places = ordered.withColumn("__p", F.when(F.col("__s").isNotNull(), F.sort_array(F.transform(beside, lambda x: x["i"])))).drop("__s")
    covered = F.transform("__p", lambda p, i: F.least(F.coalesce(F.get("__p", i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    return places.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).select(*kept, "n_repeat_words")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts that measures are made of."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    split = rows.select(
        "doc_id",
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{WHITE}]")).alias("lines"),
        F.array_remove(F.split("text", f"[{WHITE}]+"), "").alias("words"),
    )
    stops = sorted(set(STOP_WORDS.split()))
    ended = lambda x: F.rtrim(x, F.lit(" \t\x0b\x0c\r"))
    told = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_letters",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(f"^[{WHITE}]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: ended(x).endswith("...") | ended(x).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("words", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(stops))).cast("long").alias("n_stop_words"),
        "words",
    )
    return _repeated(F.col("n_words"), "words", [c for c in told.columns if c != "words"], told)


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, the counts, ``measures`` (a struct of all ratios), ``failed`` (names of rules) and ``kept``.

    Counts, a few numbers a document, are written: whoever filters by a measure or tries another table of rules doesn't count again.
    """
    counts = stored(measured(docs, doc_id, text), "counts")
    failed = compile_rules(RULES if rules is None else rules).alias("failed")
    ratios = F.struct(*[c.cast("double").alias(k) for k, c in _measures().items()]).alias("measures")
    return counts.select("*", ratios, failed).withColumn("kept", F.size("failed") == 0)
