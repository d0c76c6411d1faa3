"""Personal data by weak supervision, by DataFrame expressions alone.

Base kinds (email, ip, card, phone) are reported wherever their pattern matches. Weak candidates - written-out mail
addresses, bare digit groups, names after a title - are reported when the final span classifier finds them likelier
than not. It is learned without labels: labelers of three families (regex shape, gazetteer, context words) vote 1, 0 or
abstain (-1) on every candidate of the corpus. The gazetteers of mail hosts and given names grow by those that the written
addresses of at least two texts have. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is and how likely each pattern is personal data; a logistic span classifier is trained on those soft
labels, over kind and votes and over what the labelers do not see: the span's length and the words before and behind it, in a
few classes each. So a span on which labelers abstain can stand where others do that they know. There are at most kinds x
3^labelers x lengths x sides^2 patterns (186,624), whatever the corpus: only their counts reach the driver.

Defined results: null text counts as empty; a null id stays null; rows that share an id are scanned each by itself;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens.functions.arrays import running_max
from convlens.llm.shared import attach, stored
from convlens.llm.spans import NO_SPANS, chunked, in_order, laid_out, stretch, with_matches

# The patterns of the base kinds.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})?$"
# Patterns of the weak kinds.
SPOKEN_MAIL = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,}+\x20[(\[]?(?:at|AT)[)\]]?\x20[A-Za-z0-9-]{2,}+\x20[(\[]?(?:dot|DOT)[)\]]?\x20[A-Za-z]{2,}+"
DIGITS = r"(?<![0-9+.-])[0-9](?:[\x20.-]?[0-9]){6,}+"
NAME = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra|Senor|Senora|Don|Sir)\.?\x20[A-Z][a-z]{2,}+(?:\x20[A-Z][a-z]{2,}+)?"
BASE_KINDS = ["email", "ip", "card", "phone"]
WEAK_KINDS = ["spoken_mail", "digits", "name"]
LABELERS = ["shape", "gazetteer", "context", "refuted", "checksum"]
# Gazetteers to begin with; mail hosts and name parts that the corpus itself has in written addresses are added.
MAIL_HOSTS = "aol example fastmail free gmail gmx googlemail hotmail icloud laposte live mail msn outlook proton protonmail qq t-online web yahoo yandex zoho"
GIVEN_NAMES = """
    adam agnes ahmed alan albert alejandro alex alexander alice ali amanda amelie amy ana andrea andreas andrew anette angela anna anne antoine
    antonio arthur barbara ben bernd brian camille carl carla carlos carmen caroline catherine charles charlotte chloe christian christina claire
    claudia clara daniel david deborah diana diego dorothy edward elena elizabeth ella emily emma eric eva felix fernando francesca frank
    franz gabriel george georg giulia greta hannah hans heinz helen helena henry hugo ida ines isabel ivan jack jacob jakob james jan jana jane
    javier jean jennifer jessica joan johanna john jonas jorge jose joseph juan julia julien jurgen karen karin karl kate katharina kevin klaus
    laura lea leon lena leo linda lisa louis louise lucas lucia lucy luis luisa lukas manuel marco margaret maria marie mark markus marta
    martin mary matthew max mia michael michel miguel mohammed monika natalie nicolas nina noah nora olga oliver olivia oscar pablo
    patricia patrick paul paula pedro peter petra philip pierre rachel rafael ralf rebecca richard robert rosa ruth samuel sandra sara sarah
    sebastian silvia simon sofia sophie stefan stephan steven susan sven teresa theo thomas tim tobias tom ursula uwe vera victor walter william
    wolfgang yusuf
"""
CONTEXT = r"(?i)\b(?:call|phone|tel|telefon|mobile|fax|mail|contact|card|visa|account|iban|ssn|passport|born|address|name|reach)\b"
REFUTING = r"(?i)(?:\b(?:version|id|order|ref|isbn|issn|doi|page|total|fig|figure|table|no|chapter|line|build)\b|[$%#*&|])"

NEAR = 40  # code points of context before and behind a span
#: Classes of the classifier's own features: of lengths, and of the word on either side, 0 being none.
OWN = {"size": 4, "left": 8, "right": 8}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(F.filter(each, lambda d: d.isNotNull()), lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _hits(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    raw = with_matches(
        docs.withColumn("row_key", F.xxhash64("text")),
        "text",
        {
            "email": (EMAIL, text.contains("@")),
            "ip": (IP, text.rlike(r"[0-9]\.[0-9]")),
            "card": (CARD, text.rlike("[0-9][\\x20-]?[0-9]")),
            "phone": (PHONE, text.contains("+")),
            "spoken_mail": (SPOKEN_MAIL, text.rlike(r"\x20[(\[]?(?:dot|DOT)[)\]]?\x20")),
            "digits": (DIGITS, text.rlike("[0-9][\\x20.-]?[0-9]")),
            "name": (NAME, F.lit(True)),
        },
    )
    count = lambda s: F.length(_digits(s["text"]))
    kept = {
        "email": F.col("email"),
        "ip": F.filter("ip", lambda s: F.forall(F.split(s["text"], r"\."), lambda p: p.rlike(PART))),
        "card": F.filter("card", lambda s: count(s).between(13, 19) & luhn(_digits(s["text"]))),
        "phone": F.filter("phone", lambda s: count(s).between(9, 15)),
    }
    based = raw.select("doc_id", "row_key", "text", *[v.alias(k) for k, v in kept.items()], *WEAK_KINDS)
    based = based.withColumn("base", F.concat(*[laid_out(F.col(k), k) for k in BASE_KINDS]))
    # Weak spans that overlap no base span: by place, with the latest end of the base spans that begin before a weak one ends.
    weak = lambda k: F.transform(k, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("based"), F.lit(0).alias("until"), F.lit(k).alias("kind"), s.alias("s")))
    nothing = F.expr("cast(null as struct<start:int,end:int,text:string>)").alias("s")
    of_base = F.transform("base", lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("based"), b["end"].alias("until"), b["kind"].alias("kind"), nothing))
    based = based.withColumn("placed", F.sort_array(F.concat(of_base, *[weak(k) for k in WEAK_KINDS]))).drop(*WEAK_KINDS)
    based = based.withColumn("until", F.transform("placed", lambda x: x["until"]))
    based = based.withColumn("until", running_max("until")).withColumn("chunks", F.when(F.exists("placed", lambda x: x["based"] == 0), chunked(F.col("text"))))
    free = F.filter(F.zip_with("placed", "until", lambda x, m: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), (x["based"] == 0).alias("weak"), m.alias("until"))), lambda x: x["weak"] & (x["until"] <= x["s"]["start"]))
    listed = F.transform(
        free,
        lambda x: F.struct(
            x["s"]["start"].alias("start"),
            x["kind"].alias("kind"),
            x["s"]["end"].alias("end"),
            x["s"]["text"].alias("text"),
            stretch("chunks", F.greatest(x["s"]["start"] - NEAR, F.lit(0)), x["s"]["start"]).alias("before"),
            stretch("chunks", x["s"]["end"], x["s"]["end"] + NEAR).alias("after"),
        ),
    )
    mails = F.transform("email", lambda s: s["text"]).alias("emails")
    return based.select("doc_id", "row_key", "base", mails, listed.alias("weak"))


def gazetteer(hits: DataFrame, least: int = 2) -> DataFrame:
    """list, word: hosts and name parts of the addresses that at least ``least`` documents hold, and those to begin with."""
    mail = hits.select("row_key", F.explode("emails").alias("mail")).select("row_key", F.lower("mail").alias("mail")).distinct()
    host = F.array(F.element_at(F.split(F.substring_index("mail", "@", -1), r"\."), -2))
    words = lambda name, found: mail.select("row_key", F.lit(name).alias("list"), F.explode(found).alias("word"))
    parts = F.filter(F.split(F.substring_index("mail", "@", 1), "[^a-z]+"), lambda w: F.length(w) >= 3)
    learned = words("host", host).union(words("name", parts)).distinct().groupBy("list", "word").count().where(F.col("count") >= least).select("list", "word")
    fixed = F.explode(F.map_from_arrays(F.array(F.lit("host"), F.lit("name")), F.array(F.lit(MAIL_HOSTS), F.lit(GIVEN_NAMES)))).alias("list", "words")
    begun = hits.sparkSession.range(1).select(fixed).select("list", F.explode(F.split(F.trim(F.regexp_replace("words", r"\s+", " ")), " ")).alias("word"))
    return learned.union(begun).distinct()


def _listed(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """``candidates`` with ``listed``: whether a word of theirs, or of a name the one before, is in a gazetteer. The join is by word."""
    keyed = candidates.withColumn("own", F.struct("doc_id", "row_key", "start", "kind", "end"))
    mail = F.split(F.lower("text"), r"[()\[\]\x20]+")
    host = F.transform(F.slice(mail, F.greatest(F.size(mail) - 2, F.lit(1)), 1), lambda w: F.struct(F.lit("host").alias("list"), w.alias("word")))
    named = lambda text: F.transform(F.split(F.lower(text), "[^a-z]+"), lambda w: F.struct(F.lit("name").alias("list"), w.alias("word")))
    words = F.when(F.col("kind") == "spoken_mail", F.concat(host, named(F.element_at(mail, 1)))).when(F.col("kind") == "name", named(F.col("text"))).otherwise(
        named(F.substring_index(F.rtrim("before"), " ", -1))
    )
    asked = keyed.select("own", F.explode(F.array_distinct(words)).alias("w")).select("own", "w.*").where("word <> ''")
    found = asked.join(gazetteer(hits), ["list", "word"]).select("own").distinct().withColumn("listed", F.lit(True))
    return attach(keyed, found, "own").drop("own").withColumn("listed", F.coalesce("listed", F.lit(False)))


def _votes(candidates: DataFrame) -> DataFrame:
    """(…, kind, text, before) with a column per labeler: 1, 0, or -1 where it abstains."""
    text, before, kind = F.col("text"), F.col("before"), F.col("kind")
    n = F.length(_digits(text))
    shape = F.when(kind == "name", F.when(text.rlike(r"\x20[A-Z][a-z]+\x20[A-Z]"), 1).otherwise(-1)).when(
        kind == "spoken_mail", F.when(text.rlike(r"(?i)dot\)?\]?\x20(?:com|org|net|de|fr|es|eu|uk|io)$"), 1).otherwise(0)
    ).otherwise(F.when(n.between(10, 11) & text.rlike(r"[\x20.-]"), 1).when((n < 9) | (n > 19), 0).otherwise(-1))
    side = lambda word: F.when(word != "", F.pmod(F.xxhash64(word), F.lit(OWN["left"] - 1)) + 1).otherwise(0).cast("int")
    bare = lambda word: F.regexp_replace(F.lower(word), r"[^\p{L}]+", "")
    return candidates.select(
        "*",
        F.least(F.floor(F.length(text) / 8), F.lit(OWN["size"] - 1)).cast("int").alias("size"),
        side(bare(F.substring_index(F.rtrim(before), " ", -1))).alias("left"),
        side(bare(F.substring_index(F.ltrim(F.col("after")), " ", 1))).alias("right"),
        shape.alias("shape"),
        F.when(F.col("listed"), 1).otherwise(-1).alias("gazetteer"),
        F.when(before.rlike(CONTEXT), 1).otherwise(-1).alias("context"),
        F.when(before.rlike(REFUTING), 0).otherwise(-1).alias("refuted"),
        F.when(kind != "digits", -1).when(n.between(13, 19) & luhn(_digits(text)), 1).otherwise(0).alias("checksum"),
    )


def fit_reliability(patterns: list[tuple[tuple[int, ...], int]], prior: float = 0.2, rounds: int = 50) -> tuple[list[list[list[float]]], list[float]]:
    """EM of a two-class model with labelers independent given the class.

    patterns: (votes, count). Returns P(vote | class, labeler) as [labeler][class][0, 1, abstain] and P(class 1 | pattern).
    """
    n = len(patterns[0][0]) if patterns else 0
    # To begin with, a vote is right four times in five.
    rates = [[[0.8 / 2, 0.2 / 2, 0.5], [0.2 / 2, 0.8 / 2, 0.5]] for _ in range(n)]
    share, soft = prior, [prior] * len(patterns)
    for _ in range(rounds):
        for i, (votes, _) in enumerate(patterns):
            odds = math.log(share / (1 - share)) + sum(math.log(rates[j][1][v] / rates[j][0][v]) for j, v in enumerate(votes) if v >= 0)
            soft[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        total = sum(c for _, c in patterns)
        share = min(0.99, max(0.01, (sum(c * p for (_, c), p in zip(patterns, soft)) + 1) / (total + 1 / prior)))
        for j in range(n):
            for y in (0, 1):
                weight = [2 * (0.8 if v == y else 0.2) for v in (0, 1)] + [2.0]  # the beginning counts as a few candidates
                for (votes, c), p in zip(patterns, soft):
                    weight[votes[j]] += c * (p if y else 1 - p)
                rates[j][y] = [w / sum(weight) for w in weight]
    return rates, soft


def fit_classifier(rows: list[tuple[tuple[int, ...], int]], soft: list[float], features: int, rounds: int = 300, rate: float = 0.5) -> list[float]:
    """Logistic regression on soft labels by gradient steps, on the driver. rows: (indexes of features that are on, count), as many indexes each."""
    weights, total = np.zeros(features), max(1, sum(c for _, c in rows))
    on, count = np.array([r for r, _ in rows], np.int64), np.array([c for _, c in rows], np.float64)
    for _ in range(rounds if rows else 0):
        guess = 1 / (1 + np.exp(-np.clip(weights[on].sum(axis=1), -30, 30)))
        off = np.repeat(count / total * (np.array(soft) - guess), on.shape[1])
        weights = weights + rate * (np.bincount(on.ravel(), off, features) - 1e-3 * weights)
    return weights.tolist()


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, row_key, base and all spans (array<struct<start,kind,end>>) by kind, then start."""
    clean = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hits = stored(_hits(clean), "pii")
    candidates = hits.where(F.size("weak") > 0).select("doc_id", "row_key", F.explode("weak").alias("s")).select("doc_id", "row_key", "s.*")
    voted = stored(_votes(_listed(candidates, hits)).drop("text", "before", "after"), "votes")
    counts = voted.groupBy("kind", *OWN, *LABELERS).count().collect()
    known = sorted((WEAK_KINDS.index(r["kind"]), tuple(r[x] for x in OWN), tuple(r[x] for x in LABELERS), r["count"]) for r in counts)
    patterns: dict[tuple[int, ...], int] = {}
    for _, _, votes, c in known:
        patterns[votes] = patterns.get(votes, 0) + c
    by_votes = dict(zip(patterns, fit_reliability(list(patterns.items()))[1]))
    # A feature for each value of each column, the first one being always on.
    values = {"kind": WEAK_KINDS} | {x: list(range(n)) for x, n in OWN.items()} | {x: [-1, 0, 1] for x in LABELERS}
    at, first = {}, 1
    for name, own in values.items():
        at[name], first = first, first + len(own)
    place = lambda name, value: at[name] + values[name].index(value)
    feature = lambda kind, own, votes: (0, at["kind"] + kind, *[place(x, v) for x, v in zip(OWN, own)], *[place(x, v) for x, v in zip(LABELERS, votes)])
    weights = fit_classifier([(feature(k, own, votes), c) for k, own, votes, c in known], [by_votes[votes] for _, _, votes, _ in known], first)
    score = F.lit(weights[0])
    for name, own in values.items():
        told = F.create_map(*[x for v in own for x in (F.lit(v), F.lit(weights[place(name, v)]))])
        score = score + F.element_at(told, F.col(name))
    taken = (
        voted.where(1 / (1 + F.exp(-score)) > least)
        .groupBy("doc_id", "row_key")
        .agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))
    )
    joined = attach(hits.select("doc_id", "row_key", "base"), taken, "doc_id", "row_key").withColumn("more", F.coalesce("more", NO_SPANS()))
    kinds = BASE_KINDS + WEAK_KINDS
    return joined.select(
        "doc_id", "row_key", in_order(F.col("base"), kinds, True).alias("base"), in_order(F.concat("base", "more"), kinds, True).alias("spans")
    )
