"""Corpus analytics: projects, topics, files, calls, samples and collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlens.functions.text import tokenize


# Directories that are no project's, worktrees that lie within their project, and detached ones that only share its name.
SCRATCH = r"/Documents/Codex/\d{4}-\d{2}-\d{2}/|^/private/var/"
WORKTREE = r"^(.*?)/\.claude/worktrees/[^/]+/?$"
DETACHED = r"^(/Users/[^/]+)/\.codex/worktrees/[0-9a-f]+/(.+)$"


def project_of(conversations: DataFrame, scratch: str = SCRATCH, worktree: str = WORKTREE, detached: str = DETACHED) -> DataFrame:
    """conversations with project: the directory, none for scratch ones, a worktree's own project (group 1 of the pattern), and for a
    detached worktree the first project by name that ends in the same name; without one it stands for itself."""
    cwd = F.col("cwd")
    inner, own = F.nullif(F.regexp_extract("cwd", worktree, 1), F.lit("")), F.rtrim("cwd", F.lit("/"))
    out = F.rlike("cwd", F.lit(detached))
    place = F.when(F.rlike("cwd", F.lit(worktree)), inner).when(out, cwd).otherwise(own)
    base = conversations.withColumn("__dir", F.when((cwd != "") & ~F.rlike("cwd", F.lit(scratch)), place))
    base = base.withColumn("__name", F.when(out & F.col("__dir").isNotNull(), F.substring_index(own, "/", -1)))
    homes = base.where(F.col("__dir").isNotNull() & F.col("__name").isNull()).groupBy(F.substring_index("__dir", "/", -1).alias("__name")).agg(F.min("__dir").alias("__home"))
    joined = base.join(homes, "__name", "left")
    return joined.withColumn("project", F.when(F.col("__name").isNotNull(), F.coalesce("__home", "__dir")).otherwise(F.col("__dir"))).drop("__dir", "__name", "__home")


def rollup(conversations: DataFrame) -> DataFrame:
    """Per project: n, messages (where conversations have msg_count), first, last, dirs, sources (sorted, comma-joined)."""
    told = [F.sum("msg_count").alias("messages")] if "msg_count" in conversations.columns else []
    return conversations.where("project is not null").groupBy("project").agg(
        F.count("*").alias("n"), *told, F.min("ended_at").alias("first_ms"), F.max("ended_at").alias("last_ms"), F.countDistinct("cwd").alias("dirs"),
        F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"),
    )


def top_per_group(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def topic_hits(texts: DataFrame, seeds: DataFrame, least_members: int = 2) -> DataFrame:
    """(id, topic, terms): texts whose words meet a topic's seed words; topics of fewer members are none. seeds: (topic, term), bounded."""
    words = texts.select("id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    hits = words.join(F.broadcast(seeds), "term").groupBy("id", "topic").agg(F.count("*").alias("terms"))
    sizes = hits.groupBy("topic").count().where(F.col("count") >= least_members)
    return hits.join(sizes.select("topic"), "topic", "left_semi")


def topic_report(hits: DataFrame) -> DataFrame:
    return hits.groupBy("topic").agg(F.count("*").alias("members"), F.sum("terms").alias("terms"))


def topic_shares(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """One row: topics, untagged texts and their share, and of the topics' shares of all texts the median and the largest.

    hits: (id, topic); texts: (id). The shares are those of the seed list's topics, so few rows.
    """
    every = texts.agg(F.count("*").alias("texts"))
    tagged = hits.agg(F.countDistinct("id").alias("tagged"))
    sizes = hits.groupBy("topic").agg(F.countDistinct("id").alias("n"))
    spread = sizes.agg(F.count("*").alias("topics"), F.median("n").alias("middle"), F.max("n").alias("most"))
    share = lambda c: F.try_divide(F.col(c), F.col("texts"))
    row = every.crossJoin(tagged).crossJoin(spread).withColumn("untagged", F.col("texts") - F.col("tagged"))  # one row each
    return row.select("topics", "untagged", share("untagged").alias("untagged_share"), share("middle").alias("median_share"), share("most").alias("largest_share"))


def matched_seeds(texts: DataFrame, seeds: DataFrame) -> DataFrame:
    """(topic, term, texts): in how many texts each seed word occurs; seeds that occur nowhere are not there."""
    words = texts.select("id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    return words.join(F.broadcast(seeds), "term").groupBy("topic", "term").agg(F.count("*").alias("texts"))  # a seed list is typed by hand


def topic_overlaps(hits: DataFrame) -> DataFrame:
    """(a, b, jaccard) of topic pairs that share members; the number of topics is that of the seed list."""
    sizes = hits.groupBy("topic").agg(F.count("*").alias("n"))
    two = hits.select("id", F.col("topic").alias("a")).join(hits.select("id", F.col("topic").alias("b")), "id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    joined = two.join(sizes.select(F.col("topic").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("topic").alias("b"), F.col("n").alias("nb")), "b")
    return joined.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


# Paths with these endings are files; names found in every project; folders of tools, not of projects.
FILE_ENDINGS = "rs|py|ts|tsx|js|jsx|md|toml|json|sql|sh|ya?ml|html|css|txt"
SCAFFOLD = ["SKILL.md", "CLAUDE.md", "AGENTS.md"]
HARNESS = r"(^|/)\.(claude|codex)/|/Documents/Codex/|(^|/)\.git/"
PATHS = rf"(?:[\w.\-]+/)+[\w\-]+\.(?:{FILE_ENDINGS})"


def file_mentions(texts: DataFrame, pattern: str = PATHS, excluded: str = HARNESS) -> DataFrame:
    """(id, file, mentions) by pattern, scaffold names and tools' own folders left out."""
    each = texts.select("id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("file"))
    kept = each.where(~F.rlike("file", F.lit(excluded)) & ~F.substring_index("file", "/", -1).isin(SCAFFOLD))
    return kept.groupBy("id", "file").agg(F.count("*").alias("mentions"))


def top_files(mentions: DataFrame, members: DataFrame, most: int = 10) -> DataFrame:
    """(project, place, file, mentions): the most mentioned files of each project, paths below it without its own path.

    mentions: (id, file, mentions); members: (id, project). A message meets its conversation's project by id.
    """
    root = F.concat(F.rtrim("project", F.lit("/")), F.lit("/"))
    bare = F.ltrim(root, F.lit("/"))
    below = lambda p: F.substring(F.col("file"), F.length(p) + 1, F.length("file"))
    named = mentions.join(members.where("project is not null").select("id", "project"), "id")
    own = F.when(F.startswith("file", root), below(root)).when(F.startswith("file", bare), below(bare)).otherwise(F.col("file"))
    counts = named.groupBy("project", own.alias("file")).agg(F.sum("mentions").alias("mentions"))
    return top_per_group(counts, ["project"], [F.desc("mentions"), "file"], most).select("project", "place", "file", "mentions")


def topic_hits_of_projects(hits: DataFrame, members: DataFrame) -> DataFrame:
    """(project, topic, conversations): in how many conversations of a project a topic occurs. hits: (id, topic, ...)."""
    named = hits.join(members.where("project is not null").select("id", "project"), "id")
    return named.groupBy("project", "topic").agg(F.countDistinct("id").alias("conversations"))


# Keys of a call's arguments, the first that holds text tells the call; where text breaks lines.
ARGUMENT_KEYS = ["command", "cmd", "file_path", "path", "pattern", "query", "url", "uri", "prompt", "description", "notebook_path", "plan"]
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _lines(text) -> Column:
    """Lines of a text; a break at its end opens none."""
    return F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(F.regexp_replace(text, rf"({LINE_BREAK})\z", ""), LINE_BREAK))


def call_detail(calls: DataFrame, most: int = 400) -> DataFrame:
    """name, summary, removed and added lines of tool calls whose text is a name, a line feed and arguments.

    Arguments are a patch (told by its first file, with its changed lines), a JSON object (told by the first key that holds
    text; an edit has the lines of both strings, a written file those of its content), or plain text, which tells itself.
    Without any, the summary is empty and no line counts.
    """
    trimmed = F.regexp_replace(F.regexp_extract("text", r"(?s)^[^\n]*\n(.*)$", 1), r"^\s+|\s+$", "")
    rows = calls.select("id", "conv_id", F.substring_index("text", "\n", 1).alias("name"), F.coalesce(trimmed, F.lit("")).alias("args"))
    rows = rows.withColumn("json", F.try_parse_json("args")).withColumn("kind", F.schema_of_variant("json"))
    value = lambda key: F.when(F.schema_of_variant(F.try_variant_get("json", f"$.{key}", "variant")) == "STRING", F.try_variant_get("json", f"$.{key}", "string"))
    has = lambda key: F.try_variant_get("json", f"$.{key}", "variant").isNotNull()
    squeezed = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    told = F.coalesce(*[F.when(F.trim(F.regexp_replace(value(k), r"\s+", " ")) != "", squeezed(value(k))) for k in ARGUMENT_KEYS], F.lit(""))
    lines = _lines(F.col("args"))
    signed = lambda sign: F.size(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)))
    target = F.element_at(F.split(F.try_element_at(F.filter(lines, lambda x: x.startswith("*** ") & x.contains(" File: ")), F.lit(1)), " File: ", 2), 2)
    count = lambda key: F.coalesce(F.size(_lines(value(key))), F.lit(0))
    patch, json, edit = F.startswith("args", F.lit("***")), F.col("kind").startswith("OBJECT"), has("old_string") | has("new_string")
    summary = F.when(patch, F.coalesce(F.when(F.trim(target) != "", F.trim(target)), F.lit("patch"))).when(json, told).when(F.col("json").isNull(), squeezed(F.col("args"))).otherwise("")
    removed = F.when(patch, signed("-")).when(json & edit, count("old_string")).otherwise(0)
    added = F.when(patch, signed("+")).when(json & edit, count("new_string")).when(json, count("content")).otherwise(0)
    return rows.select("id", "conv_id", "name", F.substring(summary, 1, most).alias("summary"), removed.alias("removed"), added.alias("added"))


def call_totals(calls: DataFrame, details: DataFrame) -> DataFrame:
    """(conv_id, calls, sidechain_share, removed, added) of a conversation's calls. calls: (id, conv_id, is_sidechain); details: call_detail."""
    joined = calls.select("id", "conv_id", "is_sidechain").join(details.select("id", "removed", "added"), "id")
    return joined.groupBy("conv_id").agg(
        F.count("*").alias("calls"), (F.count_if("is_sidechain") / F.count("*")).alias("sidechain_share"), F.sum("removed").alias("removed"), F.sum("added").alias("added")
    )


def act_mix(calls: DataFrame, acts: DataFrame) -> DataFrame:
    """(conv_id, act, calls, share): tools as look, change, run or steer by a small table (name, act); unknown ones run."""
    named = calls.join(acts, "name", "left").withColumn("act", F.coalesce("act", F.lit("run")))
    counts = named.groupBy("conv_id", "act").agg(F.count("*").alias("calls"))
    return counts.withColumn("share", F.col("calls") / F.sum("calls").over(Window.partitionBy("conv_id")))


def group_stats(annotated: DataFrame, keys: list[str]) -> DataFrame:
    return annotated.groupBy(*keys).agg(F.count("*").alias("messages"), F.count_if("is_error").alias("failures"), F.count_if("question").alias("questions"), F.count_if("pause").alias("pauses"), *([F.count_if("compacted").alias("compactions")] if "compacted" in annotated.columns else []))


def activity(rows: DataFrame, key: str, at: str, bars: int = 24, least: int = 3) -> DataFrame:
    """(key, bar, n): dated rows at the nearest of ``bars`` places between a group's first and last instant."""
    w = Window.partitionBy(key)
    placed = rows.where(F.col(at).isNotNull()).select(key, at, F.min(at).over(w).alias("lo"), F.max(at).over(w).alias("hi"), F.count("*").over(w).alias("dated")).where(F.col("dated") >= least)
    bar = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(at) - F.col("lo")) * (bars - 1) / (F.col("hi") - F.col("lo")) + 0.5)).otherwise(0).cast("int")
    return placed.groupBy(key, bar.alias("bar")).agg(F.count("*").alias("n"))


def sample(
    conversations: DataFrame, per_source: int = 8, largest: int = 12, size: str = "n_chars", least: int = 0, limit: int | None = None, of_projects: int = 0,
    projects: int = 10, small: int = 22,
) -> DataFrame:
    """(id, stratum): the newest of each source, the largest of all, then the newest of projects; the first stratum that has a row names it.

    With ``limit`` a source gives max(per_source, limit / sources). ``of_projects`` conversations come from each of the largest ``projects``,
    and two from each of ``small`` projects of at most three.
    """
    fit = conversations.where(F.col(size) >= least)
    each = F.lit(per_source)
    if limit is not None:
        each = F.greatest(each, F.floor(F.lit(limit) / F.greatest(F.lit(1), F.lit(fit.select("source").distinct().count()))))
    newest = fit.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc_nulls_last("ended_at"), "id"))).where(F.col("place") <= each).select("id", F.lit(1).alias("stratum"))
    big = fit.orderBy(F.desc(size), "id").limit(largest).select("id", F.lit(2).alias("stratum"))
    out = newest.union(big)
    if of_projects:
        counts = conversations.where("project is not null").groupBy("project").agg(F.count("*").alias("n"))
        large = counts.orderBy(F.desc("n"), "project").limit(projects).select("project", F.lit(of_projects).alias("want"), F.lit(3).alias("stratum"))
        few = counts.where("n <= 3").orderBy(F.desc("n"), "project").limit(small).select("project", F.lit(2).alias("want"), F.lit(4).alias("stratum"))
        asked = large.union(few).groupBy("project").agg(F.max("want").alias("want"), F.min("stratum").alias("stratum"))
        own = fit.join(F.broadcast(asked), "project")  # at most projects + small rows
        own = own.withColumn("place", F.row_number().over(Window.partitionBy("project").orderBy(F.desc_nulls_last("ended_at"), "id")))
        out = out.union(own.where("place <= want").select("id", "stratum"))
    return out.groupBy("id").agg(F.min("stratum").alias("stratum"))


def collection(matched: DataFrame, pinned: DataFrame, excluded: DataFrame) -> DataFrame:
    """(matched and pinned) less excluded, with is_pin for what only a pin brings."""
    both = matched.select("id", F.lit(1).alias("m"), F.lit(0).alias("p")).union(pinned.select("id", F.lit(0), F.lit(1)))
    rows = both.groupBy("id").agg(F.max("m").alias("m"), F.max("p").alias("p"))
    return rows.join(excluded.select("id"), "id", "left_anti").select("id", ((F.col("m") == 0) & (F.col("p") == 1)).alias("is_pin"))
