"""Transcript exports of several layouts to conversations and messages, as scans and windows over many files.

Every reader gives (conversations, messages). Ids are scoped by the reader's source name. A malformed line or file gives no
rows. Order within a file is that of its lines, then of the blocks within one.
"""

from __future__ import annotations

import json
import sys
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlens.functions.text import html_to_text, squeeze
from convlens.functions.titles import clipped_title, rollout_title, session_title
from convlens.operators.model import reparent
from convlens.operators.walks import preorder
from convlens.sources.events import lines

# Names that stand for no model, and the keys that hold text in an object, first one wins.
NO_MODEL = ["", "<synthetic>", "auto"]
TEXT_KEYS = ["text", "content", "output", "message", "thinking"]


def text_of(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "string")


def _part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _flatten(v: Column, depth: int) -> Column:
    kind = F.schema_of_variant(v)
    plain = F.coalesce(text_of(v), F.lit(""))
    if not depth:
        return plain
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: _flatten(x, depth - 1))
    inner = F.lit("")
    for key in reversed(TEXT_KEYS):
        part = _part(v, f"$.{key}")
        inner = F.when(part.isNotNull() & ~F.is_variant_null(part), _flatten(part, depth - 1)).otherwise(inner)
    return F.when(v.isNull() | F.is_variant_null(v), "").when(kind.startswith("ARRAY"), F.array_join(F.filter(items, lambda x: x != ""), "\n")).when(kind.startswith("OBJECT"), inner).otherwise(plain)


def _text_within(v) -> str:
    if isinstance(v, dict):
        return next((_text_within(v[k]) for k in TEXT_KEYS if v.get(k) is not None), "")
    if isinstance(v, list):
        return "\n".join(filter(None, map(_text_within, v)))
    return "" if v is None else v if isinstance(v, str) else json.dumps(v)


@F.pandas_udf(T.StringType())
def _flatten_deep(values: pd.Series) -> pd.Series:
    sys.setrecursionlimit(max(10_000, sys.getrecursionlimit()))
    return values.map(lambda x: None if x is None else _text_within(json.loads(x)))


def flatten(v: Column) -> Column:
    """Text of a JSON value: strings as they are, arrays by lines, objects by the first key that holds more than null.

    Values of at most two containers are expressions; what nests deeper or mixes types goes through Arrow, nothing else does.
    """
    kind = F.schema_of_variant(v)
    deep = (F.size(F.split(kind, "<")) > 3) | kind.contains("VARIANT")
    return F.when(deep, _flatten_deep(F.when(deep, F.to_json(v)))).otherwise(_flatten(v, 2))


def model_name(name: Column) -> Column:
    return F.when(~F.trim(name).isin(NO_MODEL), F.trim(name))


def instant(text: Column) -> Column:
    """Epoch ms of an RFC 3339 instant; null if it is none."""
    tidy = F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"^(\d{4}-\d\d-\d\d)[ t]", "$1T")
    return F.unix_millis(F.when(F.rlike(tidy, F.lit(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:?\d\d)$")), F.try_to_timestamp(F.upper(tidy))))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of whole files, for layouts that are one JSON value."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("content"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, v), readable objects alone."""
    rows = lines(spark, path).withColumn("v", F.try_parse_json("line"))
    return rows.where(F.schema_of_variant("v").startswith("OBJECT")).select("file", "place", "v")


def _first(value: Column, place: str = "place") -> Column:
    return F.min_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.col(place)))


def _last(value: Column, place: str = "place") -> Column:
    return F.max_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.col(place)))


def _number(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))


def _chain(rows: DataFrame, keys: list[str]) -> DataFrame:
    """parent_id: the message before."""
    return rows.withColumn("parent_id", F.lag("native").over(Window.partitionBy(*keys).orderBy("seq")))


def _unique(rows: DataFrame, keys: list[str], fallback: Column) -> DataFrame:
    """A native id that came before in its file, or a missing one, gives way to one made of the place."""
    seen = F.row_number().over(Window.partitionBy(*keys, "native").orderBy("seq")) > 1
    return rows.withColumn("native", F.when(F.col("native").isNull() | (F.col("native") == "") | seen, fallback).otherwise(F.col("native")))


def _finish(source: str, heads: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """heads: file, native_id and metadata; rows: file, native, parent_id, ... Conversations without messages are kept only as metadata."""
    conv = F.concat(F.lit(f"{source}:"), F.col("native_id"))
    own = heads.where("native_id is not null and native_id <> ''").withColumn("conv_id", conv).withColumn("source", F.lit(source))
    at = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(":", "conv_id", c))
    joined = rows.join(own.select("file", "conv_id"), "file")
    messages = joined.select(
        at("native").alias("id"), "conv_id", at("parent_id").alias("parent_id"), "thread_key", "is_sidechain", "seq", "role", "kind",
        "ts_ms", F.coalesce("is_error", F.lit(False)).alias("is_error"), "model", "text", "file",
    )
    return own, messages


COLUMNS = ["custom", "generated", "first_user", "cwd", "git_branch", "declared_model", "surface", "forked_from", "head"]


def _heads(rows: DataFrame, **given: Column) -> DataFrame:
    return rows.select("file", "native_id", *[given.get(c, F.lit(None).cast("string")).alias(c) for c in COLUMNS])


def _blocks(v: Column) -> Column:
    """Content as an array of typed blocks; a bare string is one block of text."""
    content = _part(v, "$.message.content")
    wrapped = F.array(F.parse_json(F.to_json(F.struct(F.lit("text").alias("type"), text_of(content).alias("text")))))
    return F.when(F.schema_of_variant(content).startswith("ARRAY"), F.try_variant_get(content, "$", "array<variant>")).when(content.isNotNull(), wrapped)


def _typed(rows: DataFrame, user_type: str = "user") -> DataFrame:
    """role, kind, text and is_error of blocks ``b`` of events of type ``type``; blank ones are gone."""
    b = F.col("b")
    kind = text_of(b, "$.type")
    args = F.coalesce(F.to_json(_part(b, "$.input")), F.lit(""))
    text = (
        F.when(kind == "text", flatten(_part(b, "$.text")))
        .when(kind == "thinking", flatten(_part(b, "$.thinking")))
        .when(kind == "tool_use", F.concat(F.coalesce(text_of(b, "$.name"), F.lit("")), F.lit("\n"), args))
        .when(kind == "tool_result", flatten(_part(b, "$.content")))
    )
    out = rows.withColumn("text", F.regexp_replace(text, r"^\s+|\s+$", "")).where("text <> ''")
    out = out.withColumn("kind", F.when(kind == "text", "prose").when(kind == "thinking", "reasoning").when(kind == "tool_use", "tool_call").otherwise("tool_result"))
    role = F.when(F.col("kind") == "tool_result", "tool").when((F.col("kind") == "prose") & (F.col("type") == user_type), "user").otherwise("assistant")
    return out.withColumn("role", role).withColumn("is_error", F.coalesce(F.try_variant_get(b, "$.is_error", "boolean"), F.lit(False)) & (F.col("kind") == "tool_result"))


def session_jsonl(spark: SparkSession, path: str, source: str = "session") -> tuple[DataFrame, DataFrame]:
    """An event per line; blocks of an event are messages uuid, uuid#1, ... in a chain; skipped events pass their parent on."""
    v = F.col("v")
    events = json_lines(spark, path)
    session = F.coalesce(text_of(v, "$.sessionId"), text_of(v, "$.session_id"))
    meta = events.groupBy("file").agg(
        _first(session).alias("native_id"), _first(text_of(v, "$.cwd")).alias("cwd"), _first(text_of(v, "$.gitBranch")).alias("branch"), _first(text_of(v, "$.entrypoint")).alias("surface"),
        _last(F.when(text_of(v, "$.type") == "custom-title", text_of(v, "$.customTitle"))).alias("custom"),
        _last(F.when(text_of(v, "$.type") == "ai-title", text_of(v, "$.aiTitle"))).alias("generated"),
    )
    numbered = events.withColumn("ordinal", F.row_number().over(Window.partitionBy("file").orderBy("place"))).select(
        "file", "ordinal", text_of(v, "$.type").alias("type"), text_of(v, "$.uuid").alias("uuid"), text_of(v, "$.parentUuid").alias("up"), "v"
    )
    told = F.col("type").isin("user", "assistant") & ~F.coalesce(F.try_variant_get(v, "$.isMeta", "boolean"), F.lit(False))
    blocks = _typed(numbered.where(told).select("*", F.posexplode(_blocks(v)).alias("place", "b")))
    base = F.coalesce("uuid", F.format_string("evt-%06d", "ordinal"))
    nth = F.row_number().over(Window.partitionBy("file", "ordinal").orderBy("place")) - 1
    rows = _number(blocks, ["file"], ["ordinal", "place"]).withColumn("nth", nth).withColumn("native", F.when(F.col("nth") == 0, base).otherwise(F.concat(base, F.lit("#"), F.col("nth").cast("string"))))
    # Parents: events without a message are passed over.
    scoped = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("|", "file", c))
    kept = rows.select("file", "ordinal").distinct().withColumn("emitted", F.lit(True))
    nodes = numbered.join(kept, ["file", "ordinal"], "left").where("uuid is not null").select(scoped("uuid").alias("id"), scoped("up").alias("parent_id"), F.coalesce("emitted", F.lit(False)).alias("emitted"))
    above = reparent(nodes.groupBy("id").agg(F.first("parent_id", ignorenulls=True).alias("parent_id"), F.max("emitted").alias("emitted")))
    linked = rows.withColumn("id", scoped("uuid")).join(above.select("id", F.col("parent_id").alias("above")), "id", "left")
    before = F.lag("native").over(Window.partitionBy("file", "ordinal").orderBy("seq"))
    model = F.when(F.col("role") == "assistant", F.when(F.col("type") == "assistant", model_name(text_of(v, "$.message.model"))))
    out = linked.withColumn("parent_id", F.when(F.col("nth") == 0, F.element_at(F.split("above", r"\|"), -1)).otherwise(before)).select(
        "file", "native", "parent_id", F.col("file").alias("thread_key"), F.coalesce(F.try_variant_get(v, "$.isSidechain", "boolean"), F.lit(False)).alias("is_sidechain"),
        "seq", "role", "kind", instant(text_of(v, "$.timestamp")).alias("ts_ms"), "is_error", model.alias("model"), "text",
    )
    title = out.where("role = 'user' and kind = 'prose'").groupBy("file").agg(_first(session_title(F.col("text")), "seq").alias("said"))
    heads = _heads(meta.join(title, "file", "left"), custom=F.substring(squeeze(F.col("custom")), 1, 80), generated=F.substring(squeeze(F.col("generated")), 1, 80), first_user=F.col("said"), cwd=F.col("cwd"), git_branch=F.col("branch"), surface=F.col("surface"))
    return _finish(source, heads.join(out.select("file").distinct(), "file", "left_semi"), out)


def rollout_jsonl(spark: SparkSession, path: str, source: str = "rollout") -> tuple[DataFrame, DataFrame]:
    """Records {timestamp, type, payload}; the first session_meta describes the file, a turn's model carries forward."""
    v, p = F.col("v"), F.col("p")
    records = json_lines(spark, path).select("file", "place", text_of(v, "$.type").alias("rtype"), text_of(v, "$.timestamp").alias("at"), _part(v, "$.payload").alias("p")).where("p is not null")
    records = records.withColumn("ptype", F.coalesce(text_of(p, "$.type"), F.lit("")))
    metas = records.where("rtype = 'session_meta'").groupBy("file").agg(F.min_by("p", "place").alias("p"))
    said_model = F.when(F.col("rtype") == "turn_context", model_name(text_of(p, "$.model")))
    carried = records.withColumn("model", F.last(said_model, ignorenulls=True).over(Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    declared = records.groupBy("file").agg(_last(said_model).alias("declared"))
    pair = F.concat_ws("/", "rtype", "ptype")
    call, result = pair.isin("response_item/function_call", "response_item/custom_tool_call"), pair.isin("response_item/function_call_output", "response_item/custom_tool_call_output")
    user, agent, thought = pair == "event_msg/user_message", pair == "event_msg/agent_message", pair == "response_item/reasoning"
    some = lambda a, b: F.when(_part(p, a).isNotNull(), flatten(_part(p, a))).otherwise(flatten(_part(p, b)))
    text = (
        F.when(user | agent, flatten(_part(p, "$.message"))).when(thought, some("$.summary", "$.content"))
        .when(call, F.concat(F.coalesce(text_of(p, "$.name"), F.lit("")), F.lit("\n"), some("$.arguments", "$.input"))).when(result, flatten(_part(p, "$.output")))
    )
    context = user & (F.coalesce(text_of(p, "$.kind"), F.lit("")) == "environment_context")
    rows = carried.where((user | agent | thought | call | result) & ~context).withColumn("text", F.regexp_replace(text, r"^\s+|\s+$", "")).where("text <> ''")
    rows = rows.withColumn("role", F.when(user, "user").when(result, "tool").otherwise("assistant")).withColumn("kind", F.when(user | agent, "prose").when(thought, "reasoning").when(call, "tool_call").otherwise("tool_result"))
    code = F.expr("try_cast(get_json_object(try_variant_get(p, '$.output', 'string'), '$.metadata.exit_code') as int)")
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.jsonl$", "")
    sub = metas.select("file", F.coalesce(text_of(p, "$.thread_source") == "subagent", F.lit(False)).alias("is_sidechain"))
    rows = _number(rows, ["file"], ["place"]).withColumn("thread_key", stem).withColumn("native", F.concat(stem, F.lit(":"), F.lpad(F.col("seq").cast("string"), 6, "0")))
    out = _chain(rows, ["file"]).join(sub, "file").select(
        "file", "native", "parent_id", "thread_key", "is_sidechain", "seq", "role", "kind", instant(F.col("at")).alias("ts_ms"),
        F.coalesce((F.col("kind") == "tool_result") & (code != 0), F.lit(False)).alias("is_error"), F.when(F.col("role") == "assistant", F.col("model")).alias("model"), "text",
    )
    title = out.where("role = 'user' and kind = 'prose'").groupBy("file").agg(_first(rollout_title(F.col("text")), "seq").alias("said"))
    named = metas.join(declared, "file").join(title, "file", "left").withColumn("native_id", F.coalesce(text_of(p, "$.session_id"), text_of(p, "$.id")))
    heads = _heads(named, first_user=F.col("said"), cwd=text_of(p, "$.cwd"), git_branch=text_of(p, "$.git.branch"), declared_model=F.col("declared"), surface=text_of(p, "$.originator"), forked_from=text_of(p, "$.forked_from_id"))
    return _finish(source, heads.join(out.select("file").distinct(), "file", "left_semi"), out)


# Content types of a chat export that hold what a tool returned.
TOOL_CONTENT = ["execution_output", "tether_quote", "tether_browsing_display", "system_error", "computer_output"]


def chat_export(spark: SparkSession, path: str, source: str = "chat-export") -> tuple[DataFrame, DataFrame]:
    """Conversations as maps of nodes, walked before their children from sorted roots, then what no root reaches, by id.

    Depth-first order comes from ``walks.preorder``: no conversation is gathered in one row or task.
    """
    root = files(spark, path).withColumn("v", F.try_parse_json("content"))
    kind, listed = F.schema_of_variant("v"), _part(F.col("v"), "$.conversations")
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).when(listed.isNotNull(), F.try_variant_get("v", "$.conversations", "array<variant>")).otherwise(F.array("v"))
    c = F.col("c")
    convs = root.where("v is not null").select("file", F.explode(items).alias("c")).withColumn("native_id", F.coalesce(F.nullif(text_of(c, "$.id"), F.lit("")), F.nullif(text_of(c, "$.conversation_id"), F.lit(""))))
    convs = convs.where("native_id is not null").where(_part(c, "$.mapping").isNotNull())
    nodes = convs.select("native_id", F.explode(F.try_variant_get(c, "$.mapping", "map<string,variant>")).alias("node", "n"))
    n = F.col("n")
    links = nodes.select("native_id", "node", F.posexplode(F.try_variant_get(n, "$.children", "array<string>")).alias("ord", "child"))
    first_link = links.groupBy("native_id", F.col("child").alias("node")).agg(F.min_by(F.struct(F.col("node").alias("up"), "ord"), F.struct("node", "ord")).alias("l")).select("native_id", "node", "l.up", "l.ord")
    placed = nodes.select("native_id", "node").join(first_link, ["native_id", "node"], "left")
    walked = preorder(placed, "native_id")
    m = _part(n, "$.message")
    facts = nodes.select(
        "native_id", "node", text_of(m, "$.author.role").alias("r"), F.coalesce(text_of(m, "$.content.content_type"), F.lit("")).alias("ctype"), F.coalesce(text_of(m, "$.recipient"), F.lit("all")).alias("to"),
        F.coalesce(F.try_variant_get(m, "$.metadata.is_visually_hidden_from_conversation", "boolean"), F.lit(False)).alias("hidden"), m.alias("m"), text_of(n, "$.parent").alias("parent"),
    )
    thought = F.col("ctype").isin("thoughts", "reasoning_recap")
    parts = F.filter(F.transform(F.try_variant_get("m", "$.content.parts", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", text_of(x)).otherwise(text_of(x, "$.text"))), lambda x: x.isNotNull() & (F.trim(x) != ""))
    field = lambda k: F.when(F.schema_of_variant(_part(F.col("m"), f"$.content.{k}")) == "STRING", text_of(F.col("m"), f"$.content.{k}"))
    thoughts = F.array_join(F.filter(F.flatten(F.transform(F.try_variant_get("m", "$.content.thoughts", "array<variant>"), lambda x: F.array(text_of(x, "$.summary"), text_of(x, "$.content")))), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), "\n")
    text = F.when(F.col("ctype") == "thoughts", thoughts).when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise(F.concat_ws("\n", field("text"), field("result"), field("content")))
    known = F.col("r").isin("user", "assistant", "tool", "system") & (thought | ~((F.col("r") == "system") | F.col("hidden")))
    facts = facts.withColumn("text", F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")).withColumn("emitted", F.coalesce(known, F.lit(False)) & (F.col("text") != ""))
    scope = lambda col: F.when(F.col(col).isNotNull(), F.concat_ws("|", "native_id", col))
    full = facts.join(walked, ["native_id", "node"])
    above = reparent(full.select(scope("node").alias("id"), scope("up").alias("parent_id"), "emitted"))
    said = _number(full.where("emitted"), ["native_id"], ["walk"]).withColumn("id", scope("node")).join(above.select("id", F.col("parent_id").alias("above")), "id", "left")
    out_kind = F.when(thought, "reasoning").when((F.col("r") == "tool") | F.col("ctype").isin(TOOL_CONTENT), "tool_result").when((F.col("r") == "assistant") & ((F.col("ctype") == "code") | (F.col("to") != "all")), "tool_call").otherwise("prose")
    seconds = F.coalesce(F.try_variant_get("m", "$.create_time", "double"), F.try_variant_get("m", "$.update_time", "double"))
    rows = said.select(
        F.col("native_id").alias("file"), F.col("node").alias("native"), F.element_at(F.split("above", r"\|"), -1).alias("parent_id"), F.lit("main").alias("thread_key"), F.lit(False).alias("is_sidechain"), "seq",
        F.col("r").alias("role"), out_kind.alias("kind"), F.round(seconds * 1000).cast("long").alias("ts_ms"), F.lit(False).alias("is_error"), F.when(F.col("r") == "assistant", model_name(text_of(F.col("m"), "$.metadata.model_slug"))).alias("model"), "text",
    )
    # The head: the nearest message at or above the current node.
    heads_at = convs.select("native_id", text_of(c, "$.current_node").alias("node"), F.nullif(text_of(c, "$.title"), F.lit("")).alias("title"), model_name(text_of(c, "$.default_model_slug")).alias("declared"))
    skipped = reparent(full.select(scope("node").alias("id"), scope("up").alias("parent_id"), "emitted").union(heads_at.where("node is not null").select(F.concat_ws("|", "native_id", F.lit("head")), scope("node"), F.lit(True))))
    head = skipped.where(F.col("id").endswith("|head")).select(F.element_at(F.split("id", r"\|"), 1).alias("native_id"), F.element_at(F.split("parent_id", r"\|"), -1).alias("head"))
    title = rows.where("role = 'user' and kind = 'prose'").groupBy(F.col("file").alias("native_id")).agg(F.min_by(clipped_title(F.col("text")), "seq").alias("said"))
    named = heads_at.join(head, "native_id", "left").join(title, "native_id", "left").withColumn("file", F.col("native_id"))
    return _finish(source, _heads(named, custom=F.col("title"), first_user=F.col("said"), declared_model=F.col("declared"), head=F.col("head")), rows)


def session_json(spark: SparkSession, path: str, source: str = "session-json") -> tuple[DataFrame, DataFrame]:
    """One object with sessionId and messages; all prose, in a chain."""
    v, x = F.col("v"), F.col("x")
    roots = files(spark, path).withColumn("v", F.try_parse_json("content")).withColumn("native_id", text_of(v, "$.sessionId"))
    each = roots.where("native_id <> ''").select("file", F.posexplode(F.try_variant_get(v, "$.messages", "array<variant>")).alias("place", "x"))
    rows = each.withColumn("text", F.regexp_replace(flatten(_part(x, "$.content")), r"^\s+|\s+$", "")).where("text <> ''")
    role = F.when(text_of(x, "$.type") == "user", "user").when(text_of(x, "$.type") == "gemini", "assistant").otherwise("system")
    rows = _number(rows, ["file"], ["place"]).withColumn("native", text_of(x, "$.id")).withColumn("role", role)
    rows = _chain(_unique(rows, ["file"], F.concat(F.lit("msg-"), F.lpad(F.col("seq").cast("string"), 6, "0"))), ["file"])
    out = rows.select("file", "native", "parent_id", F.col("file").alias("thread_key"), F.lit(False).alias("is_sidechain"), "seq", "role", F.lit("prose").alias("kind"), instant(text_of(x, "$.timestamp")).alias("ts_ms"), F.lit(False).alias("is_error"), F.when(F.col("role") == "assistant", model_name(text_of(x, "$.model"))).alias("model"), "text")
    title = out.where("role = 'user'").groupBy("file").agg(F.min_by(F.substring(squeeze(F.col("text")), 1, 80), "seq").alias("said"))
    return _finish(source, _heads(roots.join(title, "file", "left").join(out.select("file").distinct(), "file", "left_semi"), first_user=F.col("said")), out)


def activity_log(spark: SparkSession, path: str, source: str = "activity") -> tuple[DataFrame, DataFrame]:
    """Records with a time, each a conversation of a prompt and a response."""
    from convlens.functions.text import slug

    v, x = F.col("v"), F.col("x")
    roots = files(spark, path).withColumn("v", F.try_parse_json("content"))
    records = roots.where(F.schema_of_variant("v").startswith("ARRAY")).select("file", F.explode(F.try_variant_get(v, "$", "array<variant>")).alias("x")).withColumn("native_id", text_of(x, "$.time")).where("native_id <> ''")
    title = F.trim(F.coalesce(text_of(x, "$.title"), F.lit("")))
    named = F.trim(F.regexp_extract(title, r"(?s) titled(.*)$", 1))
    link = title.contains(" titled") & ((named == "") | F.rlike(named, F.lit("^https?://")))
    prompt = F.when(title.startswith("Prompted "), F.trim(F.substring(title, 10, 2**30))).when(title.startswith("Used ") | title.startswith("Gave feedback") | link, "").otherwise(title)
    trailer = lambda body, tag, listed: F.when(F.size(listed) > 0, F.concat(body, F.when(body != "", F.lit("\n")).otherwise(""), F.lit(f"[{tag}: "), F.array_join(listed, ", "), F.lit("]"))).otherwise(body)
    attached = F.coalesce(F.try_variant_get(x, "$.attachedFiles", "array<string>"), F.expr("cast(array() as array<string>)"))
    html = F.array_join(F.filter(F.transform(F.try_variant_get(x, "$.safeHtmlItem", "array<variant>"), lambda i: text_of(i, "$.html")), lambda h: h.isNotNull()), "\n")
    answer = F.coalesce(html_to_text(html), F.lit(""))
    answer = F.when(answer.startswith("Your prompt:\n"), F.regexp_replace(answer, r"(?s)^Your prompt:\n.*?\nSearch's response:[ \t]*(\n|$)", "")).otherwise(answer)
    urls = F.array_distinct(F.filter(F.transform(F.coalesce(F.try_variant_get(x, "$.subtitles", "array<variant>"), F.expr("cast(array() as array<variant>)")), lambda i: text_of(i, "$.url")), lambda u: F.rlike(u, F.lit("^https?://"))))
    told = records.select("file", "native_id", slug(text_of(x, "$.header")).alias("surface"), prompt.alias("prompt"), trailer(prompt, "attached", attached).alias("user_text"), trailer(answer, "sources", urls).alias("assistant_text"))
    told = told.withColumn("folder", F.col("file")).withColumn("file", F.concat_ws("|", "file", "native_id"))
    row = lambda native, seq, role, text, parent: F.struct(F.lit(native).alias("native"), F.lit(seq).alias("seq"), F.lit(role).alias("role"), F.col(text).alias("text"), parent.alias("parent_id"))
    both = told.select("file", "folder", "native_id", F.explode(F.array(row("prompt", 0, "user", "user_text", F.lit(None).cast("string")), row("response", 1, "assistant", "assistant_text", F.when(F.col("user_text") != "", "prompt")))).alias("m")).where("m.text <> ''")
    out = both.select("file", "m.native", "m.parent_id", F.col("folder").alias("thread_key"), F.lit(False).alias("is_sidechain"), "m.seq", "m.role", F.lit("prose").alias("kind"), instant(F.col("native_id")).alias("ts_ms"), F.lit(False).alias("is_error"), F.lit(None).cast("string").alias("model"), "m.text")
    heads = _heads(told, first_user=F.nullif(F.substring(squeeze(F.col("prompt")), 1, 80), F.lit("")), surface=F.col("surface"))
    return _finish(source, heads.join(out.select("file").distinct(), "file", "left_semi"), out)


def turn_list(spark: SparkSession, path: str, source: str = "turn-list") -> tuple[DataFrame, DataFrame]:
    """conversation_turns of user_turn and system_turn; the id is in the file's name."""
    v, x = F.col("v"), F.col("x")
    name = F.regexp_replace(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.txt$", ""), "^conversation_", "")
    roots = files(spark, path).withColumn("v", F.try_parse_json("content")).withColumn("native_id", name)
    each = roots.select("file", F.posexplode(F.try_variant_get(v, "$.conversation_turns", "array<variant>")).alias("place", "x"))
    is_user, is_system = _part(x, "$.user_turn").isNotNull(), _part(x, "$.system_turn").isNotNull()
    items = F.flatten(F.transform(F.try_variant_get(x, "$.system_turn.text", "array<variant>"), lambda i: F.array(F.trim(text_of(i, "$.preamble")), F.trim(text_of(i, "$.data")))))
    text = F.when(is_user, F.coalesce(text_of(x, "$.user_turn.prompt"), F.lit(""))).when(is_system, F.array_join(F.filter(items, lambda t: t != ""), "\n"))
    rows = _number(each.withColumn("text", F.regexp_replace(text, r"^\s+|\s+$", "")).where("text <> ''"), ["file"], ["place"])
    rows = _chain(rows.withColumn("native", F.concat(F.lit("turn-"), F.lpad(F.col("seq").cast("string"), 4, "0"))), ["file"])
    stamp = F.coalesce(text_of(x, "$.user_turn.turn_last_modified"), text_of(x, "$.system_turn.turn_last_modified"))
    out = rows.select("file", "native", "parent_id", F.col("file").alias("thread_key"), F.lit(False).alias("is_sidechain"), "seq", F.when(is_user, "user").otherwise("assistant").alias("role"), F.lit("prose").alias("kind"), instant(stamp).alias("ts_ms"), F.lit(False).alias("is_error"), F.lit(None).cast("string").alias("model"), "text")
    title = out.where("role = 'user'").groupBy("file").agg(F.min_by(F.substring(squeeze(F.col("text")), 1, 80), "seq").alias("said"))
    heads = _heads(roots.join(title, "file", "left").join(out.select("file").distinct(), "file", "left_semi"), generated=F.nullif(F.substring(squeeze(text_of(v, "$.title")), 1, 80), F.lit("")), first_user=F.col("said"), surface=F.lit("workspace"))
    return _finish(source, heads, out)


def transcript_html(spark: SparkSession, path: str, source: str = "notebook") -> tuple[DataFrame, DataFrame]:
    """Lines that begin with USER: or MODEL: open a block, other lines go on with it; no instants."""
    folder = F.split("file", "/")
    stem = F.regexp_replace(F.element_at(folder, -1), r"\.(html|HTML)$", "")
    whole = files(spark, path).withColumn("native_id", F.trim(F.element_at(F.split(stem, " - "), -1))).withColumn("notebook", F.when(F.size(folder) > 2, F.element_at(folder, -3)))
    each = whole.select("file", F.posexplode(F.split("content", "\r?\n")).alias("place", "line"))
    opens = F.rlike("line", F.lit("^(USER|MODEL):"))
    numbered = each.withColumn("block", F.sum(opens.cast("int")).over(Window.partitionBy("file").orderBy("place"))).where("block > 0")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: F.regexp_replace(x["line"], r"^(USER|MODEL):\s*", "")), "\n")
    blocks = numbered.groupBy("file", "block").agg(F.min_by("line", "place").startswith("USER:").alias("user"), body.alias("html"))
    # Line breaks of the file are breaks of the text here, so they go in as elements.
    rows = blocks.withColumn("text", html_to_text(F.regexp_replace("html", "\n", "<br>"))).where("text <> ''")
    rows = _number(rows, ["file"], ["block"]).withColumn("native", F.concat(F.lit("turn-"), F.lpad(F.col("seq").cast("string"), 4, "0")))
    out = _chain(rows, ["file"]).select("file", "native", "parent_id", F.col("file").alias("thread_key"), F.lit(False).alias("is_sidechain"), "seq", F.when(F.col("user"), "user").otherwise("assistant").alias("role"), F.lit("prose").alias("kind"), F.lit(None).cast("long").alias("ts_ms"), F.lit(False).alias("is_error"), F.lit(None).cast("string").alias("model"), "text")
    title = out.where("role = 'user'").groupBy("file").agg(F.min_by(F.substring(squeeze(F.col("text")), 1, 80), "seq").alias("said"))
    return _finish(source, _heads(whole.join(title, "file", "left").join(out.select("file").distinct(), "file", "left_semi"), generated=F.nullif(F.substring(squeeze(F.col("notebook")), 1, 80), F.lit("")), first_user=F.col("said"), surface=F.lit("notebook")), out)


def state_and_audit(spark: SparkSession, path: str, source: str = "desktop") -> tuple[DataFrame, DataFrame]:
    """local_ID.json gives title and model, local_ID/audit.jsonl the messages; both make one conversation when merged by id."""
    v = F.col("v")
    session = F.regexp_extract("file", r"/local_([^/]+?)(?:\.json)?(?:/|$)", 1)
    states = files(spark, path).where(F.rlike("file", F.lit(r"/local_[^/]+\.json$"))).withColumn("v", F.try_parse_json("content")).withColumn("native_id", session)
    states = states.where(text_of(v, "$.sessionId") == F.concat(F.lit("local_"), F.col("native_id")))
    state_heads = _heads(states, generated=F.nullif(F.substring(squeeze(text_of(v, "$.title")), 1, 80), F.lit("")), declared_model=model_name(text_of(v, "$.model")))
    records = json_lines(spark, f"{path}/*/audit.jsonl").withColumn("type", F.coalesce(text_of(v, "$.type"), F.lit("")))
    is_turn = F.col("type").isin("user", "assistant")
    skip = is_turn & (F.coalesce(F.try_variant_get(v, "$.isReplay", "boolean"), F.lit(False)) | F.coalesce(F.try_variant_get(v, "$.isSynthetic", "boolean"), F.lit(False)))
    said = model_name(F.when(is_turn, text_of(v, "$.message.model")).otherwise(text_of(v, "$.model")))
    carried = records.where(~skip).withColumn("model", F.last(said, ignorenulls=True).over(Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    blocks = _typed(carried.where(is_turn).select("*", F.posexplode(_blocks(v)).alias("at", "b")))
    nth = F.row_number().over(Window.partitionBy("file", "place").orderBy("at")) - 1
    base = F.nullif(text_of(v, "$.uuid"), F.lit(""))
    rows = _number(blocks, ["file"], ["place", "at"]).withColumn("nth", nth).withColumn("native", F.when(F.col("nth") == 0, base).otherwise(F.concat(base, F.lit("#"), F.col("nth").cast("string"))))
    rows = _chain(_unique(rows, ["file"], F.concat(F.lit("msg-"), F.lpad(F.col("seq").cast("string"), 6, "0"))), ["file"])
    stamp = F.coalesce(text_of(v, "$._audit_timestamp"), text_of(v, "$.timestamp"))
    out = rows.select("file", "native", "parent_id", F.col("file").alias("thread_key"), _part(v, "$.parent_tool_use_id").isNotNull().alias("is_sidechain"), "seq", "role", "kind", instant(stamp).alias("ts_ms"), "is_error", F.when(F.col("role") == "assistant", F.col("model")).alias("model"), "text")
    title = out.where("role = 'user' and kind = 'prose'").groupBy("file").agg(_first(session_title(F.col("text")), "seq").alias("said"))
    last_model = carried.groupBy("file").agg(_last(F.col("model")).alias("declared"))
    audits = out.select("file").distinct().withColumn("native_id", session).join(title, "file", "left").join(last_model, "file", "left")
    heads = state_heads.unionByName(_heads(audits, first_user=F.col("said"), declared_model=F.col("declared")))
    return _finish(source, heads, out)


def union(*parts: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Several sources as one corpus, for merge_conversations and merge_messages to fold by id."""
    return reduce(DataFrame.unionByName, [p[0] for p in parts]), reduce(DataFrame.unionByName, [p[1] for p in parts])
