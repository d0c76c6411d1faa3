"""Titles from what a user first wrote, without what tools put there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convlens.functions.text import squeeze

# Tags that go with all they hold, commands whose arguments are settings, notices and headings.
DROPPED_TAGS = [
    "command-message",
    "command-name",
    "command-contents",
    "local-command-stdout",
    "local-command-stderr",
    "local-command-caveat",
    "system-reminder",
    "system_reminder",
    "ide_opened_file",
    "ide_selection",
    "ide_diagnostics",
]
SETTING_COMMANDS = ["/model", "/fast"]
NOTICES = ["[Request interrupted by user for tool use]", "[Request interrupted by user]"]
CONTEXT_HEADINGS = ["# Context from my IDE setup:", "# Files mentioned by the user:"]
REQUEST_HEADING = "## My request for Codex:"


def session_title(text: Column, most: int = 80) -> Column:
    """Injected tags gone with their bodies, command arguments kept unless they are settings, notices gone; null if nothing is left."""
    setting = F.lit(False)
    for name in SETTING_COMMANDS:
        setting = setting | text.contains(f"<command-name>{name}</command-name>")
    args = lambda put: F.regexp_replace(text, r"(?s)<command-args>(.*?)</command-args>", put)
    out = F.when(setting, args("")).otherwise(args(" $1 "))
    for tag in DROPPED_TAGS:
        out = F.regexp_replace(out, rf"(?s)<{tag}>.*?</{tag}>", "")
    out = F.regexp_replace(out, f"<({'|'.join([*DROPPED_TAGS, 'command-args'])})>", "")
    for notice in NOTICES:
        out = F.replace(out, F.lit(notice), F.lit(" "))
    return F.nullif(F.substring(squeeze(out), 1, most), F.lit(""))


def rollout_title(text: Column, most: int = 80) -> Column:
    """Below an editor's context the request alone; a command line is no title; links to skills become their names."""
    first = F.rtrim(F.substring_index(F.ltrim(text), "\n", 1))
    request = F.regexp_extract(text, rf"(?s)(?:^|\n){REQUEST_HEADING}[ \t\r]*(?:\n(.*))?$", 1)
    own = F.when(first.isin(CONTEXT_HEADINGS), request).otherwise(text)
    command = F.rlike(F.trim(own), F.lit(r"^/[a-z][a-z0-9-]*(?:[^\S\n][^\n]*)?$"))
    named = F.regexp_replace(own, r"\[\$([\p{L}\p{N}_:-]+)\]\([^)]*\)", " $1 ")
    return F.when(~command, F.nullif(F.substring(squeeze(named), 1, most), F.lit("")))


def clipped_title(text: Column, most: int = 80) -> Column:
    flat = squeeze(text)
    return F.nullif(F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat), F.lit(""))
