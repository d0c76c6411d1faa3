"""Text columns: words, accents, clipping, white space, HTML to plain text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _marked() -> dict[str, str]:
    """Lower-case Latin letters that are a plain letter with marks, and that letter."""
    parts = {c: unicodedata.normalize("NFD", c) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower()}
    return {c: p[0] for c, p in parts.items() if len(p) > 1 and "a" <= p[0] <= "z"}


#: Letters with marks and what they fold to; the combining marks at the end fold to nothing.
MARKED = "".join(_marked()) + "".join(map(chr, range(0x300, 0x370)))
PLAIN = "".join(_marked().values())


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin letters, whether they are one character or have combining marks."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def tokenize(text: Column) -> Column:
    """array<string> of words of letters and digits, folded."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def clip_bytes(text: Column, n: int, marker: str = "…[%d bytes dropped]") -> Column:
    """At most ``n`` UTF-8 bytes, cut between characters, and a marker that says how many bytes are gone. 0 gives ''."""
    if n == 0:
        return F.lit("")
    bytes_ = F.encode(text, "UTF-8")
    # The first byte that is gone must not continue a character: step back over at most three.
    at = lambda k: F.conv(F.hex(F.substring(bytes_, k + 1, 1)), 16, 10).cast("int").between(128, 191)
    cut = F.when(~at(n), n).when(~at(n - 1), n - 1).when(~at(n - 2), n - 2).otherwise(n - 3)
    kept = F.decode(F.substring(bytes_, F.lit(1), cut), "UTF-8")
    return F.when(F.octet_length(text) <= n, text).otherwise(
        F.concat(kept, F.format_string(marker.replace("%d", "%s"), (F.octet_length(text) - cut).cast("string")))
    )


def squeeze(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


# Elements whose ends break a line, and the named entities that are decoded, ampersand last.
BLOCKS = "p|div|section|article|header|footer|ul|ol|table|tr|h1|h2|h3|h4|h5|h6|pre|blockquote|title|nav|main|aside|form|dl|dt|dd"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def html_to_text(html: Column) -> Column:
    """Tags dropped; list items get '- ', cells ' | ', rules '---', line breaks for br and blocks; blank and bare lines dropped."""
    out = F.regexp_replace(html, r"[\r\n]+", " ")
    for pattern, put in (
        (r"(?i)<(script|style)\b[^>]*>.*?</\1\s*>", " "),
        (r"(?i)<!--.*?-->", ""),
        (r"(?i)<li\b[^>]*>", "\n- "),
        (r"(?i)</(td|th)\s*>", " | "),
        (r"(?i)<hr\b[^>]*>", "\n---\n"),
        (r"(?i)<br\b[^>]*>", "\n"),
        (rf"(?i)</?({BLOCKS})\b[^>]*>", "\n"),
        (r"<[^>]*>", ""),
    ):
        out = F.regexp_replace(out, pattern, put)
    for name, put in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(put))
    lines = F.transform(F.split(out, "\n"), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"[ \t]+", " ")), r"( \|)+$", ""))
    return F.array_join(F.filter(lines, lambda x: (x != "") & (x != "-")), "\n")
