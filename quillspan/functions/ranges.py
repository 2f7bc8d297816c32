"""Ranges of a document: full, lines, a heading's section, tokens, or custom (which is full)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, item, token_range

HEADING = r"^[ \t]*(#+)"
#: What a number past 64 bits counts as.
MOST = 2**63 - 1


def parse_range(spec: Column) -> Column:
    """Struct kind, first, last, path, raw.  ``45`` is one line (documented divergence: not custom)."""
    s = F.trim(F.coalesce(spec, F.lit("")))
    tokens, lines, one = r"^T(\d+):(\d+)$", r"^L?(\d+)-L?(\d+)$", r"^L?(\d+)$"

    def made(kind: str, first: Column | None = None, last: Column | None = None, path: Column | None = None) -> Column:
        number = lambda c: F.coalesce(c.try_cast("long"), F.lit(MOST)) if c is not None else F.lit(None).cast("long")
        return F.struct(F.lit(kind).alias("kind"), number(first).alias("first"), number(last).alias("last"), (path if path is not None else F.lit(None)).cast("array<string>").alias("path"), s.alias("raw"))

    group = lambda pattern, g: F.regexp_extract(s, pattern, g)
    return (
        F.when((F.lower(s) == "full") | (s == ""), made("full"))
        .when(F.startswith(s, F.lit("#")), made("heading", path=F.transform(F.split(F.substring(s, F.lit(2), F.length(s)), "/"), F.trim)))
        .when(s.rlike(tokens), made("tokens", group(tokens, 1), group(tokens, 2)))
        .when(s.rlike(lines), made("lines", group(lines, 1), group(lines, 2)))
        .when(s.rlike(one), made("lines", group(one, 1), group(one, 1)))
        .otherwise(made("custom"))
    )


def locator(parsed: Column) -> Column:
    first, last = parsed["first"].cast("string"), parsed["last"].cast("string")
    return F.when(parsed["kind"] == "full", "full").when(parsed["kind"] == "lines", F.concat(first, F.lit("-"), last)).when(parsed["kind"] == "heading", F.concat(F.lit("#"), F.array_join(parsed["path"], "/"))).when(parsed["kind"] == "tokens", F.concat(F.lit("T"), first, F.lit(":"), last)).otherwise(parsed["raw"])


def text_lines(text: Column) -> Column:
    """Lines without their ends; a final line end begins no further line."""
    return F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")


def heading_section(text: Column, heading: Column) -> Column:
    """From the first heading with this text to the next of its level or above; empty if there is none."""
    lines = text_lines(text)
    told = F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, HEADING, 1)).alias("level"), F.trim(F.regexp_replace(x, r"^[ \t]*#+", "")).alias("title"), x.alias("line")))
    at = lambda marks: F.coalesce(F.array_position(marks, True), F.lit(0)).cast("int")

    def section(t: Column) -> Column:
        opens = at(F.transform(t, lambda x: (x["level"] > 0) & F.coalesce(x["title"] == heading, F.lit(False))))
        level, rest = item(t, F.greatest(opens, F.lit(1)))["level"], F.slice(t, opens + 1, F.size(t))
        closes = at(F.transform(rest, lambda x: (x["level"] > 0) & (x["level"] <= level)))
        count = F.when(closes > 0, closes).otherwise(F.size(t))
        return F.when(opens > 0, F.array_join(F.transform(F.slice(t, opens, count), lambda x: x["line"]), "\n")).otherwise("")

    return bound(told, section)


def apply_range(text: Column, parsed: Column) -> Column:
    """The part of ``text``; lines that end before they begin, or lie past the end, are empty."""
    lines = text_lines(text)
    first = F.greatest(parsed["first"], F.lit(1))
    count = F.greatest(F.least(parsed["last"], F.size(lines).cast("long")) - first + 1, F.lit(0)).cast("int")
    cut = F.array_join(F.slice(lines, first.cast("int"), count), "\n")
    return (
        F.when(parsed["kind"] == "lines", F.when(first > F.size(lines), "").otherwise(cut))
        .when(parsed["kind"] == "tokens", token_range(text, *(F.least(parsed[x], F.lit(2**31 - 2)).cast("int") for x in ("first", "last"))))
        .when(parsed["kind"] == "heading", F.when(F.size(parsed["path"]) > 0, heading_section(text, item(parsed["path"], -1))).otherwise(text))
        .otherwise(text)
    )


def stub_descriptor(summary: Column, outline: Column) -> Column:
    return F.when(F.size(outline) > 0, F.concat(summary, F.lit("\nOutline: "), F.array_join(outline, ", "))).otherwise(summary)


def read_range(text: Column, spec: Column, summary: Column, outline: Column) -> Column:
    """``stub`` reads the descriptor, anything else a range of the body."""
    return F.when(spec == "stub", stub_descriptor(summary, outline)).otherwise(apply_range(text, parse_range(spec)))


def body_slice(content: Column, offset: Column, length: Column) -> Column:
    """The bytes from ``offset`` (0 first) as text."""
    return F.decode(F.substring(F.encode(content, "UTF-8"), (offset + 1).cast("int"), length.cast("int")), "UTF-8")
