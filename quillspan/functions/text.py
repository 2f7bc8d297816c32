"""Word, token and term expressions, all in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space.
SPACE = r"[\t-\r \x{85}\p{Z}]+"
#: Words that carry no topic.  Fixed values.
STOPWORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "has", "was", "one", "our", "out", "his", "her", "had", "how", "its", "may", "who", "did", "get", "let", "say", "she", "too",
    "use", "way", "with", "this", "that", "from", "have", "been", "they", "them", "then", "than", "each", "which", "their", "will", "would", "there", "what", "about", "could", "other", "into",
    "more", "some", "very", "when", "also", "just", "should",
)
#: Places inside an alphanumeric run where a subword begins: before capitals, before the last
#: capital of an acronym, between letters and digits.  Applied in this order, with a mark between.
SUBWORD_BREAKS = (r"([\p{L}\p{N}&&\P{Lu}])(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{L})([0-9])", r"([0-9])(\p{L})")
BREAK = "\x01"


def words(text: Column) -> Column:
    """Words between white space; none for empty or null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def item(array: Column, at: int | Column) -> Column:
    """Element ``at`` (1 first, -1 last); null where there is none."""
    return F.try_element_at(array, at if isinstance(at, Column) else F.lit(at))


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once: inside a lambda an expression is computed at each step."""
    return item(F.transform(F.array(value), f), 1)


def token_count(text: Column) -> Column:
    """White-space tokens, 1 at least."""
    return F.greatest(F.size(words(text)), F.lit(1)).cast("long")


def token_range(text: Column, start: Column, count: Column) -> Column:
    """``count`` white-space tokens from ``start`` (0 first), joined by a space; clamped."""
    return F.array_join(F.slice(words(text), start + 1, count), " ")


def cheap_tokens(text: Column) -> Column:
    """A third of the bytes: no text has more tokens than that by much, and it costs nothing."""
    return F.floor(F.octet_length(text) / 3).cast("long")


def clipped(text: Column, limit: int, keep: int | None = None, mark: str = "...") -> Column:
    """``text`` if it has at most ``limit`` bytes, else its first ``keep`` characters and ``mark``."""
    keep = limit - len(mark) if keep is None else keep
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, keep), F.lit(mark)))


def index_tokens(text: Column) -> Column:
    """Index terms: each alphanumeric run in lower case, then its subwords if it has several.

    Terms of one byte are left out.
    """

    marked = F.translate(F.coalesce(text, F.lit("")), BREAK, " ")
    for pattern in SUBWORD_BREAKS:  # over the whole text, not run by run
        marked = F.regexp_replace(marked, pattern, f"$1{BREAK}$2")
    runs = F.regexp_extract_all(F.lower(marked), F.lit(rf"[\p{{L}}\p{{N}}{BREAK}]+"), F.lit(0))

    def expanded(run: Column) -> Column:
        several = F.concat(F.array(F.replace(run, F.lit(BREAK), F.lit(""))), F.split(run, BREAK))
        return F.when(F.contains(run, F.lit(BREAK)), several).otherwise(F.array(run))

    return F.filter(F.flatten(F.transform(runs, expanded)), lambda t: F.octet_length(t) > 1)


def run_terms(run: Column) -> Column:
    """Index terms of one alphanumeric run, an array; most runs have no subwords and are told apart cheaply."""
    low, rest, letters = F.lower(run), F.substring(run, 2, 2**31 - 1), F.translate(run, "0123456789", "")
    marked = run
    for pattern in SUBWORD_BREAKS:
        marked = F.regexp_replace(marked, pattern, f"$1{BREAK}$2")
    parts = F.split(F.lower(marked), BREAK)
    several = F.when(F.size(parts) > 1, F.concat(F.array(low), parts)).otherwise(F.array(low))
    return F.when((F.lower(rest) == rest) & ((letters == run) | (letters == "")), F.array(low)).otherwise(several)


def topic_tokens(text: Column) -> Column:
    """Lower-case alphanumeric runs of more than two bytes that are no stopwords."""
    stop = F.array(*map(F.lit, STOPWORDS))
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: (F.octet_length(t) > 2) & ~F.array_contains(stop, t))


def bare_words(text: Column) -> Column:
    """Distinct white-space words, lower case, without what is not alphanumeric."""
    bare = F.transform(words(F.lower(text)), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return F.array_distinct(F.filter(bare, lambda w: w != ""))


def plain_terms(text: Column) -> Column:
    """Distinct lower-case alphanumeric runs of more than two bytes, stopwords included."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared terms over the smaller set; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def jaccard_words(a: Column, b: Column) -> Column:
    return jaccard(bare_words(a), bare_words(b))


def overlap_topics(a: Column, b: Column) -> Column:
    return overlap_coefficient(F.array_distinct(topic_tokens(a)), F.array_distinct(topic_tokens(b)))


def overlap_plain(a: Column, b: Column) -> Column:
    return overlap_coefficient(plain_terms(a), plain_terms(b))


def path_matches(path: Column, wanted: Column) -> Column:
    """Equal, or one ends the other after a slash."""
    return (path == wanted) | path.endswith(F.concat(F.lit("/"), wanted)) | wanted.endswith(F.concat(F.lit("/"), path))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def quote_grounded(quote: Column, source: Column) -> Column:
    """A quote of ten characters or more that the source holds, apart from case and white space."""
    q = squeezed(quote)
    return (F.length(q) >= 10) & F.contains(squeezed(source), q)


def document_type(path: Column) -> Column:
    low = F.lower(path)
    kind = F.when(F.contains(low, F.lit("changelog")), "changelog")
    for mark in ("copyright", "readme", "news"):
        kind = kind.when(F.contains(low, F.lit(mark)), mark)
    return kind.otherwise("doc")


def stamp(seconds: Column) -> Column:
    """Unix seconds as YYYYMMDD-HHMMSS in UTC (the session's time zone)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyyMMdd-HHmmss")
