"""The text protocol between model and workspace: probes, notes, thinking, references, loops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, bound, item, words

IM_START, IM_END = "<|im_start|>", "<|im_end|>"
#: Fixed patterns of the protocol.
LINE_REFERENCE = r"((?:[\w./\-]+/)?[\w\-]+\.[a-zA-Z]+):(\d+)(?:-(\d+))?"
NOTE = r'<note id="([^"]+)">(.*?)</note>'


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def probes(text: Column) -> Column:
    """Structs text, position (byte offset of the tag) of each probe within one line."""
    whole, inner = _all(text, "<probe>(.*?)</probe>", 0), _all(text, "<probe>(.*?)</probe>", 1)
    # the n-th tag lies after the n-1 tags before it: walk the text from tag to tag
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<int>").alias("found"))

    def step(state: Column, tag: Column) -> Column:
        at = F.call_function("locate", tag, text, state["at"] + 1)
        return F.struct((at + F.length(tag) - 1).cast("int").alias("at"), F.concat(state["found"], F.array(at.cast("int"))).alias("found"))

    places = F.aggregate(whole, start, step, lambda s: s["found"])
    return F.transform(F.arrays_zip(inner.alias("a"), places.alias("b")), lambda z: F.struct(z["a"].alias("text"), F.octet_length(F.left(text, z["b"] - 1)).cast("long").alias("position")))


def annotations(text: Column) -> Column:
    """Structs id, content of each note."""
    return F.transform(F.arrays_zip(_all(text, NOTE, 1).alias("a"), _all(text, NOTE, 2).alias("b")), lambda z: F.struct(z["a"].alias("id"), z["b"].alias("content")))


def tagged_thinking(text: Column) -> Column:
    return _all(text, r"(?s)<think>(.*?)</think>", 1)


def heuristic_steps(text: Column) -> Column:
    """Steps of untagged thinking.

    A line that is blank, begins with a number and has a full stop, or begins with Therefore,
    Thus or So ends the step before it and is itself left out; without a step before it, a
    non-blank one begins one.  Steps of more than 20 bytes stay.
    """
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    empty = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("steps"))

    def step(state: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, "^" + SPACE, "")
        blank = bare == ""
        boundary = blank | (bare.rlike(r"^\p{N}") & F.contains(line, F.lit("."))) | F.startswith(bare, F.lit("Therefore")) | F.startswith(bare, F.lit("Thus")) | F.startswith(bare, F.lit("So"))
        closes = boundary & (state["held"] != "")
        held = F.when(closes, F.lit("")).when(blank, state["held"]).otherwise(F.concat(state["held"], line, F.lit("\n")))
        return F.struct(held.alias("held"), F.when(closes, F.concat(state["steps"], F.array(trimmed(state["held"])))).otherwise(state["steps"]).alias("steps"))

    found = F.aggregate(lines, empty, step, lambda s: F.when(s["held"] != "", F.concat(s["steps"], F.array(trimmed(s["held"])))).otherwise(s["steps"]))
    return F.filter(found, lambda s: F.octet_length(s) > 20)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def thinking_steps(text: Column) -> Column:
    tagged = tagged_thinking(text)
    return F.when(F.size(tagged) > 0, tagged).otherwise(heuristic_steps(text))


def split_thinking(text: Column) -> Column:
    """Struct thinking, answer; an unclosed block is all thinking, an empty one none."""
    opened, closed = F.instr(text, "<think>"), F.instr(text, "</think>")
    inner = trimmed(F.substring(text, opened + 7, closed - opened - 7))
    whole = (opened > 0) & (closed > opened)
    return F.when(whole, F.struct(F.nullif(inner, F.lit("")).alias("thinking"), trimmed(F.substring(text, closed + 8, F.length(text))).alias("answer"))).when(opened > 0, F.struct(trimmed(F.substring(text, opened + 7, F.length(text))).alias("thinking"), trimmed(F.substring(text, F.lit(1), opened - 1)).alias("answer"))).otherwise(F.struct(F.lit(None).cast("string").alias("thinking"), text.alias("answer")))


def line_references(text: Column) -> Column:
    """Structs path, first, last of references like ``dir/file.ext:3-9``; last is first at least, numbers past 64 bits are null."""
    paths, first, last = (_all(text, LINE_REFERENCE, g) for g in (1, 2, 3))
    return F.transform(F.arrays_zip(paths.alias("a"), first.alias("b"), last.alias("c")), lambda z: F.struct(z["a"].alias("path"), z["b"].try_cast("long").alias("first"), F.greatest(z["b"].try_cast("long"), z["c"].try_cast("long")).alias("last")))


def strip_markers(text: Column) -> Column:
    """Notes unwrapped, probes and thinking gone, cut at an open ``<think>``, no chat tokens, trimmed."""
    out = F.regexp_replace(text, NOTE, "$2")
    out = F.regexp_replace(out, "<probe>(.*?)</probe>", "")
    out = F.regexp_replace(out, r"(?s)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"(?s)<think>.*", "")
    return trimmed(F.regexp_replace(out, r"<\|im_(?:start|end)\|>", ""))


def count_fake_recalls(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?s)\[recalled from [^\]]+\].*?\[end recall\]")).cast("long")


def strip_fake_recalls(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\[recalled from .*?\[end recall\]", "")


def truncate_at_chat(text: Column) -> Column:
    """Up to the first opening chat token, else the first closing one."""
    cut = F.when(F.contains(text, F.lit(IM_START)), F.substring_index(text, IM_START, 1)).when(F.contains(text, F.lit(IM_END)), F.substring_index(text, IM_END, 1))
    return F.coalesce(F.regexp_replace(cut, f"{SPACE}$", ""), text)


def detect_loop(text: Column) -> Column:
    """Why a text loops, the first reason that holds; null if none does.

    Chat tokens; one word over 70 % of 20 or more; fewer than a tenth of the trigrams of 30 or
    more words distinct; a line over 30 bytes three times among six or more.  Ties of the most
    frequent go to the smallest in order.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), trimmed), lambda x: F.octet_length(x) > 30)
    return bound(F.struct(words(text).alias("w"), lines.alias("l"), text.alias("t")), lambda s: _loop_reason(s["w"], s["l"], s["t"]))


def _loop_reason(w: Column, lines: Column, text: Column) -> Column:
    n = F.size(w)

    def longest(items: Column) -> Column:
        """The most frequent of a sorted array and how often it stands there, the first of several, in one pass."""
        none = F.lit(None).cast("string")
        begin = F.struct(none.alias("x"), F.lit(0).alias("n"), none.alias("best"), F.lit(0).alias("k"))

        def step(s: Column, x: Column) -> Column:
            n = F.when(s["x"] == x, s["n"] + 1).otherwise(1)
            return F.struct(x.alias("x"), n.alias("n"), F.when(n > s["k"], x).otherwise(s["best"]).alias("best"), F.greatest(n, s["k"]).alias("k"))

        return F.aggregate(items, begin, step)

    # a word over 70 % fills the middle of the sorted words
    ordered = F.array_sort(w)
    middle = item(ordered, (n / 2).cast("int") + 1)
    share = bound(middle, lambda m: F.floor((n - F.size(F.array_remove(w, m))) * 100 / n))
    trigrams = F.transform(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))
    distinct = F.size(F.array_distinct(trigrams))
    repeated = longest(F.array_sort(lines))
    return (
        F.when(F.contains(text, F.lit(IM_END)), F.lit(f"chat_template_token: {IM_END}"))
        .when(F.contains(text, F.lit(IM_START)), F.lit(f"chat_template_token: {IM_START}"))
        .when(n < 20, F.lit(None))
        .when(share > 70, F.concat(F.lit("word_dominance: '"), middle, F.lit("' at "), share.cast("string"), F.lit("% of "), n.cast("string"), F.lit(" tokens")))
        .when((n >= 30) & (distinct * 10 < n - 2), F.concat(F.lit("trigram_collapse: "), distinct.cast("string"), F.lit("/"), (n - 2).cast("string"), F.lit(" unique trigrams ("), F.floor(distinct * 100 / (n - 2)).cast("string"), F.lit("%)")))
        .when((F.size(lines) >= 6) & (F.size(F.array_distinct(lines)) <= F.size(lines) - 2), bound(repeated, lambda r: F.when(r["k"] >= 3, F.concat(F.lit("line_repetition: '"), F.substring(r["best"], 1, 60), F.lit("...' ×"), r["k"].cast("string"), F.lit(" (first at byte "), F.octet_length(F.split_part(text, r["best"], F.lit(1))).cast("string"), F.lit(")")))))
    )


def _walked_object(text: Column) -> Column:
    """By a walk over the characters: any depth."""
    start = F.instr(text, "{")
    chars = F.split(F.substring(text, start, F.length(text)), "")
    begin = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        open_ = s["end"] == 0
        plain = open_ & ~s["quoted"]
        depth = s["depth"] + F.when(plain & (c == "{"), 1).when(plain & (c == "}"), -1).otherwise(0)
        quoted = F.when(open_ & (c == '"') & ~s["escaped"], ~s["quoted"]).otherwise(s["quoted"])
        end = F.when(plain & (c == "}") & (depth == 0), s["at"] + 1).otherwise(s["end"])
        return F.struct(depth.alias("depth"), quoted.alias("quoted"), (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"), (s["at"] + 1).alias("at"), end.alias("end"))

    size = F.aggregate(chars, begin, step, lambda s: s["end"])
    return F.when((start > 0) & (size > 0), F.substring(text, start, size))


def _nested(depth: int) -> str:
    """A pattern of balanced braces down to a depth, strings and escapes minded."""
    inner = "" if depth == 0 else "|" + _nested(depth - 1)
    return r"\{(?:[^{}\"]++|\"(?:[^\"\\]|\\.)*+\"" + inner + r")*+\}"


def json_object(text: Column) -> Column:
    """The first balanced ``{...}``, strings and escapes minded; null if there is none.

    A pattern finds objects of up to six levels; only what it does not fit is walked.
    """
    found = F.regexp_extract(text, r"(?s)^[^{]*+(" + _nested(5) + ")", 1)
    return F.when(found != "", found).when(F.contains(text, F.lit("{")), _walked_object(text))


def stub_references(text: Column) -> Column:
    return _all(text, r'<file id="([^"]+)"', 1)


def path_references(text: Column) -> Column:
    """Structs mark, path of markdown links and ``@path`` mentions, in order."""
    pattern = r"\[[^\]]+\]\(([^)]+)\)|@([a-zA-Z0-9_./\-]+)"
    whole, a, b = (_all(text, pattern, g) for g in (0, 1, 2))
    return F.transform(F.arrays_zip(whole.alias("w"), a.alias("a"), b.alias("b")), lambda z: F.struct(z["w"].alias("mark"), F.when(z["a"] != "", z["a"]).otherwise(z["b"]).alias("path")))


def last_user_text(messages: Column) -> Column:
    """The last user turn's text of a JSON array of chat messages.

    Content is a string, or an array of blocks of which the text ones are joined by line ends.
    """
    parsed = F.from_json(messages, "array<struct<role:string,content:string>>")
    last = item(F.filter(parsed, lambda m: m["role"] == "user"), -1)["content"]
    parts = F.from_json(last, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    return F.when(F.startswith(last, F.lit("[")) & parts.isNotNull(), joined).otherwise(last)


def verdict_score(text: Column) -> Column:
    """A judge's score, 0 to 1: of the JSON from the first ``{`` to the last ``}``, else the number after ``score``."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    strict = F.get_json_object(body, "$.score").try_cast("double")
    loose = F.regexp_extract(text, r'"?score"?\s*[:=]\s*(-?[0-9]*\.?[0-9]+)', 1).try_cast("double")
    score = F.coalesce(strict, loose)
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
