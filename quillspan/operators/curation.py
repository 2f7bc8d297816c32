"""Conversation curation: history, tool output, prompt budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import History
from ..functions.ranges import text_lines
from ..functions.text import item, token_count
from ..functions.protocol import trimmed

#: Words that make a sentence worth keeping.  Fixed values.
SIGNALS = ("decided", "conclusion", "result", "therefore", "established", "confirmed", "found", "error", "fixed", "changed", "updated", "created", "deleted", "moved", "renamed")


def partition_turns(turns: DataFrame, budget: int, history: History = History(), conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``turns`` with summarize: all but the last few of a conversation whose tokens pass the trigger.

    Sums and counts come from one aggregation; only the order of turns needs a window.
    """
    all_of = Window.partitionBy(conv)
    back = F.row_number().over(all_of.orderBy(F.desc(turn)))
    total, n = F.sum("tokens").over(all_of), F.count("*").over(all_of)
    limit = int(budget * history.trigger_share)
    return turns.withColumn("summarize", (total > limit) & (n > history.retain_recent) & (back > history.retain_recent))


def extract_lines(role: Column, content: Column, tool: Column | None = None) -> Column:
    """A turn's first sentence under its role, later ones with a signal word, and its last."""
    sentences = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), r"[.!?]"), trimmed), lambda s: s != "")
    name = F.coalesce(tool, F.lit("unknown")) if tool is not None else F.lit("unknown")
    who = F.when(role == "user", "[User]").when(role == "assistant", "[Assistant]").when(role == "system", "[System]").otherwise(F.concat(F.lit("[Tool: "), name, F.lit("]")))
    signal = "(" + "|".join(SIGNALS) + ")"
    first = F.array(F.concat(who, F.lit(" "), item(sentences, 1)))
    middle = F.transform(F.filter(F.slice(sentences, F.lit(2), F.size(sentences)), lambda s: F.lower(s).rlike(signal)), lambda s: F.concat(F.lit("  - "), s))
    last = F.when(F.size(sentences) > 1, F.array(F.concat(F.lit("  ... "), item(sentences, -1)))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(sentences) > 0, F.concat(first, middle, last)).otherwise(F.array().cast("array<string>"))


def extractive_summary(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv, summary of the turns given."""
    lines = turns.select(conv, turn, extract_lines(F.col("role"), F.col("content"), F.col("tool_name") if "tool_name" in turns.columns else None).alias("lines"))
    ordered = lines.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(turn, "lines"))).alias("l"))
    return ordered.select(conv, F.array_join(F.flatten(F.col("l.lines")), "\n").alias("summary"))


def compress_tool_output(name: Column, output: Column, tokens: Column, threshold: int = 500) -> Column:
    """Struct summary, summary_tokens; null at or below the threshold."""
    lines = text_lines(output)
    n = F.size(lines)
    # the preview's wording is fixed text
    lead = F.concat(F.lit("[tool: "), name, F.lit("] "), n.cast("string"), F.lit(" lines of output. Preview:\n"), F.array_join(F.slice(lines, 1, 3), "\n"))
    tail = F.concat(F.lit("\n  ... ("), (n - 5).cast("string"), F.lit(" lines omitted) ...\n"), F.array_join(F.slice(lines, F.greatest(n - 1, F.lit(1)), 2), "\n"), F.lit("\nFull results available via recall."))
    text = F.when(n > 5, F.concat(lead, tail)).otherwise(lead)
    return F.when(tokens > threshold, F.struct(text.alias("summary"), token_count(text).alias("summary_tokens")))


def check_budget(used: Column, most: int, warn: float = 0.8) -> Column:
    """Struct status, used, max, message."""
    over = F.format_string("System prompt uses %d tokens, exceeding budget of %d by %d", used, F.lit(most), used - most)
    near = F.format_string("System prompt uses %d tokens (%.0f%% of %d budget)", used, F.bround(used * 100.0 / most, 0), F.lit(most))
    status = F.when(used > most, "Exceeded").when(used > int(most * warn), "Warning").otherwise("Ok")
    return F.struct(status.alias("status"), used.alias("used"), F.lit(most).cast("long").alias("max"), F.when(used > most, over).when(used > int(most * warn), near).alias("message"))


def truncate_to_budget(text: Column, most: int) -> Column:
    """Struct kept, dropped: the sentences from the start (ends in ``.`` or a line end) whose tokens fit."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)[^.\n]*[.\n]|[^.\n]+$"), F.lit(0))
    begin = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("full"))

    def step(s: Column, piece: Column) -> Column:
        n = token_count(piece)
        fits = ~s["full"] & (s["used"] + n <= most)
        return F.struct(F.when(fits, F.concat(s["kept"], piece)).otherwise(s["kept"]).alias("kept"), F.when(fits, s["used"] + n).otherwise(s["used"]).alias("used"), (~fits).alias("full"))

    now = token_count(text)
    cut = F.aggregate(pieces, begin, step)
    return F.when(now <= most, F.struct(text.alias("kept"), F.lit(0).cast("long").alias("dropped"))).otherwise(F.struct(cut["kept"].alias("kept"), F.greatest(now - cut["used"], F.lit(0).cast("long")).alias("dropped")))


def curate(turns: DataFrame, budget: int, history: History = History()) -> DataFrame:
    """conv_id, summary, retained, compressed, tokens_before, tokens_after, tokens_saved.

    ``turns``: conv_id, turn, role, content, tool_name, inline_required.  Old turns become one
    summary; retained tool output over the threshold is compressed unless it is required inline.
    """
    told = partition_turns(turns.withColumn("tokens", token_count(F.col("content"))), budget, history)
    short = compress_tool_output(F.coalesce("tool_name", F.lit("unknown")), F.col("content"), F.col("tokens"), history.tool_tokens)
    kept = told.where("NOT summarize").withColumn("short", F.when((F.col("role") == "tool") & ~F.coalesce("inline_required", F.lit(False)), short))
    after = F.coalesce(F.col("short.summary_tokens"), F.col("tokens"))
    sums = kept.groupBy("conv_id").agg(F.count("*").alias("retained"), F.count("short").alias("compressed"), F.sum("tokens").alias("a"), F.sum(after).alias("b"))
    old = extractive_summary(told.where("summarize")).withColumn("c", token_count(F.col("summary")))
    gone = told.where("summarize").groupBy("conv_id").agg(F.sum("tokens").alias("d"))
    out = sums.join(old, "conv_id", "left").join(gone, "conv_id", "left")
    before, now = F.col("a") + F.coalesce("d", F.lit(0)), F.col("b") + F.coalesce("c", F.lit(0))
    return out.select("conv_id", "summary", "retained", "compressed", before.alias("tokens_before"), now.alias("tokens_after"), F.greatest(before - now, F.lit(0)).alias("tokens_saved"))
