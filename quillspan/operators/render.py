"""The workspace as text for a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a prompt.  Fixed texts.
LEAD = "\n\nRecalled workspace context (each block is verbatim from the cited source — treat as quoted material, not your own knowledge):\n"
BASELINE = "- Prefer the recalled context when it bears on the question, and cite the source file. If the context does not cover the question, say so plainly rather than inventing specifics."
CANDIDATES = "- Blocks from `search-candidates:file-list` are candidate metadata only. Use them to decide what to load, not as evidence for factual claims."


def fragment_block(source: Column, locator: Column, content: Column, xml: bool) -> Column:
    ref = F.when(locator == "full", source).otherwise(F.concat(source, F.lit(":"), locator))
    if xml:
        return F.concat(F.lit('<recalled from="'), ref, F.lit('">\n'), content, F.lit("\n</recalled>"))
    return F.concat(F.lit("[recalled from "), ref, F.lit("]\n"), content, F.lit("\n[end recall]"))


def workspace_text(fragments: DataFrame, guidance: Column | None = None, xml: bool = True) -> DataFrame:
    """session, text of fragments (session, pos, stub_id, source, locator, content); guidance is an array per row of the session.

    Every fragment is rendered; hints that repeat come once.
    """
    extra = guidance if guidance is not None else F.array().cast("array<string>")
    block = fragment_block(F.col("source"), F.col("locator"), F.col("content"), xml)
    listed = (F.col("source") == "search-candidates") | (F.col("stub_id") == "__candidates__")
    out = fragments.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("pos", block.alias("b")))).alias("l"), F.max(listed).alias("listed"), F.first(extra).alias("extra"))
    more = F.filter(F.transform("extra", lambda g: F.concat(F.lit("- "), F.trim(g))), lambda g: g != "- ")
    hints = F.array_distinct(F.concat(F.array(F.lit(BASELINE)), F.when(F.col("listed"), F.array(F.lit(CANDIDATES))).otherwise(F.array().cast("array<string>")), more))
    return out.select("session", F.concat(F.lit(LEAD), F.lit("\nAnswering hints:\n"), F.array_join(hints, "\n"), F.lit("\n\n"), F.array_join(F.col("l.b"), "\n\n")).alias("text"))


def transformed_prompts(prompts: DataFrame, stubs: DataFrame) -> DataFrame:
    """``prompts`` (query_id, text) with links and mentions of registered paths replaced by stub tags (stubs: path, id, summary)."""
    from ..functions.protocol import path_references

    refs = prompts.select("query_id", F.posexplode(path_references(F.col("text"))).alias("n", "r")).select("query_id", "n", "r.mark", "r.path")
    tag = F.concat(F.lit('<file id="'), F.col("id"), F.lit('" path="'), F.col("path"), F.lit('">'), F.col("summary"), F.lit("</file>"))
    known = refs.join(stubs.select("path", "id", "summary"), "path").select("query_id", "n", "mark", tag.alias("tag"))
    swaps = known.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "mark", "tag"))).alias("swaps"))
    new = F.aggregate(F.coalesce("swaps", F.array().cast("array<struct<n:int,mark:string,tag:string>>")), F.col("text"), lambda t, s: F.replace(t, s["mark"], s["tag"]))
    return prompts.join(swaps, "query_id", "left").withColumn("text", new).drop("swaps")


def spliced(messages: Column, workspace: Column, user: Column) -> Column:
    """The last user turn's text with the workspace after it."""
    return F.concat(user, workspace)
