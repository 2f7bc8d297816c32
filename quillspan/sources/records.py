"""Traces, sessions, question sets, code graphs and reports as DataFrames and back."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.protocol import trimmed

DEGENERATE = "[DEGENERATE] "


def write_trace(events: DataFrame, path: str, *, session: str = "session", order: str = "at_ms") -> None:
    """Events as JSON lines, each with t_ms since its session began and its number there; appended."""
    w = Window.partitionBy(session)
    numbered = events.withColumn("t_ms", F.col(order) - F.min(order).over(w)).withColumn("seq", F.row_number().over(w.orderBy(order)) - 1)
    numbered.write.mode("append").json(path)


def read_trace(spark: SparkSession, path: str, schema: str = "system_prompt string, result string") -> tuple[DataFrame, DataFrame]:
    """Usable lines, and one row: usable, bad.  Bad lines are counted, not fatal.

    Callers that need at least one usable line check the count.
    """
    fields = T._parse_datatype_string(schema)
    raw = spark.read.text(path).select("value", F.from_json("value", fields).alias("x"))
    good = F.col("x").isNotNull()
    for f in fields.fieldNames():
        good = good & F.col(f"x.{f}").isNotNull()
    lines = raw.where(F.trim("value") != "").withColumn("good", good)
    return lines.where("good").select("x.*"), lines.agg(F.count(F.when(F.col("good"), 1)).alias("usable"), F.count(F.when(~F.col("good"), 1)).alias("bad"))


QUESTION = "id string, type string, question string, reference_answer string, needle string, expected_paths array<string>, expected array<struct<path:string,line:bigint>>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question sets: a JSON array, or an object whose ``questions`` is one; gold as path and line.

    A question has a needle or a reference answer, not both and not neither; others come with valid false.
    """
    whole = spark.read.option("multiLine", True).schema(f"{QUESTION}, questions array<struct<{QUESTION.replace(' ', ':').replace(',:', ',')}>>").json(path)
    nested = whole.where("questions IS NOT NULL").select(F.explode("questions").alias("q")).select("q.*")
    flat = whole.where("questions IS NULL").drop("questions").unionByName(nested)
    gold = F.coalesce("expected", F.transform("expected_paths", lambda p: F.struct(p.alias("path"), F.lit(None).cast("long").alias("line"))))
    one = F.coalesce("needle", F.lit("")) != ""
    other = F.coalesce("reference_answer", F.lit("")) != ""
    return flat.select("id", "type", "question", "needle", "reference_answer", gold.alias("gold"), (one != other).alias("valid"))


GRAPH = "nodes array<struct<id:string,source_file:string,source_location:string>>, edges array<struct<source:string,target:string,relation:string,confidence:string,weight:double>>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, path, line; line 0 where unknown) and edges (source, target, relation, confidence, weight)."""
    raw = spark.read.option("multiLine", True).schema(GRAPH).json(path)
    nodes = raw.select(F.explode("nodes").alias("n")).select(F.col("n.id").alias("node"), F.col("n.source_file").alias("path"), F.coalesce(F.regexp_extract("n.source_location", r"L?(\d+)", 1).try_cast("long"), F.lit(0).cast("long")).alias("line"))
    return nodes, raw.select(F.explode("edges").alias("e")).select("e.*")


def session_text(turn: Column, user: Column, answer: Column, degenerate: Column) -> Column:
    """A turn as it stands in a session file."""
    return F.concat(F.lit("## Turn "), turn.cast("string"), F.lit("\n\n[User]: "), user, F.lit("\n\n[Assistant]: "), F.when(degenerate, F.lit(DEGENERATE)).otherwise(""), answer, F.lit("\n\n---\n\n"))


def session_files(turns: DataFrame) -> DataFrame:
    """session, content of turns (session, turn, user, answer, degenerate)."""
    text = session_text(F.col("turn"), F.col("user"), F.col("answer"), F.coalesce("degenerate", F.lit(False)))
    return turns.groupBy("session").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", text.alias("t")))), lambda x: x["t"]), "").alias("content"))


def _field(section: Column, marker: str) -> Column:
    rest = F.regexp_extract(section, r"(?s)\Q" + marker + r"\E(.*)", 1)
    return trimmed(F.regexp_replace(rest, r"(?s)\n\n(---|\[).*", ""))


def parse_sessions(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with turn, user, assistant (null for degenerate or empty ones), a row a turn that has a user text."""
    sections = F.split(F.concat(F.lit("\n"), F.col(content)), r"\n## Turn ")
    rows = files.select("*", F.explode(F.filter(sections, lambda s: s.rlike(r"^\d"))).alias("section"))
    said = _field(F.col("section"), "[Assistant]: ")
    rows = rows.withColumn("turn", F.regexp_extract("section", r"^(\d+)", 1).try_cast("long")).withColumn("user", _field(F.col("section"), "[User]: "))
    rows = rows.withColumn("assistant", F.when((said != "") & ~F.startswith(said, F.lit(DEGENERATE.strip())), said))
    return rows.where("user != ''").drop("section")


#: What fragments of earlier sessions name as their source.  Fixed text.
HISTORY = "session history"


def session_stubs(files: DataFrame, session: str = "session") -> DataFrame:
    """Turns of earlier sessions as what a turn may recall: id, source, tokens, content, session, turn.

    ``files``: session, content.  Turns whose answer was degenerate or empty are left out.
    """
    from ..functions.text import token_count

    turns = parse_sessions(files).where("assistant IS NOT NULL")
    said = F.concat(F.lit("User: "), "user", F.lit("\nAssistant: "), "assistant")
    return turns.select(F.concat(F.col(session).cast("string"), F.lit("#turn"), F.col("turn").cast("string")).alias("id"), F.lit(HISTORY).alias("source"), token_count(said).alias("tokens"), said.alias("content"), session, "turn")


def transcript_documents(lines: DataFrame, *, session: str = "session", mtime: str = "mtime") -> DataFrame:
    """Coding sessions (session, n, line: JSON, mtime) as documents: text and thinking blocks of user and assistant.

    path, content, kind, mtime; a document a session, stamped with its source's time.
    """
    kind = "type string, message struct<role:string,content:string>"
    told = lines.withColumn("x", F.from_json("line", kind)).withColumn("role", F.coalesce("x.message.role", "x.type"))
    body = F.col("x.message.content")
    blocks = F.from_json(body, "array<struct<type:string,text:string,thinking:string>>")
    parts = F.filter(F.transform(blocks, lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "thinking", b["thinking"])), lambda t: F.coalesce(F.trim(t), F.lit("")) != "")
    text = F.when(F.startswith(body, F.lit("[")), F.array_join(parts, "\n\n")).otherwise(body)
    told = told.withColumn("text", trimmed(text)).where(F.col("role").isin("user", "assistant") & (F.col("text") != ""))
    entry = F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), F.col("text"))
    out = told.groupBy(session).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", entry.alias("e")))), lambda x: x["e"]), "\n\n").alias("content"), F.max(mtime).alias("mtime"))
    return out.select(F.concat(F.lit("sessions/"), F.col(session).cast("string"), F.lit(".md")).alias("path"), "content", F.lit("Markdown").alias("kind"), "mtime")


def write_report(summary: DataFrame, path: str) -> str:
    """The rows of a small aggregate as indented JSON in one file; gives the text."""
    rows = [json.loads(x) for x in summary.toJSON().collect()]
    text = json.dumps(rows, indent=2, ensure_ascii=False)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return text


def write_stubs(stubs: DataFrame, path: str) -> None:
    """The stub table, its files sorted by path so that scans of one path skip the others'."""
    stubs.repartitionByRange("path").sortWithinPartitions("path", "byte_offset").write.mode("overwrite").parquet(path)
