"""Documents to stubs: outline, chunks, summaries, hashes."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Chunking
from ..functions.ranges import text_lines
from ..functions.text import SPACE, cheap_tokens, clipped, item
from ..functions.protocol import trimmed

#: Line starts that the naive outline keeps.  Fixed values.
OUTLINE_PREFIXES = (
    "pub fn ", "fn ", "pub struct ", "struct ", "pub enum ", "enum ", "pub trait ", "trait ", "impl ", "pub mod ", "mod ", "def ", "class ",
    "function ", "export function ", "export class ", "export interface ", "export type ",
)


def markdown_outline(text: Column) -> Column:
    """The first 20 headings' texts."""
    lines = F.filter(text_lines(text), lambda x: x.rlike(f"^({SPACE})?#"))
    return F.slice(F.filter(F.transform(lines, lambda x: trimmed(F.regexp_replace(x, "^#+", ""))), lambda x: x != ""), 1, 20)


def naive_outline(text: Column) -> Column:
    """The first 30 lines that begin like a definition."""
    starts = "^(" + "|".join(map(re.escape, OUTLINE_PREFIXES)).replace(r"\ ", " ") + ")"
    bare = F.transform(text_lines(text), lambda x: F.regexp_replace(x, f"^{SPACE}", ""))
    return F.slice(F.filter(bare, lambda x: x.rlike(starts)), 1, 30)


#: Definitions by language, for the outline without a parser (an approximation: no grammar is installed).
DEFINITIONS = {
    "rs": r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?:fn|struct|enum|trait|mod|impl|type|macro_rules!)\b[^{;]*",
    "js": r"(?:export\s+(?:default\s+)?)?(?:async\s+)?(?:function|class)\b[^{;]*|(?:export\s+)?const\s+\w+\s*=\s*(?:async\s*)?\([^)]*\)\s*=>",
    "ts": r"(?:export\s+(?:default\s+)?)?(?:async\s+|abstract\s+|declare\s+)*(?:function|class|interface|type|enum|namespace)\b[^{;=]*",
    "go": r"(?:func|type)\b[^{]*",
}
DEFINITIONS |= {"jsx": DEFINITIONS["js"], "tsx": DEFINITIONS["ts"]}
OUTLINE_ENTRIES = 60


def parsed_outline(content: str, ext: str) -> list[str] | None:
    """Signatures down to depth 1: of Python by its own parser, of others by patterns; None where neither fits."""
    if ext == "py":
        try:
            tree = ast.parse(content)
        except (SyntaxError, ValueError, RecursionError):
            return None
        found = []
        for node in tree.body:
            members = node.body if isinstance(node, ast.ClassDef) else []
            for node_ in (node, *members):
                if isinstance(node_, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    node_.body, node_.decorator_list = [ast.Pass()], []
                    head = ast.unparse(node_)
                    found.append(head.split("\n")[0].removesuffix(":").strip())
        return found[:OUTLINE_ENTRIES]
    if ext in DEFINITIONS:
        pattern = re.compile(r"^[ \t]{0,4}(" + DEFINITIONS[ext] + ")", re.MULTILINE)
        return [" ".join(m[1].split()) for m in pattern.finditer(content)][:OUTLINE_ENTRIES]
    return None


def doc_comment(lines: list[str]) -> str:
    """Comment lines without their marks, joined by spaces, 240 bytes at most."""
    out = " ".join(re.sub(r"^\s*//[/!]?\s?", "", x).strip() for x in lines).strip()
    return out.encode()[:240].decode(errors="ignore")


def item_spans(content: str) -> list[dict]:
    """Top-level Rust items: start, end (bytes), signature, doc; comments and attributes before one belong to it."""
    spans, at, lead, comments = [], 0, None, []
    head = re.compile(r"^(?:" + DEFINITIONS["rs"] + ")")
    offsets, position = [], 0
    for line in content.splitlines(keepends=True):
        offsets.append((position, line))
        position += len(line.encode())
    for start, line in offsets:
        if re.match(r"^(///|//!|//|#\[)", line):
            lead = start if lead is None else lead
            if line.startswith("//"):
                comments.append(line)
        elif m := head.match(line):
            spans.append({"start": start if lead is None else lead, "end": position, "signature": " ".join(m[0].split()), "doc": doc_comment(comments)})
            lead, comments = None, []
        elif line.strip():
            lead, comments = None, []
    for a, b in zip(spans, spans[1:]):
        a["end"] = b["start"]
    return spans


# ---- chunks ---------------------------------------------------------------------------------


def whitespace_tokens(text: str) -> int:
    return max(1, len(text.split()))


def _floor(data: bytes, at: int) -> int:
    """The largest character boundary not past ``at``."""
    at = min(at, len(data))
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _overlap(data: bytes, start: int, size: int) -> bytes:
    """The last ``size`` bytes before ``start``, taken back to a line's beginning but by no more than ``size``."""
    if not start or not size:
        return b""
    at = _floor(data[:start], start - size) if start > size else 0
    line = data.rfind(b"\n", 0, at) + 1
    bound = _floor(data, at - size) if at > size else 0
    lead = data[max(line, bound) : start]
    return lead if lead.endswith(b"\n") else lead + b"\n"


def line_chunks(data: bytes, c: Chunking) -> list[tuple[int, int, bytes]]:
    """(start, end, text with overlap): cuts at the first line end past the target and within the cap,
    else at the last one before the cap, else at the cap's character boundary."""
    target, cap = max(1, c.target), max(1, c.target, c.cap)
    out, start = [], 0
    while start < len(data):
        if len(data) - start <= cap:
            end = len(data)
        else:
            ideal, hard = _floor(data, start + target), _floor(data, start + cap)
            end = data.find(b"\n", ideal, hard) + 1 or data.rfind(b"\n", start, hard) + 1 or max(hard, start + 1)
        out.append((start, end, (_overlap(data, start, min(c.overlap, cap - 1)) if out else b"") + data[start:end]))
        start = end
    return out


def _fitting(data: bytes, start: int, end: int, c: Chunking, count: Callable[[str], int], depth: int) -> Iterator[tuple[int, int, bytes, int]]:
    """Chunks of a range whose tokens fit, by halving the sizes, at most ``max_depth`` times."""
    piece = data[start:end]
    if depth >= c.max_depth or not piece:
        yield start, end, piece, count(piece.decode())
        return
    small = c.tightened()
    for a, b, text in line_chunks(piece, small):
        n = count(text.decode())
        if n <= c.max_body_tokens:
            yield start + a, start + b, text, n
        else:
            yield from _fitting(data, start + a, start + b, small, count, depth + 1)


def _header(spans: list[dict], a: int, b: int, most: int = 400) -> bytes:
    out = ""
    for s in spans:
        if a <= s["start"] < b:
            line = f"{s['signature']} — {s['doc']}" if s["doc"] else s["signature"]
            if out and len((out + line).encode()) > most:
                break
            out += ("\n" if out else "") + line
    return out.encode()


def chunks(content: str, c: Chunking = Chunking(), count: Callable[[str], int] = whitespace_tokens, spans: list[dict] | None = None) -> list[dict]:
    """Chunks that tile the content: idx, total, start, end (bytes), text, tokens."""
    data = content.encode()
    found: list[tuple[int, int, bytes, int]] = []
    if len(data) // 3 <= c.token_threshold:
        found = [(0, len(data), data, len(data) // 3)]
    elif spans:
        cuts = [0]
        for s in spans:
            if min(s["end"], len(data)) - cuts[-1] > c.target and s["start"] > cuts[-1]:
                cuts.append(s["start"])
        for a, b in zip(cuts, [*cuts[1:], len(data)]):
            head = _header(spans, a, b)
            lead = head + b"\n\n" if head else b""
            whole = lead + data[a:b]
            if b - a <= max(c.cap, c.target) and (n := count(whole.decode())) <= c.max_body_tokens:
                found.append((a, b, whole, n))
                continue
            for i, (x, y, text) in enumerate(line_chunks(data[a:b], c)):
                text = text if i else lead + text
                if (n := count(text.decode())) <= c.max_body_tokens:
                    found.append((a + x, a + y, text, n))
                else:
                    found += _fitting(data, a + x, a + y, c, count, 0)
    else:
        for a, b, text in line_chunks(data, c):
            if (n := count(text.decode())) <= c.max_body_tokens:
                found.append((a, b, text, n))
            else:
                found += _fitting(data, a, b, c, count, 0)
    return [{"idx": i, "total": len(found), "start": a, "end": b, "text": t.decode(), "tokens": n} for i, (a, b, t, n) in enumerate(found)]


CHUNK = "array<struct<idx:bigint,total:bigint,start:bigint,end:bigint,text:string,tokens:bigint>>"


def with_chunks(docs: DataFrame, content: str = "content", path: str | None = "path", config: Chunking = Chunking(), structured: bool = True) -> DataFrame:
    """``docs`` with ``chunk``, a row a chunk.

    Small documents are one chunk by a built-in expression; only those past the threshold go to
    Python, in a branch of their own, so that the planner cannot move the call above the test.
    """
    small = cheap_tokens(F.col(content)) <= config.token_threshold
    text = F.coalesce(F.col(content), F.lit(""))
    one = F.struct(F.lit(0).cast("long").alias("idx"), F.lit(1).cast("long").alias("total"), F.lit(0).cast("long").alias("start"), F.octet_length(text).cast("long").alias("end"), text.alias("text"), cheap_tokens(text).alias("tokens"))
    few = docs.where(F.coalesce(small, F.lit(True))).withColumn("chunk", one)
    kind = pa.struct([("idx", pa.int64()), ("total", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("tokens", pa.int64())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(path).to_pylist() if path else [None] * batch.num_rows
            for i, (value, at) in enumerate(zip(batch.column(content), paths)):
                value = value.as_py()
                made = chunks(value, config, spans=item_spans(value) if structured and at and at.endswith(".rs") else None)
                rows = batch.take(pa.array([i] * len(made)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(made, kind)], names=[*batch.schema.names, "chunk"])

    many = docs.where(~small).mapInArrow(split, few.schema)
    return few.unionByName(many)


# ---- summaries and stubs --------------------------------------------------------------------


def attributed(outline: Column, text: Column) -> Column:
    """Entries whose first line the text holds."""
    return F.filter(outline, lambda e: F.contains(text, item(F.split(e, "\n"), 1)))


def plain_summary(text: Column) -> Column:
    first = item(F.filter(text_lines(text), lambda x: trimmed(x) != ""), 1)
    return clipped(F.coalesce(first, F.lit("(empty)")), 200)


def markdown_summary(text: Column, outline: Column) -> Column:
    """``title: first line of text after it``; the title and its sections without one; else the first line."""
    lines = F.filter(F.transform(text_lines(text), trimmed), lambda x: x != "")
    title_at = F.coalesce(F.array_position(F.transform(lines, lambda x: F.startswith(x, F.lit("#")) & (trimmed(F.regexp_replace(x, "^#+", "")) != "")), True), F.lit(0))
    title = trimmed(F.regexp_replace(item(lines, F.greatest(title_at, F.lit(1)).cast("int")), "^#+", ""))
    after = F.filter(F.slice(lines, (title_at + 1).cast("int"), F.size(lines)), lambda x: ~F.startswith(x, F.lit("#")))
    joined = F.when(F.size(after) > 0, clipped(F.concat(title, F.lit(": "), item(after, 1)), 200)).when(F.size(outline) > 0, F.concat(title, F.lit("; sections: "), F.array_join(outline, ", "))).otherwise(title)
    return F.when(title_at > 0, joined).otherwise(plain_summary(text))


def code_summary(text: Column, outline: Column) -> Column:
    more = F.when(F.size(outline) > 5, F.concat(F.lit(" (+"), (F.size(outline) - 5).cast("string"), F.lit(" more)"))).otherwise("")
    return F.when(F.size(outline) > 0, F.concat(F.lit("Defines: "), F.array_join(F.slice(outline, 1, 5), ", "), more)).otherwise(plain_summary(text))


def summary(kind: Column, text: Column, outline: Column) -> Column:
    return F.when(kind == "Markdown", markdown_summary(text, outline)).when(kind == "Code", code_summary(text, outline)).otherwise(plain_summary(text))


def position_summary(path: Column, idx: Column, total: Column, entries: Column) -> Column:
    """``Chunk i/n of path: contains a, b``; empty for the only chunk."""
    what = F.when(F.size(entries) > 0, F.concat(F.lit(": contains "), F.array_join(F.slice(entries, 1, 4), ", "))).otherwise("")
    return F.when(total == 1, "").otherwise(F.concat(F.lit("Chunk "), (idx + 1).cast("string"), F.lit("/"), total.cast("string"), F.lit(" of "), path, what))


def merged_summary(base: Column, position: Column, entries: Column, path: Column) -> Column:
    """The position alone if it says more than the base, both otherwise; ``[name] `` first for paths under ``crates/``."""
    both = F.when(position == "", base).when((F.size(entries) > 0) | (base == ""), position).otherwise(F.concat(position, F.lit(" — "), base))
    crate = F.regexp_extract(path, r"(?:^|/)crates/([^/]+)", 1)
    return F.when(crate != "", F.concat(F.lit("["), crate, F.lit("] "), both)).otherwise(both)


def stubs(docs: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """The ingest pipeline: id, path, kind, summary, outline, byte range, tokens, hash, mtime, embed_text of every chunk.

    ``docs``: path, content, kind, mtime.  Chunk bodies tile their file without gaps.
    """
    outline = F.when(F.col("kind") == "Markdown", markdown_outline(F.col("content"))).when(F.col("kind") == "Code", naive_outline(F.col("content"))).otherwise(F.array().cast("array<string>"))
    told = docs.withColumn("outline", outline).withColumn("base", summary(F.col("kind"), F.col("content"), F.col("outline")))
    cut = with_chunks(told, config=config)
    entries = F.when(F.col("chunk.total") == 1, F.col("outline")).otherwise(attributed(F.col("outline"), F.col("chunk.text")))
    out = cut.withColumn("entries", entries)
    text = F.col("chunk.text")
    made = merged_summary(F.col("base"), position_summary(F.col("path"), F.col("chunk.idx"), F.col("chunk.total"), F.col("entries")), F.col("entries"), F.col("path"))
    ident = F.when(F.col("chunk.total") == 1, F.col("path")).otherwise(F.concat(F.col("path"), F.lit("#chunk"), F.col("chunk.idx").cast("string")))
    out = out.select(
        ident.alias("id"), "path", "kind", made.alias("summary"), F.col("entries").alias("outline"), F.col("chunk.start").alias("byte_offset"), (F.col("chunk.end") - F.col("chunk.start")).alias("byte_length"),
        F.col("chunk.idx").alias("chunk_index"), F.col("chunk.total").alias("chunk_total"), F.col("chunk.tokens").alias("token_estimate"), F.sha2(text, 256).alias("content_hash"), "mtime", text.alias("body"),
    )
    return out.withColumn("embed_text", F.concat("path", F.lit("\n"), "summary", F.lit("\n\n"), "body")).withColumn("stale", F.lit(False)).withColumn("ignored", F.lit(False))


def first_by_hash(stubs_: DataFrame) -> DataFrame:
    """content_hash, keep_id, n: the smallest id of each content, so nothing is embedded twice."""
    return stubs_.groupBy("content_hash").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))


def length_histogram(lengths: DataFrame, column: str, edges: list[int]) -> DataFrame:
    """bucket (upper edge, null past the last), n."""
    bucket = F.lit(None).cast("long")
    for e in reversed(edges):
        bucket = F.when(F.col(column) <= e, F.lit(e).cast("long")).otherwise(bucket)
    return lengths.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
