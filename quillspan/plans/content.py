"""Queries of what texts hold: outlines, summaries, sections, thinking, verdicts, references, and the stubs made of them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..config import Chunking
from ..functions import protocol, ranges, text as tx
from ..operators import evaluation, fusion, graph, ingest, intent, provenance, stubs, workspace
from ..registry import query, table, texts
from ..storage import new_path
from .documents import FIRST_LINE, STUBS, TERMS, WS, _stubs
from .evaluation import _votes
from .retrieval import NORMAL, _edges, _normal
from .sql import EDGES

LINES = "regexp_split_to_array(regexp_replace(content, '\\r?\\n$', ''), '\\r?\\n')"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


UNMARKED = trim("regexp_replace(x, '^#+', '')")

#: Documents as Markdown: every second sentence is a heading, by turns of the first and second level.
MARKDOWN = "WITH m AS (SELECT doc_id, source || '/' || doc_id || '.md' AS path, regexp_replace(replace(coalesce(text, ''), '. ', chr(10) || '# '), '# ([^#]*)# ', '## \\1# ', 'g') AS content FROM documents)"
OUTLINE = f"list_filter(list_transform(list_filter({LINES}, lambda x: regexp_matches(x, '^({WS})?#')), lambda x: {UNMARKED}), lambda x: x <> '')[1:20]"


def _markdown(spark, d):
    content = F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit("\n# ")), "# ([^#]*)# ", "## $1# ")
    return texts(spark, d).select("doc_id", F.concat_ws("", "source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), content.alias("content"))


@query("markdown_outline", MARKDOWN + f" SELECT doc_id, array_to_string({OUTLINE}, '|') AS outline FROM m")
def markdown_outline(spark, d):
    return _markdown(spark, d).select("doc_id", F.array_join(ingest.markdown_outline(F.col("content")), "|").alias("outline"))


TITLE = "CASE WHEN strlen(title || ': ' || after[1]) <= 200 THEN title || ': ' || after[1] ELSE left(title || ': ' || after[1], 197) || '...' END"


@query("markdown_summary", MARKDOWN + f""", t AS (SELECT *, list_filter(list_transform({LINES}, lambda x: {trim('x')}), lambda x: x <> '') AS l, {OUTLINE} AS outline FROM m),
p AS (SELECT *, coalesce(list_position(list_transform(l, lambda x: starts_with(x, '#') AND {UNMARKED} <> ''), TRUE), 0) AS place FROM t),
s AS (SELECT *, {trim("regexp_replace(l[place], '^#+', '')")} AS title, list_filter(l[place + 1:], lambda x: NOT starts_with(x, '#')) AS after FROM p)
SELECT doc_id, CASE WHEN place > 0 THEN CASE WHEN len(after) > 0 THEN {TITLE} WHEN len(outline) > 0 THEN title || '; sections: ' || array_to_string(outline, ', ') ELSE title END
  ELSE CASE WHEN strlen(coalesce({FIRST_LINE}, '(empty)')) <= 200 THEN coalesce({FIRST_LINE}, '(empty)') ELSE left({FIRST_LINE}, 197) || '...' END END AS summary FROM s""")  # fmt: skip
def markdown_summary(spark, d):
    outlined = _markdown(spark, d).withColumn("outline", ingest.markdown_outline(F.col("content")))
    return outlined.select("doc_id", ingest.summary(F.lit("Markdown"), F.col("content"), F.col("outline")).alias("summary"))


#: Documents as code: every sentence begins a definition, by turns indented, public or plain.
CODE = "WITH m AS (SELECT doc_id, replace(replace(coalesce(text, ''), '. ', chr(10) || '  pub fn '), ', ', chr(10) || 'class ') AS content FROM documents)"
STARTS = "|".join(re.escape(p).replace("\\ ", " ") for p in ingest.OUTLINE_PREFIXES)
DEFINED = f"list_filter(list_transform({LINES}, lambda x: regexp_replace(x, '^{WS}', '')), lambda x: regexp_matches(x, '^({STARTS})'))[1:30]"


def _code(spark, d):
    content = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit("\n  pub fn ")), F.lit(", "), F.lit("\nclass "))
    outlined = texts(spark, d).select("doc_id", content.alias("content"))
    return outlined.withColumn("outline", ingest.naive_outline(F.col("content")))


@query("code_outline", CODE + f" SELECT doc_id, array_to_string({DEFINED}, '|') AS outline FROM m")
def code_outline(spark, d):
    return _code(spark, d).select("doc_id", F.array_join("outline", "|").alias("outline"))


@query("code_summary", CODE + f", o AS (SELECT *, {DEFINED} AS o FROM m) SELECT doc_id, CASE WHEN len(o) > 0 THEN 'Defines: ' || array_to_string(o[1:5], ', ') || CASE WHEN len(o) > 5 THEN ' (+' || len(o) - 5 || ' more)' ELSE '' END ELSE CASE WHEN strlen(coalesce({FIRST_LINE}, '(empty)')) <= 200 THEN coalesce({FIRST_LINE}, '(empty)') ELSE left({FIRST_LINE}, 197) || '...' END END AS summary FROM o")
def code_summary(spark, d):
    return _code(spark, d).select("doc_id", ingest.summary(F.lit("Code"), F.col("content"), F.col("outline")).alias("summary"))


POSITION = "CASE WHEN total = 1 THEN '' ELSE 'Chunk ' || idx + 1 || '/' || total || ' of ' || path || CASE WHEN len(e) > 0 THEN ': contains ' || array_to_string(e[1:4], ', ') ELSE '' END END"


@query("position_summary", f"WITH c AS (SELECT l_orderkey, l_linenumber, (l_linenumber - 1)::BIGINT AS idx, (l_orderkey % 4 + 1)::BIGINT AS total, CASE WHEN l_partkey % 2 = 0 THEN 'crates/' ELSE 'src/' END || l_returnflag || '/f.rs' AS path, CASE WHEN l_partkey % 3 = 0 THEN [l_shipmode, l_linestatus] ELSE []::VARCHAR[] END AS e, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE 'base ' || l_suppkey END AS base FROM (SELECT *, l_linestatus || 'x' AS l_shipmode FROM lineitem)), p AS (SELECT *, {POSITION} AS pos FROM c), m AS (SELECT *, CASE WHEN pos = '' THEN base WHEN len(e) > 0 OR base = '' THEN pos ELSE pos || ' — ' || base END AS both_ FROM p) SELECT l_orderkey, l_linenumber, CASE WHEN starts_with(path, 'crates/') THEN '[' || split_part(path, '/', 2) || '] ' || both_ ELSE both_ END AS summary FROM m")
def position_summary(spark, d):
    """Line items as chunks, with and without entries, names and summaries of their own."""
    c = F.col
    e = F.when(c("l_partkey") % 3 == 0, F.array(F.concat("l_linestatus", F.lit("x")), c("l_linestatus"))).otherwise(F.array().cast("array<string>"))
    path = F.concat(F.when(c("l_partkey") % 2 == 0, "crates/").otherwise("src/"), "l_returnflag", F.lit("/f.rs"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_linenumber") - 1).cast("long").alias("idx"), (c("l_orderkey") % 4 + 1).cast("long").alias("total"), path.alias("path"), e.alias("e"), F.when(c("l_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit("base "), c("l_suppkey").cast("string"))).alias("base"))
    position = ingest.position_summary(c("path"), c("idx"), c("total"), c("e"))
    return rows.select("l_orderkey", "l_linenumber", ingest.merged_summary(c("base"), position, c("e"), c("path")).alias("summary"))


SECTIONS = "WITH m AS (SELECT conv_id, turn, 'a' || chr(10) || '# One' || chr(10) || text || chr(10) || '## Sub' || chr(10) || role || chr(10) || '# Two' || chr(10) || 'end' AS content FROM conversations WHERE NOT contains(text, '#'))"


@query("heading_section", SECTIONS + " SELECT conv_id, turn, split_part(substr(content, 3), chr(10) || '# Two', 1) AS one, '## Sub' || chr(10) || role_ AS sub, '' AS none FROM (SELECT *, split_part(split_part(content, '## Sub' || chr(10), 2), chr(10), 1) AS role_ FROM m)")
def heading_section(spark, d):
    content = F.concat(F.lit("a\n# One\n"), F.col("text"), F.lit("\n## Sub\n"), F.col("role"), F.lit("\n# Two\nend"))
    section = lambda spec: ranges.apply_range(F.col("content"), ranges.parse_range(F.lit(spec)))
    rows = table(spark, d, "conversations").where(~F.contains("text", F.lit("#"))).select("conv_id", "turn", content.alias("content"))
    return rows.select("conv_id", "turn", section("#One").alias("one"), section("# One/Sub").alias("sub"), section("#None").alias("none"))


@query("thinking_steps", "SELECT conv_id, turn, array_to_string(CASE WHEN turn % 2 = 0 THEN [text, role] ELSE list_filter([trim(regexp_replace(a, '^" + WS + "|" + WS + "$', '', 'g')) || chr(10) || 'and some more of it', 'another step of the answer'], lambda s: strlen(s) > 20) END, '|') AS steps FROM (SELECT *, replace(replace(replace(text, chr(10), ' '), chr(13), ' '), '.', ',') AS a FROM conversations WHERE strlen(text) > 25 AND regexp_matches(text, '^[A-RU-Za-z]'))")
def thinking_steps(spark, d):
    """Even turns think in tags, odd ones in lines that boundaries part."""
    flat = F.replace(F.translate("text", "\n\r", "  "), F.lit("."), F.lit(","))
    bare = F.trim(F.regexp_replace(flat, f"^{tx.SPACE}|{tx.SPACE}$", ""))
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("x <think>"), "text", F.lit("</think> y <think>"), "role", F.lit("</think>"))).otherwise(F.concat(bare, F.lit("\nand some more of it\n2. next\nanother step of the answer\n\nshort\n")))
    rows = table(spark, d, "conversations").where((F.octet_length("text") > 25) & F.col("text").rlike("^[A-RU-Za-z]"))
    return rows.select("conv_id", "turn", F.array_join(protocol.thinking_steps(said), "|").alias("steps"))


@query("verdict_scores", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN least(1.0, greatest(0.0, round(value / 50 - 0.5, 4))) WHEN 1 THEN 0.5 WHEN 2 THEN NULL WHEN 3 THEN 1.0 WHEN 4 THEN 0.25 WHEN 5 THEN NULL ELSE NULL END::DOUBLE AS score FROM events""")
def verdict_scores(spark, d):
    """Judges' answers of seven kinds: sound, without quotes, not a number, out of range, with prose around, without a score, null."""
    k = F.col("event_id") % 7
    raw = F.concat(F.lit('{"score": '), F.round(F.col("value") / 50 - 0.5, 4).cast("decimal(12,4)").cast("string"), F.lit(', "rationale": "r"}'))
    for n, said in enumerate(('{"score": 0.5, "rationale": The answer is right.}', '{"score": "high"}', '{"score": 7}', 'Well {"rationale": "a {b}", "score": 0.25} so', "no verdict"), 1):
        raw = F.when(k == n, said).otherwise(raw)
    return table(spark, d, "events").select("event_id", protocol.verdict_score(F.when(k < 6, raw)).alias("score"))


@query("stub_references", """SELECT event_id, 'e' || event_id || '|' || event_type AS ids FROM events""")
def stub_references(spark, d):
    said = F.concat(F.lit('see <file id="e'), F.col("event_id").cast("string"), F.lit('" path="a/b.rs">x</file> and <file id="'), "event_type", F.lit('"/>, not <file ident="z">'))
    return table(spark, d, "events").select("event_id", F.array_join(protocol.stub_references(said), "|").alias("ids"))


@query("line_references", "SELECT event_id, 'src/' || event_type || '.rs' AS path, (event_id % 90)::BIGINT AS first, (event_id % 90 + event_id % 3)::BIGINT AS last FROM events")
def line_references(spark, d):
    n = F.col("event_id") % 90
    said = F.concat(F.lit("look at src/"), "event_type", F.lit(".rs:"), n.cast("string"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("-"), (n + F.col("event_id") % 3).cast("string"))).otherwise(""), F.lit(" and a.b"))
    return table(spark, d, "events").select("event_id", F.explode(protocol.line_references(said)).alias("r")).select("event_id", "r.path", "r.first", "r.last")


@query("stamps", "SELECT event_id, strftime(date_trunc('second', ts), '%Y%m%d-%H%M%S') AS stamp FROM events")
def stamps(spark, d):
    return table(spark, d, "events").select("event_id", tx.stamp(F.unix_timestamp(F.date_trunc("second", "ts"))).alias("stamp"))


@query("chunks_of_source", STUBS + " SELECT id, chunk_index * 100 AS byte_offset FROM s WHERE NOT stale AND NOT ignored AND path = 'o1'")
def chunks_of_source(spark, d):
    return stubs.chunks_of(_stubs(spark, d).withColumn("byte_offset", F.col("chunk_index") * 100), F.lit("o1"))


@query("chunk_geometry", STUBS + " SELECT path, id, chunk_index * 100 AS off, mtime + 1 AS len FROM s WHERE NOT stale AND NOT ignored")
def chunk_geometry(spark, d):
    return stubs.geometry(_stubs(spark, d).withColumn("byte_offset", F.col("chunk_index") * 100).withColumn("byte_length", F.col("mtime") + 1))


@query("live_hits", NORMAL + " SELECT query_id, id, rank, score FROM m JOIN documents ON doc_id = id WHERE id % 3 <> 0 AND id % 5 <> 0")
def live_hits(spark, d):
    """Hits whose stub is neither stale nor ignored: fewer than asked may remain."""
    held = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3 == 0).alias("stale"), (F.col("doc_id") % 5 == 0).alias("ignored"))
    return stubs.searchable(_normal(spark, d), held).select("query_id", "id", "rank", "score")


@query("inventory_queries", f"SELECT item_id, text || '{fusion.INVENTORY}' AS query FROM benchmark")
def inventory_queries(spark, d):
    return table(spark, d, "benchmark").select("item_id", fusion.inventory_query(F.col("text")).alias("query"))


@query("upgraded_bodies", "SELECT doc_id, CASE WHEN n_chars > 1500 THEN left(text, 4500) || chr(10) || '… [truncated: ' || n_chars || ' tokens; ask for a range of ' || source || ']' ELSE text END AS body FROM documents")
def upgraded_bodies(spark, d):
    return table(spark, d, "documents").select("doc_id", workspace.upgraded(F.col("text"), F.col("n_chars"), F.col("source")).alias("body"))


@query("mentioned_files", NORMAL + ", a AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY rank) AS nth FROM m WHERE score >= 0.3 AND path IN ('src' || query_id % 5, 'src' || query_id % 7)) SELECT query_id, id, path, score, rank FROM a WHERE nth = 1")
def mentioned_files(spark, d):
    """Each question's answer names two sources."""
    said = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("See src"), (F.col("item_id") % 5).cast("string"), F.lit(" and [src"), (F.col("item_id") % 7).cast("string"), F.lit("].")).alias("response"))
    hits = _normal(spark, d).where(~F.col("path").rlike(r"^src\d\d"))
    return fusion.mentioned(hits, said, 0.3).select("query_id", "id", "path", "score", "rank")


@query("ledger_record", TERMS + " SELECT doc_id AS id, source, array_to_string(coalesce(l, []), ',') AS terms FROM documents LEFT JOIN (SELECT id, list(term ORDER BY rank) AS l FROM top GROUP BY id) ON id = doc_id UNION ALL SELECT -1, 'kept', 'old'")
def ledger_record(spark, d):
    """A ledger of one fragment takes all documents."""
    ledger = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("kept").alias("source"), F.lit("").alias("content"), F.array(F.lit("old")).alias("terms"))
    docs = texts(spark, d).select(F.col("doc_id").alias("id"), "source", F.col("text").alias("content"))
    return provenance.record(ledger, docs).select("id", "source", F.array_join("terms", ",").alias("terms"))


@query("overlap_warnings", "SELECT p_partkey, '- ''' || p_type || ''' and ''' || p_brand || ''' share terms [' || array_to_string(string_split(p_name, ' '), ', ') || '] (' || (p_partkey % 101) || '% overlap)' AS warning FROM part")
def overlap_warnings(spark, d):
    warning = provenance.overlap_warning(F.col("p_type"), F.col("p_brand"), F.split("p_name", " "), F.col("p_partkey") % 101 / 100)
    return table(spark, d, "part").select("p_partkey", warning.alias("warning"))


@query("rejudged", "SELECT item_id FROM benchmark WHERE item_id % 3 = 0 ")
def rejudged(spark, d):
    answer = F.when(F.col("item_id") % 3 == 0, F.col("text")).when(F.col("item_id") % 3 == 1, "")
    return evaluation.rejudged(table(spark, d, "benchmark").withColumn("reference_answer", answer)).select("item_id")


@query("ensemble_vote", """WITH m AS (SELECT s_suppkey AS model, row_number() OVER (ORDER BY round(s_acctbal / 10000, 2) DESC, s_suppkey % 3, s_suppkey) AS r FROM supplier),
v AS (SELECT l_orderkey AS "case", l_quantity::INT AS q FROM lineitem WHERE l_suppkey IN (SELECT model FROM m WHERE r <= 5))
SELECT "case", count(*)::BIGINT AS votes, count(*) FILTER (q % 2 = 0) >= count(*) // 2 + 1 AS wants_explanation, count(*) FILTER (q % 3 = 0) >= count(*) // 2 + 1 AS is_status_request,
  CASE WHEN count(*) FILTER (q % 5 = 0) >= count(*) // 2 + 1 THEN 'needs_git_status' ELSE '' END AS hints FROM v GROUP BY 1""")  # fmt: skip
def ensemble_vote(spark, d):
    """Suppliers are models, line items their votes: the five best vote."""
    c = F.col
    models = table(spark, d, "supplier").select(c("s_suppkey").alias("model"), F.round(c("s_acctbal") / 10000, 2).alias("f1"), (c("s_suppkey") % 3).alias("failures"))
    out = intent.ensemble(_votes(spark, d).withColumnRenamed("l_suppkey", "model"), models, 5)
    return out.select("case", "votes", "wants_explanation", "is_status_request", F.array_join("hints", ",").alias("hints"))


@query("path_metrics", """
WITH l AS (SELECT l_orderkey AS query_id, 'lib/p' || l_partkey % 5 || '.rs' AS path, l_linenumber AS rank, l_partkey % 4 = 0 AS stub FROM lineitem), e AS (SELECT o_orderkey AS query_id, unnest(['p' || o_custkey % 5 || '.rs', 'x/lib/p' || o_custkey % 3 || '.rs', 'lib.rs']) AS want FROM orders WHERE o_orderstatus <> 'P'),
w AS (SELECT query_id, want, count(*) AS times FROM e GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY query_id, stub ORDER BY rank, path) AS place FROM l),
h AS (SELECT w.query_id, want, times, stub, place FROM w JOIN p ON p.query_id = w.query_id AND (path = want OR ends_with(path, '/' || want) OR ends_with(want, '/' || path))),
f AS (SELECT query_id, want, min(place) FILTER (NOT stub) AS first FROM h GROUP BY 1, 2),
r AS (SELECT query_id, sum(times) AS n, sum(times) FILTER (first IS NOT NULL) AS bodies, sum(times) FILTER (f.want IS NOT NULL) AS some_, sum(times / first) AS rr FROM w LEFT JOIN f USING (query_id, want) GROUP BY 1),
g AS (SELECT query_id, count(DISTINCT place) AS hit, max((place = 1)::INT)::DOUBLE AS top FROM h WHERE NOT stub GROUP BY 1), b AS (SELECT query_id, count(*) AS held FROM p WHERE NOT stub GROUP BY 1),
q AS (SELECT query_id FROM l UNION SELECT query_id FROM e)
SELECT query_id, round(CASE WHEN n > 0 THEN coalesce(bodies, 0) / n ELSE 1.0 END, 6)::DOUBLE AS recall, round(CASE WHEN n > 0 THEN coalesce(some_, 0) / n ELSE 1.0 END, 6)::DOUBLE AS stub_recall, round(CASE WHEN held > 0 THEN coalesce(hit, 0) / held ELSE 0.0 END, 6)::DOUBLE AS relevance,
  coalesce(top, 0.0)::DOUBLE AS precision_at_1, round(CASE WHEN n > 0 THEN coalesce(rr, 0) / n ELSE 1.0 END, 6)::DOUBLE AS mrr
FROM q LEFT JOIN r USING (query_id) LEFT JOIN g USING (query_id) LEFT JOIN b USING (query_id)""")  # fmt: skip
def path_metrics(spark, d):
    """Line items are the paths loaded for their order; orders expect three paths, some of them short ones."""
    c, s = F.col, lambda x: x.cast("string")
    loaded = table(spark, d, "lineitem").select(c("l_orderkey").alias("query_id"), F.concat(F.lit("lib/p"), s(c("l_partkey") % 5), F.lit(".rs")).alias("path"), c("l_linenumber").alias("rank"), (c("l_partkey") % 4 == 0).alias("stub"))
    want = F.array(F.concat(F.lit("p"), s(c("o_custkey") % 5), F.lit(".rs")), F.concat(F.lit("x/lib/p"), s(c("o_custkey") % 3), F.lit(".rs")), F.lit("lib.rs"))
    expected = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(c("o_orderkey").alias("query_id"), F.explode(want).alias("path"))
    return evaluation.path_metrics(loaded, expected)


@query("edge_replace", EDGES + " SELECT src, dst, relation, weight FROM e WHERE relation = 'A'")
def edge_replace(spark, d):
    """All edges are written, then those of one relation, read from the same table, in their place."""
    path = new_path(spark, "edges")
    return graph.write_edges(graph.write_edges(_edges(spark, d), path).where("relation = 'A'"), path)


@query("vector_moments", """
WITH v AS (SELECT embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT len(e) AS d FROM v LIMIT 1), i AS (SELECT unnest(range(1, d + 1)) AS i FROM n),
c AS (SELECT a.i AS i, b.i AS j, sum(e[a.i] * e[b.i]) AS s FROM v, i a, i b WHERE a.i <= b.i GROUP BY 1, 2), m AS (SELECT i, avg(e[i]) AS m FROM v, i GROUP BY 1)
SELECT c.i::INT AS i, c.j::INT AS j, round(s / (SELECT count(*) FROM v) - x.m * y.m, 8) AS covariance FROM c JOIN m x ON x.i = c.i JOIN m y ON y.i = c.j""")  # fmt: skip
def vector_moments(spark, d):
    """The covariance that whitening takes its components from."""
    vectors = table(spark, d, "embeddings").select(F.col("embedding").alias("v"))
    size = vectors.select(F.size("v")).first()[0]
    n, sums, products = evaluation.second_moments(vectors, "v", size)
    cov = products / n - (sums / n)[:, None] * (sums / n)[None, :]
    return spark.createDataFrame([(i + 1, j + 1, round(float(cov[i, j]), 8)) for i in range(size) for j in range(i, size)], "i int, j int, covariance double")


@query("line_chunks", r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'x', 'g') AS t FROM documents), l AS (SELECT *, strlen(t) AS n FROM t),
s AS (SELECT doc_id, -1 AS idx, 0::BIGINT AS a, 0::BIGINT AS b FROM l WHERE n // 3 > 500
  UNION ALL
  SELECT doc_id, idx, a, CASE WHEN n - a <= 1800 THEN n WHEN ahead > 0 THEN a + 1400 + ahead WHEN back > 0 THEN a + 1800 - back + 1 ELSE a + 1800 END
  FROM (SELECT l.doc_id, idx + 1 AS idx, b AS a, n, strpos(substr(t, b + 1401, 400), chr(10)) AS ahead, strpos(reverse(substr(t, b + 1, 1800)), chr(10)) AS back FROM s JOIN l ON l.doc_id = s.doc_id WHERE b < n)),
o AS (SELECT s.*, t, greatest(a - 280, 0) AS p, greatest(greatest(a - 280, 0) - 280, 0) AS low FROM s JOIN l USING (doc_id) WHERE idx >= 0),
k AS (SELECT *, CASE WHEN strpos(reverse(substr(t, low + 1, p - low)), chr(10)) > 0 THEN p - strpos(reverse(substr(t, low + 1, p - low)), chr(10)) + 1 ELSE low END AS lead FROM o)
SELECT doc_id, idx::BIGINT AS idx, count(*) OVER (PARTITION BY doc_id) AS total, a AS "start", b AS "end", b - a + CASE WHEN idx = 0 THEN 0 ELSE a - lead + CASE WHEN substr(t, a, 1) = chr(10) THEN 0 ELSE 1 END END AS bytes FROM k
UNION ALL SELECT doc_id, 0, 1, 0, n, n FROM l WHERE n // 3 <= 500""")  # fmt: skip
def line_chunks(spark, d):
    """Where lines cut the documents (as ASCII, so that the SQL's characters are bytes), and how long a chunk is with its overlap."""
    docs = texts(spark, d).select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "x").alias("content"))
    cut = ingest.with_chunks(docs, path=None, config=Chunking(max_body_tokens=2**31))
    return cut.select("doc_id", "chunk.idx", "chunk.total", "chunk.start", "chunk.end", F.octet_length("chunk.text").cast("long").alias("bytes"))
