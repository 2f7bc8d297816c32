"""Protocol queries over conversations dressed in the model's marks, and loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import protocol as p, text as tx
from ..operators import render
from ..registry import query, table, texts
from ..sources import records
from .documents import TOPIC, WS

#: A turn's text with probes, notes, thinking and references around it.
MARKED = "SELECT conv_id, turn, role, text, '<think>' || role || ' considers ' || turn || '</think> <probe>' || role || '</probe> see src/mod_' || conv_id || '.rs:' || turn + 3 || '-' || turn + 9 || ' <note id=\"s' || conv_id || '\">keep</note> ' || text || '<probe>turn ' || turn || '</probe><|im_end|>' AS m FROM conversations"


def marked(spark, d):
    c, s = F.col, lambda x: F.col(x).cast("string")
    m = F.concat(F.lit("<think>"), c("role"), F.lit(" considers "), s("turn"), F.lit("</think> <probe>"), c("role"), F.lit("</probe> see src/mod_"), s("conv_id"), F.lit(".rs:"), (c("turn") + 3).cast("string"), F.lit("-"), (c("turn") + 9).cast("string"), F.lit(' <note id="s'), s("conv_id"), F.lit('">keep</note> '), c("text"), F.lit("<probe>turn "), s("turn"), F.lit("</probe><|im_end|>"))
    return table(spark, d, "conversations").withColumn("m", m)


@query("extract_probes", f"WITH c AS ({MARKED}) SELECT conv_id, turn, role AS first_probe, 'turn ' || turn AS last_probe, (strlen(split_part(m, '<probe>', 1)))::BIGINT AS first_at, (strlen(m) - strlen('<probe>turn ' || turn || '</probe><|im_end|>'))::BIGINT AS last_at FROM c")
def extract_probes(spark, d):
    x = p.probes(F.col("m"))
    return marked(spark, d).select("conv_id", "turn", x.alias("x")).select("conv_id", "turn", F.col("x")[0]["text"].alias("first_probe"), F.element_at("x", -1)["text"].alias("last_probe"), F.col("x")[0]["position"].alias("first_at"), F.element_at("x", -1)["position"].alias("last_at"))


@query("extract_notes", f"WITH c AS ({MARKED}) SELECT conv_id, turn, 's' || conv_id AS id, 'keep' AS content, 'src/mod_' || conv_id || '.rs' AS path, turn + 3 AS first, turn + 9 AS last FROM c")
def extract_notes(spark, d):
    n, r = p.annotations(F.col("m")), p.line_references(F.col("m"))
    return marked(spark, d).select("conv_id", "turn", n[0]["id"].alias("id"), n[0]["content"].alias("content"), r[0]["path"].alias("path"), r[0]["first"].alias("first"), r[0]["last"].alias("last"))


@query("split_thinking", f"WITH c AS ({MARKED}) SELECT conv_id, turn, role || ' considers ' || turn AS thinking, regexp_replace(substr(m, instr(m, '</think>') + 8), '^{WS}|{WS}$', '', 'g') AS answer FROM c")
def split_thinking(spark, d):
    return marked(spark, d).select("conv_id", "turn", p.split_thinking(F.col("m")).alias("x")).select("conv_id", "turn", "x.thinking", "x.answer")


@query("strip_markers", f"WITH c AS ({MARKED}) SELECT conv_id, turn, regexp_replace(' ' || ' see src/mod_' || conv_id || '.rs:' || turn + 3 || '-' || turn + 9 || ' keep ' || text, '^{WS}|{WS}$', '', 'g') AS clean, regexp_replace(split_part(m, '<|im_end|>', 1), '{WS}$', '') AS cut FROM c")
def strip_markers(spark, d):
    return marked(spark, d).select("conv_id", "turn", p.strip_markers(F.col("m")).alias("clean"), p.truncate_at_chat(F.col("m")).alias("cut"))


@query("fake_recalls", "SELECT conv_id, turn, 1::BIGINT AS n, text || '' || role AS stripped FROM conversations")
def fake_recalls(spark, d):
    m = F.concat(F.col("text"), F.lit("[recalled from a/b.md]\nx\ny\n[end recall]"), F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", p.count_fake_recalls(m).alias("n"), p.strip_fake_recalls(m).alias("stripped"))


@query("loop_detect", f"""
WITH b AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{WS}'), lambda w: w <> '') AS w FROM documents),
n AS (SELECT *, len(w) AS n, list_sort(w)[len(w) // 2 + 1] AS mid FROM b),
m AS (SELECT *, floor(len(list_filter(w, lambda x: x = mid)) * 100 / n)::BIGINT AS share, CASE WHEN n >= 30 THEN len(list_distinct(list_transform(range(1, n - 1), lambda i: array_to_string(w[i:i+2], ' ')))) END AS u,
  list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: regexp_replace(x, '^{WS}|{WS}$', '', 'g')), lambda x: strlen(x) > 30) AS l FROM n),
r AS (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, unnest(l) AS x FROM m WHERE len(l) >= 6) GROUP BY 1, 2 HAVING count(*) >= 3),
t AS (SELECT doc_id, (min({{'k': -k, 'x': x}})) AS s FROM r GROUP BY 1)
SELECT m.doc_id, CASE WHEN n < 20 THEN NULL WHEN share > 70 THEN 'word_dominance: ''' || mid || ''' at ' || share || '% of ' || n || ' tokens'
  WHEN n >= 30 AND u * 10 < n - 2 THEN 'trigram_collapse: ' || u || '/' || n - 2 || ' unique trigrams (' || (u * 100) // (n - 2) || '%)'
  WHEN s IS NOT NULL THEN 'line_repetition: ''' || left(s.x, 60) || '...'' ×' || -s.k || ' (first at byte ' || strlen(split_part(text, s.x, 1)) || ')' END AS reason
FROM m LEFT JOIN t USING (doc_id)""")
def loop_detect(spark, d):
    return texts(spark, d).select("doc_id", p.detect_loop(F.col("text")).alias("reason"))


PAIRS = "WITH t AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), q AS (SELECT * FROM t WHERE b IS NOT NULL)"
BARE = "list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(lower(@), '" + WS + r"'), lambda w: w <> ''), lambda w: regexp_replace(w, '[^\p{L}\p{N}]', '', 'g')), lambda w: w <> ''))"
PLAIN = r"list_distinct(list_filter(regexp_split_to_array(lower(@), '[^\p{L}\p{N}]+'), lambda t: strlen(t) > 2))"
COEF = "round(CASE WHEN least(len({0}), len({1})) > 0 THEN len(list_intersect({0}, {1})) / least(len({0}), len({1})) ELSE 0 END, 6)"


@query("term_overlaps", PAIRS + f", s AS (SELECT conv_id, turn, {BARE.replace('@', 'a')} AS ja, {BARE.replace('@', 'b')} AS jb, list_distinct({TOPIC.format('a')}) AS ta, list_distinct({TOPIC.format('b')}) AS tb, {PLAIN.replace('@', 'a')} AS pa, {PLAIN.replace('@', 'b')} AS pb FROM q) SELECT conv_id, turn, round(CASE WHEN len(list_distinct(ja || jb)) > 0 THEN len(list_intersect(ja, jb)) / len(list_distinct(ja || jb)) ELSE 0 END, 6) AS jaccard, {COEF.format('ta', 'tb')} AS topics, {COEF.format('pa', 'pb')} AS plain FROM s")
def term_overlaps(spark, d):
    """Of each turn and the next."""
    from pyspark.sql import Window

    t = table(spark, d, "conversations").withColumn("b", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    a, b = F.col("text"), F.col("b")
    return t.select("conv_id", "turn", F.round(tx.jaccard_words(a, b), 6).alias("jaccard"), F.round(tx.overlap_topics(a, b), 6).alias("topics"), F.round(tx.overlap_plain(a, b), 6).alias("plain"))


@query("workspace_render", "SELECT conv_id AS session, '" + (render.LEAD + "\nAnswering hints:\n" + render.BASELINE).replace("'", "''") + "' || chr(10) || '- Be brief.' || chr(10) || chr(10) || string_agg('<recalled from=\"' || role || ':' || turn || '-' || turn || '\">' || chr(10) || text || chr(10) || '</recalled>', chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def workspace_render(spark, d):
    span = F.concat(F.col("turn").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    f = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), F.lit("s").alias("stub_id"), F.col("role").alias("source"), span.alias("locator"), F.col("text").alias("content"))
    return render.workspace_text(f, F.array(F.lit("Be brief."), F.lit(" Be brief. ")))


@query("session_roundtrip", f"WITH u AS (SELECT conv_id AS session, turn, regexp_replace(text, '^{WS}|{WS}$', '', 'g') AS t FROM conversations) SELECT session, turn, t AS user, CASE WHEN turn % 4 <> 3 THEN t END AS assistant FROM u WHERE t <> '' AND NOT contains(t, chr(10) || chr(10) || '[') AND NOT contains(t, chr(10) || chr(10) || '---')")
def session_roundtrip(spark, d):
    """Turns written as session files and parsed again; every fourth was degenerate."""
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "turn", F.col("text").alias("user"), F.col("text").alias("answer"), (F.col("turn") % 4 == 3).alias("degenerate"))
    return records.parse_sessions(records.session_files(t)).select("session", "turn", "user", "assistant")
