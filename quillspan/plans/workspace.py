"""Admission, workspace, curation and event queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import admission, curation, workspace
from ..registry import query, table, texts
from .documents import TOPIC, WORDS, WS
from .retrieval import K, bm25_hits
from .sql import BM25, ranked_sql

LOADED = "WITH l AS (SELECT source AS session, doc_id AS id, n_chars AS tokens, round(((doc_id * 37) % 1000) / 1000.0, 6)::DOUBLE AS score, (doc_id % 11)::BIGINT AS mtime FROM documents)"


def _loaded(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("session"), F.col("doc_id").alias("id"), F.col("n_chars").alias("tokens"), F.round((F.col("doc_id") * 37 % 1000) / 1000.0, 6).alias("score"), (F.col("doc_id") % 11).alias("mtime"))


@query("evict_prefix", LOADED + ", w AS (SELECT *, sum(tokens) OVER (PARTITION BY session) - coalesce(sum(tokens) OVER (PARTITION BY session ORDER BY score, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM l) SELECT session, id, score, score < 0.55 OR held > 20000 AS evicted FROM w")
def evict_prefix(spark, d):
    return admission.evictions(_loaded(spark, d), 20_000).select("session", "id", "score", "evicted")


@query("evict_latest", LOADED + ", w AS (SELECT *, sum(tokens) OVER (PARTITION BY session) - coalesce(sum(tokens) OVER (PARTITION BY session ORDER BY score, mtime, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM l) SELECT session, id, score, score < 0.2 OR held > 9000 AS evicted FROM w")
def evict_latest(spark, d):
    return admission.evictions(_loaded(spark, d), 9_000, unload=0.2, latest_only=True).select("session", "id", "score", "evicted")


@query("score_decay", LOADED + " SELECT session, id, round(score * pow(0.8, mtime), 6) AS score FROM l")
def score_decay(spark, d):
    return _loaded(spark, d).select("session", "id", F.round(workspace.decayed(F.col("score"), F.col("mtime")), 6).alias("score"))


#: First-fit by recursion: state is the tokens used, whether the budget is full and the admitted sources.
CLAMP = BM25.replace("WITH ", "WITH RECURSIVE ", 1) + ", h AS (SELECT * FROM (" + ranked_sql("bm", 3 * K) + f""")),
c AS (SELECT query_id, h.id, rank, source, greatest(len({WORDS}), 1) AS tokens FROM h JOIN documents ON doc_id = id),
s AS (SELECT query_id, 0 AS rank, 0::BIGINT AS id, 0::BIGINT AS used, FALSE AS full_, []::VARCHAR[] AS seen, '' AS disposition FROM (SELECT DISTINCT query_id FROM c)
  UNION ALL
  SELECT query_id, rank, id, used + CASE WHEN disposition = 'admitted' THEN tokens ELSE 0 END, full_ OR disposition = 'clamped', CASE WHEN disposition = 'admitted' THEN list_append(seen, source) ELSE seen END, disposition
  FROM (SELECT c.*, used, full_, seen, CASE WHEN len(list_filter(seen, lambda x: x = source)) >= 3 THEN 'duplicate_source' WHEN full_ THEN 'budget_full' WHEN used + tokens > 2000 AND used > 0 THEN 'clamped' ELSE 'admitted' END AS disposition
        FROM s JOIN c ON c.query_id = s.query_id AND c.rank = s.rank + 1))
SELECT query_id, id, rank, disposition FROM s WHERE rank > 0"""


def _hits(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return bm25_hits(spark, d, 3 * K).join(docs, "id").withColumn("tokens", tx.token_count(F.col("text"))).drop("text")


@query("clamp_dispositions", CLAMP)
def clamp_dispositions(spark, d):
    return admission.clamp(_hits(spark, d), 2000)


#: A question's hits with their tokens; recursion over them carries a budget.
HITS = BM25.replace("WITH ", "WITH RECURSIVE ", 1) + ", h AS (SELECT * FROM (" + ranked_sql("bm", 3 * K) + f")), c AS (SELECT query_id AS session, h.id, rank, source, greatest(len({WORDS}), 1) AS tokens FROM h JOIN documents ON doc_id = id)"


@query("greedy_scheduler", HITS + """,
x AS (SELECT session, 1 AS call, 'candidate' AS role, rank, id, tokens, 1.0::DOUBLE - rank / 100 AS score FROM c
  UNION ALL SELECT session, 2, CASE WHEN rank <= 5 THEN 'loaded' ELSE 'candidate' END, rank, id, tokens, CASE WHEN rank <= 5 THEN 1.0::DOUBLE - rank / 100 ELSE 1.0::DOUBLE - rank / 100 - 0.2::DOUBLE END FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY session, call ORDER BY role DESC, rank) AS n FROM x),
s AS (SELECT DISTINCT session, call, 0::BIGINT AS n, 0::BIGINT AS id, '' AS role, 0::BIGINT AS used, FALSE AS ok FROM x
  UNION ALL
  SELECT session, call, n, id, role, used + CASE WHEN ok THEN tokens ELSE 0 END, ok
  FROM (SELECT n.*, s.used, s.used + tokens <= 1500 AND score >= CASE n.role WHEN 'loaded' THEN 0.55 ELSE 0.7 END AS ok FROM s JOIN n ON n.session = s.session AND n.call = s.call AND n.n = s.n + 1))
SELECT session, call, id, CASE WHEN NOT ok THEN 'evicted' WHEN role = 'loaded' THEN 'keep' ELSE 'admitted' END AS decision FROM s WHERE n > 0 AND (ok OR role = 'loaded')""")  # fmt: skip
def greedy_scheduler(spark, d):
    """Two calls a question: its hits as candidates, then the first five as loaded with the next as candidates."""
    hits = _hits(spark, d).withColumn("score", F.lit(1.0) - F.col("rank") / 100)
    first = hits.select(F.col("query_id").alias("session"), F.lit(1).alias("call"), F.lit("candidate").alias("role"), F.col("rank").alias("pos"), "id", "tokens", "score")
    second = hits.select(F.col("query_id").alias("session"), F.lit(2).alias("call"), F.when(F.col("rank") <= 5, "loaded").otherwise("candidate").alias("role"), F.col("rank").alias("pos"), "id", "tokens", (F.col("score") - 0.2).alias("score"))
    return admission.schedule(first.unionByName(second), 1500)


@query("load_fragments", HITS + """,
f AS (SELECT DISTINCT session FROM c), t AS (SELECT f.session, r.source, r.tokens FROM f LEFT JOIN c r ON r.session = f.session AND r.rank = 3),
s AS (SELECT session, 0 AS rank, 0::BIGINT AS id, coalesce(tokens, 0)::BIGINT AS used, CASE WHEN source = 'src2' THEN tokens ELSE 0 END::BIGINT AS past, CASE WHEN source IS NULL THEN [] ELSE [source] END::VARCHAR[] AS seen, '' AS outcome FROM t
  UNION ALL
  SELECT session, rank, id, used + CASE WHEN outcome = 'loaded' THEN tokens ELSE 0 END, past + CASE WHEN outcome = 'loaded' AND source = 'src2' THEN tokens ELSE 0 END, CASE WHEN outcome = 'loaded' THEN list_append(seen, source) ELSE seen END, outcome
  FROM (SELECT c.*, used, past, seen, CASE WHEN c.rank = 3 THEN 'raised' WHEN used >= 3000 THEN 'budget_full' WHEN 1 - c.rank / 60 < 0.7 THEN 'below_load' WHEN source = 'src2' AND past + tokens > 750 THEN 'history_cap'
          WHEN source <> 'src0' AND len(list_filter(seen, lambda v: v = source)) >= 3 THEN 'source_cap' WHEN used + tokens > 3000 THEN 'too_large' ELSE 'loaded' END AS outcome
        FROM s JOIN c ON c.session = s.session AND c.rank = s.rank + 1))
SELECT session, id, outcome, 1 - rank / 60::DOUBLE AS score FROM s WHERE rank > 0""")  # fmt: skip
def load_fragments(spark, d):
    c = F.col
    hits = _hits(spark, d).select(c("query_id").alias("session"), c("rank").alias("pos"), "id", "source", "tokens", (1 - c("rank") / 60).alias("score"), F.when(c("rank") == 3, 0.5).alias("resident"), (c("source") == "src2").alias("history"), (c("source") == "src0").alias("exempt"))
    return admission.load_fragments(hits, 3000)


@query("refresh_scores", f"""
WITH t AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), q AS (SELECT * FROM t WHERE b IS NOT NULL),
s AS (SELECT conv_id, turn, list_distinct({TOPIC.format('a')}) AS x, list_distinct({TOPIC.format('b')}) AS y FROM q),
o AS (SELECT *, CASE WHEN least(len(x), len(y)) > 0 THEN len(list_intersect(x, y)) / least(len(x), len(y)) ELSE 0.0 END AS o FROM s)
SELECT conv_id, turn, round(CASE WHEN o > 0.05 + 0.02 THEN o ELSE 0.05 END, 6) AS score FROM o""")  # fmt: skip
def refresh_scores(spark, d):
    t = table(spark, d, "conversations").withColumn("b", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    return t.select("conv_id", "turn", F.round(workspace.refreshed(F.lit(0.05), F.col("text"), F.col("b"), 0.02), 6).alias("score"))


@query("eviction_notes", f"SELECT doc_id, 'Evicted (relevance decayed to 0.50) during query about ''' || lang || '''. Source: ' || source || '. Topic: ' || CASE WHEN strlen(t) <= 120 THEN t ELSE left(t, 117) || '...' END AS note FROM (SELECT *, regexp_replace(text, '^{WS}|{WS}$', '', 'g') AS t FROM documents)")
def eviction_notes(spark, d):
    return texts(spark, d).select("doc_id", workspace.eviction_note(F.lit(0.5), F.col("lang"), F.col("source"), F.col("text")).alias("note"))


@query("note_header", "SELECT conv_id, turn, '[Prior session notes for this source:' || chr(10) || '- b' || chr(10) || '- c' || chr(10) || '(1 older eviction(s) omitted)' || chr(10) || ']' || chr(10) || chr(10) || text AS noted, text AS plain FROM conversations")
def note_header(spark, d):
    noted = workspace.with_notes(F.col("text"), F.array(*map(F.lit, "abc")))
    return table(spark, d, "conversations").select("conv_id", "turn", noted.alias("noted"), workspace.without_notes(noted).alias("plain"))


@query("answer_quality", f"SELECT conv_id, turn, round(len({WORDS}) * CASE WHEN turn % 3 = 0 THEN 0.3 ELSE 1.0 END, 6)::DOUBLE AS quality FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'I cannot find it. ' || text ELSE text END AS text FROM conversations)")
def answer_quality(spark, d):
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("I cannot find it. "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(workspace.answer_quality(said), 6).alias("quality"))


@query("compress_answer", r"WITH h AS (SELECT conv_id, turn, text, left(text, 299) AS h, regexp_extract(left(text, 299), '(?s)^(.*\.) ', 1) AS s FROM conversations) SELECT conv_id, turn, CASE WHEN strlen(text) <= 300 THEN text ELSE regexp_replace(CASE WHEN s <> '' THEN s ELSE h END, '\s+$', '') || '…' END AS short FROM h")
def compress_answer(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", workspace.compress_answer(F.col("text")).alias("short"))


@query("tail_windows", f"WITH w AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations), e AS (SELECT conv_id, turn, w, unnest(range(8, len(w) + 1, 8)) AS e FROM w) SELECT conv_id, turn, e::INT AS upto, array_to_string(w[greatest(e - 23, 1):e], ' ') AS query FROM e")
def tail_windows(spark, d):
    """Every 8 tokens, the last 24."""
    q = F.posexplode(workspace.tail_windows(F.col("text"), 24, 8)).alias("n", "query")
    return table(spark, d, "conversations").select("conv_id", "turn", q).select("conv_id", "turn", ((F.col("n") + 1) * 8).alias("upto"), "query")


@query("probe_rate", "WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS s FROM events) SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) - count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND 43201 PRECEDING) AS in_window, count(*) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) - count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND 43201 PRECEDING) >= 3 AS throttled FROM e")
def probe_rate(spark, d):
    """Twelve hours, throttled at three: users make an event every few hours."""
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_timestamp(F.date_trunc("second", "ts")).alias("seconds"))
    return workspace.probe_rate(e, window=43_200, limit=3).select("event_id", "user_id", "in_window", "throttled")


@query("health_history", """
WITH RECURSIVE e AS (SELECT user_id AS component, event_id AS seq, event_type NOT IN ('error', 'view', 'purchase') AS ok, value AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT DISTINCT component, 0::BIGINT AS n, 0::BIGINT AS seq, 0::BIGINT AS calls, 0::BIGINT AS errors, 0::BIGINT AS streak, 'Healthy' AS health FROM e
  UNION ALL
  SELECT component, n, seq, CASE WHEN turn = 'up' THEN 0 ELSE calls END, CASE WHEN turn = 'up' THEN 0 ELSE errors END, CASE WHEN turn IN ('up', 'worse') THEN 0 ELSE streak END,
    CASE turn WHEN 'down' THEN 'Down' WHEN 'worse' THEN 'Degraded' WHEN 'up' THEN CASE WHEN health = 'Down' THEN 'Degraded' ELSE 'Healthy' END ELSE health END
  FROM (SELECT *, CASE WHEN health <> 'Down' AND calls >= 10 AND errors / calls > 0.6 AND NOT ok THEN 'down' WHEN health = 'Healthy' AND (ms > 400 OR (calls >= 10 AND errors / calls > 0.3)) THEN 'worse' WHEN streak >= 5 AND health <> 'Healthy' THEN 'up' ELSE '' END AS turn
        FROM (SELECT e.component, e.n, e.seq, ok, ms, health, calls + 1 AS calls, errors + (NOT ok)::INT AS errors, CASE WHEN ok THEN streak + 1 ELSE 0 END AS streak FROM s JOIN e ON e.component = s.component AND e.n = s.n + 1)))
SELECT component, seq, health FROM s WHERE n > 0""")  # fmt: skip
def health_history(spark, d):
    """Each user's events as a component's calls: a state machine, by recursion in the SQL."""
    e = table(spark, d, "events").select(F.col("user_id").alias("component"), F.col("event_id").alias("seq"), (~F.col("event_type").isin("error", "view", "purchase")).alias("ok"), F.col("value").alias("latency_ms"))
    return workspace.health_history(e, latency_limit=400.0)


@query("effective_tier", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'PassThrough' WHEN event_type = 'view' OR value > 50 THEN 'StubsAndToolsOnly' ELSE 'FullRecall' END AS tier FROM events")
def effective_tier(spark, d):
    e = F.col("event_type")
    tier = workspace.effective_tier(F.when(e == "error", workspace.DOWN).otherwise(workspace.HEALTHY), F.when(e == "view", workspace.DEGRADED).otherwise(workspace.HEALTHY), F.col("value") > 50)
    return table(spark, d, "events").select("event_id", tier.alias("tier"))


@query("stream_windows", "SELECT event_type, date_trunc('hour', ts) AS start, count(*)::BIGINT AS n, count(*) >= 10 AS throttled FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    """Hourly rates by a streaming query over the events, run to its end into a table in memory."""
    import uuid

    from ..streaming.jobs import windowed_rates

    name = "stream_windows_" + uuid.uuid4().hex
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    windowed_rates(events, late="1000 days").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


TURNS = f"WITH t AS (SELECT conv_id, turn, role, text, greatest(len({WORDS}), 1) AS tokens FROM conversations)"
PARTED = TURNS + ", p AS (SELECT *, sum(tokens) OVER c > floor(400 * 0.30) AND count(*) OVER c > 3 AND row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 3 AS \"summarize\" FROM t WINDOW c AS (PARTITION BY conv_id))"


def _turns(spark, d):
    return table(spark, d, "conversations").withColumn("tokens", tx.token_count(F.col("text")))


@query("history_partition", PARTED + " SELECT conv_id, turn, tokens::BIGINT AS tokens, \"summarize\" FROM p")
def history_partition(spark, d):
    return curation.partition_turns(_turns(spark, d), 400).select("conv_id", "turn", "tokens", "summarize")


SUMMARY = f"""x AS (SELECT conv_id, turn, role, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda s: regexp_replace(s, '^{WS}|{WS}$', '', 'g')), lambda s: s <> '') AS s FROM src),
y AS (SELECT conv_id, turn, ['[' || upper(left(role, 1)) || substr(role, 2) || '] ' || s[1]] || list_transform(list_filter(s[2:], lambda v: regexp_matches(lower(v), '({"|".join(curation.SIGNALS)})')), lambda v: '  - ' || v) || CASE WHEN len(s) > 1 THEN ['  ... ' || s[-1]] ELSE []::VARCHAR[] END AS l FROM x WHERE len(s) > 0),
z AS (SELECT conv_id, string_agg(array_to_string(l, chr(10)), chr(10) ORDER BY turn) AS summary FROM y GROUP BY 1)"""


@query("extractive_summary", "WITH src AS (SELECT * FROM conversations), " + SUMMARY + " SELECT DISTINCT c.conv_id, coalesce(summary, '') AS summary FROM conversations c LEFT JOIN z USING (conv_id)")
def extractive_summary(spark, d):
    return curation.extractive_summary(table(spark, d, "conversations").withColumnRenamed("text", "content"))


@query("curate_history", PARTED + ", src AS (SELECT * FROM p WHERE \"summarize\"), " + SUMMARY + f""", k AS (SELECT conv_id, count(*)::BIGINT AS retained, sum(tokens)::BIGINT AS a FROM p WHERE NOT "summarize" GROUP BY 1), o AS (SELECT conv_id, sum(tokens)::BIGINT AS dropped FROM src GROUP BY 1),
u AS (SELECT conv_id, summary, retained, 0::BIGINT AS compressed, a + coalesce(dropped, 0) AS tokens_before, a + CASE WHEN summary IS NULL THEN 0 ELSE greatest(len({WORDS.replace('text', 'summary')}), 1) END AS tokens_after FROM k LEFT JOIN z USING (conv_id) LEFT JOIN o USING (conv_id))
SELECT conv_id, summary, retained, compressed, tokens_before::BIGINT AS tokens_before, tokens_after::BIGINT AS tokens_after, greatest(tokens_before - tokens_after, 0)::BIGINT AS tokens_saved FROM u""")
def curate_history(spark, d):
    t = table(spark, d, "conversations").withColumnRenamed("text", "content").withColumn("tool_name", F.lit(None).cast("string")).withColumn("inline_required", F.lit(False))
    return curation.curate(t, 400)


@query("budget_check", f"WITH t AS (SELECT doc_id, greatest(len({WORDS}), 1) AS used FROM documents) SELECT doc_id, CASE WHEN used > 400 THEN 'Exceeded' WHEN used > 320 THEN 'Warning' ELSE 'Ok' END AS status, CASE WHEN used > 400 THEN 'System prompt uses ' || used || ' tokens, exceeding budget of 400 by ' || used - 400 WHEN used > 320 THEN 'System prompt uses ' || used || ' tokens (' || printf('%.0f', used * 100.0 / 400) || '% of 400 budget)' END AS message FROM t")
def budget_check(spark, d):
    x = curation.check_budget(tx.token_count(F.col("text")), 400)
    return texts(spark, d).select("doc_id", x.alias("x")).select("doc_id", "x.status", "x.message")


@query("truncate_budget", rf"""
WITH b AS (SELECT doc_id, text, greatest(len({WORDS}), 1) AS total, regexp_extract_all(text, '[^.\n]*[.\n]|[^.\n]+$') AS s FROM documents),
e AS (SELECT doc_id, unnest(s) AS text, generate_subscripts(s, 1) AS i FROM b),
c AS (SELECT doc_id, i, text, sum(greatest(len({WORDS}), 1)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum FROM e),
k AS (SELECT doc_id, string_agg(text, '' ORDER BY i) AS kept, max(cum) AS used FROM c WHERE cum <= 100 GROUP BY 1)
SELECT b.doc_id, CASE WHEN total <= 100 THEN b.text ELSE coalesce(kept, '') END AS kept, CASE WHEN total <= 100 THEN 0 ELSE greatest(total - coalesce(used, 0), 0) END::BIGINT AS dropped FROM b LEFT JOIN k USING (doc_id)
""")  # fmt: skip
def truncate_budget(spark, d):
    return texts(spark, d).select("doc_id", curation.truncate_to_budget(F.col("text"), 100).alias("x")).select("doc_id", "x.kept", "x.dropped")


@query("tool_compression", rf"""
WITH b AS (SELECT doc_id, text, greatest(len({WORDS}), 1) AS tokens, regexp_split_to_array(regexp_replace(text, '\r?\n$', ''), '\r?\n') AS l FROM documents),
s AS (SELECT doc_id, CASE WHEN tokens > 300 THEN '[tool: ' || 'grep' || '] ' || len(l) || ' lines of output. Preview:' || chr(10) || array_to_string(l[1:3], chr(10)) || CASE WHEN len(l) > 5 THEN chr(10) || '  ... (' || len(l) - 5 || ' lines omitted) ...' || chr(10) || array_to_string(l[-2:], chr(10)) || chr(10) || 'Full results available via recall.' ELSE '' END END AS text FROM b)
SELECT doc_id, text AS summary, greatest(len({WORDS}), 1)::BIGINT AS summary_tokens FROM s WHERE text IS NOT NULL
""")  # fmt: skip
def tool_compression(spark, d):
    x = curation.compress_tool_output(F.lit("grep"), F.col("text"), tx.token_count(F.col("text")), 300)
    return texts(spark, d).select("doc_id", x.alias("x")).where("x IS NOT NULL").select("doc_id", "x.summary", "x.summary_tokens")
