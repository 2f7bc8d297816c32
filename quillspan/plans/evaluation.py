"""Evaluation queries: orders and events stand for runs, labels for gold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import intent
from ..registry import query, table, texts

RESULTS = "WITH r AS (SELECT o_custkey AS item, CASE WHEN o_orderkey % 2 = 0 THEN 'recall_on' ELSE 'recall_off' END AS mode, o_totalprice AS price, (o_orderkey % 97)::DOUBLE AS score, o_orderstatus = 'P' AS degenerate, o_orderpriority AS type, o_orderkey AS k FROM orders)"


def _results(spark, d):
    c = F.col
    return table(spark, d, "orders").select(c("o_custkey").alias("item"), F.when(c("o_orderkey") % 2 == 0, "recall_on").otherwise("recall_off").alias("mode"), c("o_totalprice").alias("price"), (c("o_orderkey") % 97).cast("double").alias("score"), (c("o_orderstatus") == "P").alias("degenerate"), c("o_orderpriority").alias("type"), c("o_orderkey").alias("k"))


@query("mode_summary", RESULTS + " SELECT mode, count(*)::BIGINT AS items, count(*) FILTER (degenerate)::BIGINT AS degenerate, round(avg(score), 6) AS score FROM r GROUP BY 1")
def mode_summary(spark, d):
    return ev.mode_summary(_results(spark, d), ["score"])


@query("paired_delta", RESULTS + ", p AS (SELECT item, max(score) FILTER (mode = 'recall_on') - max(score) FILTER (mode = 'recall_off') AS x, max(price) FILTER (mode = 'recall_on') - max(price) FILTER (mode = 'recall_off') AS y FROM r GROUP BY 1), l AS (SELECT 'score' AS metric, x AS v FROM p UNION ALL SELECT 'price', y FROM p) SELECT metric, count(*)::BIGINT AS n, round(avg(v), 3) AS mean, round(coalesce(stddev_samp(v), 0), 3) AS sd, round(coalesce(stddev_samp(v), 0) / sqrt(count(*)), 3) AS se, count(*) FILTER (v > 0)::BIGINT AS wins, count(*) FILTER (v = 0)::BIGINT AS ties, count(*) FILTER (v < 0)::BIGINT AS losses FROM l WHERE v IS NOT NULL GROUP BY 1")
def paired_delta(spark, d):
    return ev.paired_deltas(_results(spark, d), ["score", "price"], "recall_on", "recall_off", digits=3)


_CUTS = ", ".join(f"round(avg(coalesce(({c} <= {k})::INT::DOUBLE, 0)), 6) AS {c}_recall_{k}" for k in (1, 3, 5, 10, 20, 50) for c in ("base", "expanded"))


@query("rank_report", RESULTS + f", x AS (SELECT k AS query_id, type, CASE WHEN k % 3 > 0 THEN k % 61 + 1 END AS base, CASE WHEN k % 5 > 0 THEN k % 53 + 1 END AS expanded FROM r) SELECT type, count(*)::BIGINT AS n, count(*) FILTER (coalesce(expanded, 2147483648) < coalesce(base, 2147483648))::BIGINT AS improved, count(*) FILTER (coalesce(expanded, 2147483648) > coalesce(base, 2147483648))::BIGINT AS regressed, round(avg(coalesce(1 / base, 0)), 6) AS base_mrr, round(avg(coalesce(1 / expanded, 0)), 6) AS expanded_mrr, {_CUTS} FROM x GROUP BY GROUPING SETS ((), (type))")
def rank_report(spark, d):
    k = F.col("k")
    ranks = _results(spark, d).select(k.alias("query_id"), "type", F.when(k % 3 > 0, k % 61 + 1).alias("base"), F.when(k % 5 > 0, k % 53 + 1).alias("expanded"))
    return ev.rank_report(ranks, "type")


@query("rescues", RESULTS + ", x AS (SELECT k AS query_id, k % 61 + 1 AS base, k % 53 + 1 AS expanded FROM r), a AS (SELECT o_orderkey AS query_id, o_orderstatus AS relation FROM orders WHERE o_orderstatus <> 'P') SELECT coalesce(relation, 'none') AS relation, count(DISTINCT query_id)::BIGINT AS n FROM x LEFT JOIN a USING (query_id) WHERE base > 10 AND expanded <= 10 GROUP BY 1")
def rescues(spark, d):
    k = F.col("k")
    ranks = _results(spark, d).select(k.alias("query_id"), (k % 61 + 1).alias("base"), (k % 53 + 1).alias("expanded"))
    edges = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderstatus").alias("relation"))
    return ev.rescues(ranks, edges)


SESSION = "WITH e AS (SELECT user_id AS session, (event_id % 20)::BIGINT AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, CASE event_type WHEN 'click' THEN 'load' WHEN 'view' THEN 'load' WHEN 'error' THEN 'evict' END AS kind FROM events), s AS (SELECT * FROM e WHERE kind IS NOT NULL)"
EVICTED = SESSION + ", v AS (SELECT x.session, x.id, x.step, x.step - (SELECT max(l.step) FROM s l WHERE l.kind = 'load' AND l.session = x.session AND l.id = x.id AND l.step <= x.step) AS held, EXISTS (SELECT 1 FROM s l WHERE l.kind = 'load' AND l.session = x.session AND l.id = x.id AND l.step > x.step AND l.step <= x.step + 5) AS thrashed FROM s x WHERE kind = 'evict')"


def _events(spark, d):
    from pyspark.sql import Window

    e, c = table(spark, d, "events"), F.col
    kind = F.when(c("event_type").isin("click", "view"), "load").when(c("event_type") == "error", "evict")
    out = e.select(c("user_id").alias("session"), (c("event_id") % 20).alias("id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("step"), kind.alias("kind"))
    return out.where("kind IS NOT NULL")


@query("thrash_analysis", EVICTED + " SELECT session, id, step, held, thrashed FROM v")
def thrash_analysis(spark, d):
    return ev.thrashing(_events(spark, d))[0]


@query("hysteresis_advice", EVICTED + " SELECT session, count(*)::BIGINT AS evictions, count(*) FILTER (thrashed)::BIGINT AS thrashed, round(avg(held), 6) AS avg_held, round(least(0.95, 0.7 + 0.05 * least(count(*) FILTER (thrashed), 4)), 6)::DOUBLE AS suggest_load, round(greatest(0.1, 0.55 - 0.05 * least(count(*) FILTER (thrashed), 4)), 6)::DOUBLE AS suggest_unload FROM v GROUP BY 1")
def hysteresis_advice(spark, d):
    out = ev.thrashing(_events(spark, d))[1]
    return out.select("session", "evictions", "thrashed", *(F.round(c, 6).alias(c) for c in ("avg_held", "suggest_load", "suggest_unload")))


@query("session_counters", "WITH e AS (SELECT user_id AS session, event_id AS seq, (event_id % 20)::BIGINT AS id, CASE event_type WHEN 'click' THEN 'recall' WHEN 'error' THEN 'evict' ELSE 'probe' END AS kind FROM events) SELECT session, count(*) FILTER (kind = 'recall')::BIGINT AS recalls, count(*) FILTER (kind = 'evict')::BIGINT AS evictions, count(*) FILTER (kind = 'probe')::BIGINT AS probes, coalesce(string_agg(id, ',' ORDER BY seq) FILTER (kind = 'recall'), '') AS recalled_ids, coalesce(string_agg(id, ',' ORDER BY seq) FILTER (kind = 'evict'), '') AS evicted_ids FROM e GROUP BY 1")
def session_counters(spark, d):
    c = F.col
    e = table(spark, d, "events").select(c("user_id").alias("session"), c("event_id").alias("seq"), (c("event_id") % 20).alias("id"), F.when(c("event_type") == "click", "recall").when(c("event_type") == "error", "evict").otherwise("probe").alias("kind"))
    out = ev.session_counters(e)
    return out.withColumn("recalled_ids", F.array_join("recalled_ids", ",")).withColumn("evicted_ids", F.array_join("evicted_ids", ","))


@query("cooperation_metrics", """
WITH e AS (SELECT conv_id AS session, turn AS seq, 'turn' AS kind, 1 AS id, text FROM conversations UNION ALL SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'recall' WHEN 1 THEN 'probe' ELSE 'annotation' END, 1, text FROM conversations)
SELECT session, count(*) FILTER (kind = 'probe') / count(*) FILTER (kind = 'turn') AS probes_per_turn, count(*) FILTER (kind = 'annotation') / count(*) FILTER (kind = 'turn') AS annotations_per_turn,
 CASE WHEN count(*) FILTER (kind = 'probe') > 0 THEN count(*) FILTER (kind = 'probe' AND strlen(text) % 2 = 0) / count(*) FILTER (kind = 'probe') ELSE 0 END AS useful_share FROM e GROUP BY 1""")  # fmt: skip
def cooperation_metrics(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.lit(1).alias("id"), (F.octet_length("text") % 2 == 0).alias("matched"), F.col("text").alias("summary"), F.col("text").alias("content"))
    kind = F.when(F.col("seq") % 3 == 0, "recall").when(F.col("seq") % 3 == 1, "probe").otherwise("annotation")
    return ev.cooperation(c.withColumn("kind", F.lit("turn")).unionByName(c.withColumn("kind", kind))).drop("annotation_quality")


GOLD = "WITH p AS (SELECT doc_id, lang, source, toxic = 1 AS actual, n_chars % 5 = 0 AS predicted, quality = 1 AS q, n_chars > 300 AS qp FROM labels JOIN documents USING (doc_id)), u AS (SELECT doc_id, lang, source, 'toxic' AS field, predicted, actual FROM p UNION ALL SELECT doc_id, lang, source, 'quality', qp, q FROM p)"
SCORES = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END, 6) AS f1, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy"
COUNTS = "count(*) FILTER (predicted AND actual)::BIGINT AS tp, count(*) FILTER (predicted AND NOT actual)::BIGINT AS fp, count(*) FILTER (NOT predicted AND NOT actual)::BIGINT AS tn, count(*) FILTER (NOT predicted AND actual)::BIGINT AS fn"


def _flags(spark, d):
    c = F.col
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    p = table(spark, d, "labels").join(docs, "doc_id")
    p = p.withColumn("predicted", F.struct((c("n_chars") % 5 == 0).alias("toxic"), (c("n_chars") > 300).alias("quality"))).withColumn("actual", F.struct((c("toxic") == 1).alias("toxic"), (c("quality") == 1).alias("quality")))
    return ev.unpivoted_flags(p, ["doc_id", "lang", "source"], ["toxic", "quality"], "predicted", "actual")


@query("confusion_fields", GOLD + f", k AS (SELECT field, lang, {COUNTS} FROM u GROUP BY 1, 2) SELECT *, {SCORES} FROM k")
def confusion_fields(spark, d):
    return ev.confusion(_flags(spark, d), ["field", "lang"])


@query("micro_metrics", GOLD + f", k AS (SELECT lang, {COUNTS} FROM u GROUP BY 1) SELECT *, {SCORES} FROM k")
def micro_metrics(spark, d):
    return ev.micro(ev.confusion(_flags(spark, d), ["field", "lang"]), ["lang"])


@query("confusion_f05", GOLD + f", k AS (SELECT source, lang, {COUNTS} FROM u GROUP BY 1, 2), s AS (SELECT *, {SCORES} FROM k), f AS (SELECT source AS model, CASE WHEN 0.25 * precision + recall > 0 THEN 1.25 * precision * recall / (0.25 * precision + recall) ELSE 0 END AS f FROM s) SELECT model, count(*)::BIGINT AS runs, round(avg(f), 6) AS quality FROM f GROUP BY 1 HAVING count(*) >= 2")
def confusion_f05(spark, d):
    """Sources stand for models, languages for their runs."""
    runs = ev.confusion(_flags(spark, d), ["source", "lang"]).select(F.col("source").alias("model"), "precision", "recall", F.lit(0.0).alias("score"), F.lit(0.0).alias("parse_failure"))
    return ev.model_selection(runs, 2).withColumn("quality", F.round("quality", 6))


@query("tag_rates", "WITH c AS (SELECT source AS model, unnest([lang, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END]) AS tag, doc_id % 3 = 0 AS exact FROM documents), r AS (SELECT model, tag, count(*)::BIGINT AS n, avg(exact::INT) AS exact_rate FROM c GROUP BY 1, 2) SELECT model, tag, n, round(exact_rate, 6) AS exact_rate, exact_rate = max(exact_rate) OVER (PARTITION BY tag) AS winner FROM r")
def tag_rates(spark, d):
    c = table(spark, d, "documents").select(F.col("source").alias("model"), F.array("lang", F.when(F.col("n_chars") > 1000, "long").otherwise("short")).alias("tags"), (F.col("doc_id") % 3 == 0).alias("exact"))
    return ev.tag_rates(c).withColumn("exact_rate", F.round("exact_rate", 6))


@query("model_ranking", "WITH m AS (SELECT s_name AS model, round(s_acctbal / 10000, 2) AS f1, (s_suppkey % 3)::BIGINT AS failures FROM supplier) SELECT model, f1, failures, (row_number() OVER (ORDER BY f1 DESC, failures, model))::INT AS rank FROM m")
def model_ranking(spark, d):
    m = table(spark, d, "supplier").select(F.col("s_name").alias("model"), ev.rounded(F.col("s_acctbal") / 10000, 2).alias("f1"), (F.col("s_suppkey") % 3).alias("failures"))
    return ev.model_ranking(m)


def _votes(spark, d):
    """Line items vote on their order, with near-miss keys and prose around the JSON."""
    bit = lambda c: F.when(c, "true").otherwise("false")
    q = F.col("l_quantity").cast("int")
    raw = F.concat(F.lit('Sure: {"is_explanation": '), bit(q % 2 == 0), F.lit(', "is_status_request": '), bit(q % 3 == 0), F.lit(', "needs_git_status": '), bit(q % 5 == 0), F.lit(', "note": "a } brace", "confidence": '), (F.col("l_discount") * 10 + 0.25).cast("string"), F.lit("} done"))
    return texts(spark, d, "lineitem").select(F.col("l_orderkey").alias("case"), "l_linenumber", "l_partkey", "l_suppkey", intent.parse_intent(raw).alias("intent"))


@query("intent_parse", "SELECT l_orderkey AS \"case\", l_linenumber, l_partkey, l_quantity::INT % 2 = 0 AS wants_explanation, l_quantity::INT % 3 = 0 AS is_status_request, round(least(1.0, l_discount * 10 + 0.25), 6)::DOUBLE AS confidence, CASE WHEN l_quantity::INT % 5 = 0 THEN 'needs_git_status' ELSE '' END AS hints, l_quantity::INT % 2 = 0 OR l_quantity::INT % 3 = 0 AS substantive, least(1.0, l_discount * 10 + 0.25) >= 0.5 AS actionable, 1 + (l_quantity::INT % 2 = 0)::INT + (l_quantity::INT % 3 = 0)::INT + (l_quantity::INT % 5 = 0)::INT AS lines FROM lineitem")
def intent_parse(spark, d):
    i = F.col("intent")
    return _votes(spark, d).select("case", "l_linenumber", "l_partkey", i["wants_explanation"].alias("wants_explanation"), i["is_status_request"].alias("is_status_request"), F.round(i["confidence"], 6).alias("confidence"), F.array_join(intent.signals(i)["extra_hints"], ",").alias("hints"), intent.substantive(i).alias("substantive"), intent.actionable(i, 0.5).alias("actionable"), F.size(intent.guidance(i)).alias("lines"))


@query("majority_vote", "SELECT l_orderkey AS \"case\", count(*)::BIGINT AS votes, count(*) FILTER (l_quantity::INT % 2 = 0) >= count(*) // 2 + 1 AS wants_explanation, count(*) FILTER (l_quantity::INT % 3 = 0) >= count(*) // 2 + 1 AS is_status_request, round(avg(least(1.0, l_discount * 10 + 0.25)), 6) AS confidence, CASE WHEN count(*) FILTER (l_quantity::INT % 5 = 0) >= count(*) // 2 + 1 THEN 'needs_git_status' ELSE '' END AS hints FROM lineitem GROUP BY 1")
def majority_vote(spark, d):
    out = intent.majority_vote(_votes(spark, d))
    return out.select("case", "votes", "wants_explanation", "is_status_request", F.round("confidence", 6).alias("confidence"), F.array_join("hints", ",").alias("hints"))


@query("parameter_grid", "WITH a AS (SELECT r_name AS v FROM region), b AS (SELECT n_nationkey::VARCHAR AS v FROM nation), p AS (SELECT '{\"k\":\"' || b.v || '\",\"mode\":\"' || a.v || '\"}' AS params FROM a, b) SELECT left(sha256(params), 16) AS cell, params FROM p")
def parameter_grid(spark, d):
    axes = [("mode", table(spark, d, "region").select(F.col("r_name").alias("value"))), ("k", table(spark, d, "nation").select(F.col("n_nationkey").alias("value")))]
    return ev.parameter_grid(axes).withColumn("params", F.to_json("params"))


@query("answer_scoring", "SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 0.0 WHEN contains(lower(text), lower(lang)) THEN 1.0 ELSE (doc_id % 4) / 4 END::DOUBLE AS score FROM documents")
def answer_scoring(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", ev.answer_score(F.col("text"), F.col("lang"), i % 4 / 4, i % 13 == 0).alias("score"))


@query("false_recall", "SELECT coalesce(avg((event_type = 'error' OR value < 5)::INT), 0) AS false_recall_rate FROM events")
def false_recall(spark, d):
    e = table(spark, d, "events").select((F.col("event_type") == "error").alias("flagged"), F.col("value").alias("overlap"))
    return ev.false_recall_rate(e, least=5.0)


@query("context_efficiency", "SELECT o_orderkey, round(o_totalprice / (o_totalprice + 200 + o_custkey + 15 * (o_orderkey % 7)), 6) AS share, round(o_totalprice / 500000, 12) AS efficiency FROM orders")
def context_efficiency(spark, d):
    c = F.col
    return table(spark, d, "orders").select("o_orderkey", F.round(ev.context_share(c("o_totalprice"), F.lit(200), c("o_custkey"), c("o_orderkey") % 7), 6).alias("share"), F.round(ev.context_efficiency(c("o_totalprice"), F.lit(500000)), 12).alias("efficiency"))


@query("phase_timing", "SELECT event_id, greatest(value - value / 2 - value / 4, 0) AS other FROM events")
def phase_timing(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", ev.phase_split(v, v / 2, v / 4)["other"].alias("other"))


@query("miss_diagnosis", "WITH m AS (SELECT o_orderkey AS query_id, CASE o_orderstatus WHEN 'P' THEN 'stale' ELSE 'resolved' END AS status, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 40 + 1 END AS c, CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 30 + 1 END AS b, o_orderkey % 3 AS overlap, o_orderkey % 20 AS summary_len FROM orders) SELECT query_id, CASE WHEN status = 'stale' THEN 'gold stub withheld: flagged stale=1' WHEN summary_len < 15 AND overlap = 0 THEN 'thin stub + register dead-end' WHEN coalesce(c <= 10, FALSE) AND coalesce(b <= 10, FALSE) THEN 'both halves found it — fusion drowned it' WHEN coalesce(b <= 10, FALSE) THEN 'BM25 found it — cosine + fusion buried it' WHEN coalesce(c <= 10, FALSE) THEN 'cosine found it — BM25 + fusion buried it' WHEN overlap = 0 THEN 'register dead-end (no shared tokens)' ELSE 'findable but buried (ranking/scoring)' END AS cause FROM m")
def miss_diagnosis(spark, d):
    c = F.col
    m = table(spark, d, "orders").select(c("o_orderkey").alias("query_id"), F.when(c("o_orderstatus") == "P", "stale").otherwise("resolved").alias("status"), F.when(c("o_custkey") % 3 > 0, c("o_custkey") % 40 + 1).alias("cosine_rank"), F.when(c("o_custkey") % 4 > 0, c("o_custkey") % 30 + 1).alias("bm25_rank"), (c("o_orderkey") % 3).alias("overlap"), (c("o_orderkey") % 20).alias("summary_len"))
    return m.select("query_id", ev.diagnose_misses(m).alias("cause"))


@query("cooperation_advice", "SELECT event_id, CASE WHEN value / 100 - 0.2 >= 0.03 AND event_id % 10 / 10 >= 0.5 THEN 'enable' WHEN value / 100 - 0.2 < -0.03 OR (event_id % 7 / 7 >= 0.4 AND event_id % 10 / 10 < 0.5) THEN 'disable' ELSE 'inconclusive' END AS advice FROM events")
def cooperation_advice(spark, d):
    c = F.col
    return table(spark, d, "events").select("event_id", ev.cooperation_advice(c("value") / 100 - 0.2, c("event_id") % 7 / 7, c("event_id") % 10 / 10).alias("advice"))


@query("whitening")
def whitening(spark, d):
    """Embeddings without their mean and first two components; the test holds it against numpy."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return ev.whitened(v, 2)
