"""Retrieval queries: documents answer the benchmark texts, orders and parts form the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EXPAND_CAP
from ..functions.text import index_tokens
from ..operators import cells, evaluation, fusion, graph, knn, lexical
from ..registry import SQL, query, table, texts
from ..storage import new_path
from .sql import BM25, EDGES, HYBRID, SEEDS, TOKENS, ranked_sql

K = 10


def questions(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def index(spark, d) -> lexical.Index:
    return lexical.index_of(spark, f"{d}/documents.parquet")


def bm25_hits(spark, d, k) -> DataFrame:
    return lexical.bm25_topk(index(spark, d), questions(spark, d), k)


def cosine_hits(spark, d, k) -> DataFrame:
    """Each benchmark item asks with the vector of its own number."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), knn.normalized(F.col("embedding")).alias("vector"))
    asked = vectors.join(table(spark, d, "benchmark").select(F.col("item_id").alias("id")), "id", "left_semi").toDF("query_id", "vector")
    return knn.cosine_topk(asked, vectors, k)


@query("bm25_topk", BM25 + ranked_sql("bm", K))
def bm25_topk(spark, d):
    return bm25_hits(spark, d, K)


@query("posting_stats", TOKENS + ", p AS (SELECT term, id, count(*) AS tf FROM tok GROUP BY term, id) SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf, max(tf)::BIGINT AS most FROM p GROUP BY term")
def posting_stats(spark, d):
    return index(spark, d).terms


@query("corpus_stats", TOKENS + ", l AS (SELECT id, count(*) AS dl FROM tok GROUP BY id) SELECT count(*)::BIGINT AS n, round(sum(coalesce(dl, 0)) / count(*), 6) AS avg_dl FROM documents LEFT JOIN l ON l.id = doc_id")
def corpus_stats(spark, d):
    held = index(spark, d)
    return spark.range(1).select(F.lit(held.n).cast("long").alias("n"), F.round(F.lit(held.avg_dl), 6).alias("avg_dl"))


@query("index_tokens", TOKENS + ", c AS (SELECT id, count(*)::BIGINT AS n, count(DISTINCT term)::BIGINT AS n_distinct, min(term) AS first_term, max(term) AS last_term FROM tok GROUP BY id) SELECT * FROM c")
def tokens(spark, d):
    rows = texts(spark, d).select(F.col("doc_id").alias("id"), index_tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return rows.select("id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_min("t").alias("first_term"), F.array_max("t").alias("last_term"))


@query("knn_cosine", """
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
h AS (SELECT q.id AS query_id, c.id, round(list_inner_product(q.e, c.e) / (q.n * c.n), 6) AS score FROM v q JOIN v c ON q.id % 50 = 0)
""" + ranked_sql("h", K))  # fmt: skip
def knn_cosine(spark, d):
    """Every vector whose number 50 divides asks all vectors."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), knn.normalized(F.col("embedding")).alias("vector"))
    return knn.cosine_topk(vectors.where("id % 50 = 0").withColumnRenamed("id", "query_id"), vectors, K)


def _cells(spark, d) -> cells.Cells:
    path = new_path(spark, "cells")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), knn.normalized(F.col("embedding")).alias("vector"))
    cells.build_cells(vectors, path)
    return cells.open_cells(spark, path, vectors.where("vector IS NOT NULL").count())


@query("knn_approx")
def knn_approx(spark, d):
    """As knn_cosine, by the nearest cells of a saved index; the tests hold its recall."""
    index = _cells(spark, d)
    return cells.cells_topk(index, index.vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), K)


@query("knn_all_cells", SQL["knn_cosine"])
def knn_all_cells(spark, d):
    """By all cells: what the exact search gives."""
    index = _cells(spark, d)
    return cells.cells_topk(index, index.vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), K, probes=len(index.centroids))


def _lists(spark, d):
    return cosine_hits(spark, d, 3 * K), bm25_hits(spark, d, 3 * K)


@query("hybrid_fusion", HYBRID + ", f AS (SELECT query_id, id, round((coalesce(a, 0) * 0.6 + coalesce(b, 0) * 0.4) / 1.0, 6) AS score FROM j)" + ranked_sql("f", K))
def hybrid_fusion(spark, d):
    return fusion.hybrid(*_lists(spark, d), K)


@query("present_weight_fusion", HYBRID + ", f AS (SELECT query_id, id, round((coalesce(a, 0) * 0.6 + coalesce(b, 0) * 0.4) / (CASE WHEN a IS NULL THEN 0 ELSE 0.6 END + CASE WHEN b IS NULL THEN 0 ELSE 0.4 END), 6) AS score FROM j)" + ranked_sql("f", K))
def present_weight_fusion(spark, d):
    return fusion.present_weight(*_lists(spark, d), K)


@query("rrf_fusion", HYBRID + ", u AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS p FROM ha UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank) FROM hb), f AS (SELECT query_id, id, round(sum(p), 9) AS score FROM u GROUP BY 1, 2)" + ranked_sql("f", K))
def rrf_fusion(spark, d):
    a, b = _lists(spark, d)
    return fusion.reciprocal_rank([(a, 1.0), (b, 1.0)], K)


def _sourced(spark, d, k=K):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars")
    return bm25_hits(spark, d, k).join(docs, "id")


@query("coverage_first", BM25 + """, h AS (SELECT * FROM (""" + ranked_sql("bm", K) + """)), s AS (SELECT h.*, source, n_chars, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) > 1 AS again FROM h JOIN documents ON doc_id = id)
SELECT query_id, id, source, score, rank, (row_number() OVER (PARTITION BY query_id ORDER BY again, rank))::INT AS "order" FROM s""")
def coverage_first(spark, d):
    return fusion.coverage_first(_sourced(spark, d)).select("query_id", "id", "source", "score", "rank", "order")


NORMAL = BM25 + ", h AS (SELECT * FROM (" + ranked_sql("bm", 3 * K) + ")), n AS (SELECT h.query_id, h.id, h.rank, source AS path, n_chars, (score - min(score) OVER w) / greatest(greatest(max(score) OVER w, 0) - min(score) OVER w, 1.1920929e-7) AS s FROM h JOIN documents ON doc_id = id WINDOW w AS (PARTITION BY query_id)), m AS (SELECT query_id, id, rank, path, n_chars, round(s, 6) AS score FROM n)"


def _normal(spark, d):
    hits = fusion.min_max(_sourced(spark, d, 3 * K)).withColumn("score", F.round("norm", 6))
    return hits.select("query_id", "id", "rank", F.col("source").alias("path"), "n_chars", "score")


@query("ambiguity_gate", NORMAL + " SELECT query_id, count(*) FILTER (score >= 0.7)::BIGINT AS above_load, count(DISTINCT path) FILTER (score >= 0.55)::BIGINT AS paths_above_unload, count(*) FILTER (score >= 0.7) > 4 OR count(DISTINCT path) FILTER (score >= 0.55) > 4 AS list_instead, CASE WHEN count(*) FILTER (score >= 0.7) > 4 THEN 0.7 ELSE 0.55 END::DOUBLE AS list_threshold FROM m GROUP BY query_id")
def ambiguity_gate(spark, d):
    return fusion.ambiguous(_normal(spark, d), load=0.7, unload=0.55)


@query("candidate_list", NORMAL + ", b AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY rank) AS nth FROM m WHERE score >= 0.3) SELECT query_id, '__candidates__' AS stub_id, '" + fusion.CANDIDATE_LEAD.replace("'", "''") + "' || string_agg('- ' || path || ' — ' || n_chars || ' characters', chr(10) ORDER BY rank) AS content FROM b WHERE nth = 1 GROUP BY query_id")
def candidate_list(spark, d):
    hits = _normal(spark, d).withColumn("summary", F.concat(F.col("n_chars").cast("string"), F.lit(" characters")))
    return fusion.candidate_list(hits, 0.3)


@query("score_rewrite", NORMAL + """, k AS (SELECT m.*, CASE WHEN n_chars % 2 = 0 THEN 'Code' ELSE 'Markdown' END AS kind, CASE WHEN path IN ('src0', 'src1') THEN path || '.md' ELSE path END AS p, query_id % 2 = 0 AS ex, contains(lower(text), 'bench') AS about FROM m JOIN benchmark ON item_id = query_id),
a AS (SELECT *, CASE WHEN ex AND p LIKE '%.md' THEN least(score * 1.5, 1.0) ELSE score END AS s1 FROM k),
b AS (SELECT *, sum((kind = 'Code')::INT) OVER (PARTITION BY query_id ORDER BY s1 DESC, id ROWS UNBOUNDED PRECEDING) AS nth FROM a),
c AS (SELECT query_id, id, p AS path, CASE WHEN ex AND kind = 'Code' AND nth > 5 THEN 0.0 ELSE s1 END * CASE WHEN NOT about AND contains(p, 'src2') THEN 0.25 ELSE 1 END AS s2 FROM b)
SELECT query_id, id, path, round(s2, 9) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, id))::INT AS rank FROM c""")
def score_rewrite(spark, d):
    """Even queries ask for an explanation; two sources stand for documentation, src2 and the like for benchmark files."""
    hits = _normal(spark, d).join(questions(spark, d), "query_id").withColumn("kind", F.when(F.col("n_chars") % 2 == 0, "Code").otherwise("Markdown"))
    hits = hits.withColumn("path", F.when(F.col("path").isin("src0", "src1"), F.concat("path", F.lit(".md"))).otherwise(F.col("path")))
    out = fusion.rewrite_scores(hits, explanation=F.col("query_id") % 2 == 0, query=F.col("text"), penal_path="src2", penal_terms=("bench",))
    return out.select("query_id", "id", "path", F.round("score", 9).alias("score"), "rank")


@query("keyword_overlap", """
WITH q AS (SELECT DISTINCT lower(p_name) AS query_id FROM part),
s AS (SELECT query_id, p_partkey AS id, p_name, p_type, p_brand FROM q, part),
c AS (SELECT query_id, id, (CASE WHEN contains(lower(p_name), query_id) THEN 0.8 ELSE 0 END + CASE WHEN contains(lower(p_type), query_id) THEN 0.6 ELSE 0 END + CASE WHEN contains(lower(p_brand), query_id) THEN 0.4 ELSE 0 END)::DOUBLE AS direct,
  list_filter(regexp_split_to_array(query_id, '\\s+'), lambda t: t <> '') AS t, lower(p_name || ' ' || p_type || ' ' || p_brand) AS e FROM s),
h AS (SELECT query_id, id, round(CASE WHEN direct > 0 THEN direct ELSE len(list_filter(t, lambda x: contains(e, x))) / len(t) END, 6) AS score FROM c)
""" + ranked_sql("h", K))  # fmt: skip
def keyword_overlap(spark, d):
    """Every distinct part name asks all parts: name as path, type as summary, brand as outline."""
    part = table(spark, d, "part")
    asked = part.select(F.lower("p_name").alias("query_id")).distinct().withColumn("query", F.col("query_id"))
    return lexical.keyword_topk(asked, part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("path"), F.col("p_type").alias("summary"), F.array("p_brand").alias("outline")), K)


def _edges(spark, d):
    li = table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.col("l_returnflag").alias("relation"), F.lit("high").alias("confidence"), F.round(1 - F.col("l_discount"), 6).alias("weight"))
    return graph.build_edges(li)[0]


def _seeds(spark, d):
    """Each customer's five dearest orders."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.round(F.col("o_totalprice") / 1e6, 6).alias("score"))
    return knn.ranked(orders, 5)


RELATIONS = ["A", "R"]
NEAR = EDGES + SEEDS + ", k AS (SELECT * FROM e WHERE relation IN ('A', 'R')), g AS (SELECT query_id, id AS seed, dst AS neighbour, relation, weight, score AS seed_score, rank AS seed_rank FROM seeds JOIN k ON id = src UNION ALL SELECT query_id, id, src, relation, weight, score, rank FROM seeds JOIN k ON id = dst)"
PLAN = NEAR + f", x AS (SELECT g.query_id, neighbour AS id, round(seed_score * 0.5 * weight, 9) AS score, seed, seed_rank, relation FROM g ANTI JOIN seeds ON seeds.query_id = g.query_id AND seeds.id = g.neighbour), y AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, seed_rank, relation) AS nth FROM x), plan AS (SELECT * EXCLUDE (nth) FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS \"order\" FROM y WHERE nth = 1) WHERE \"order\" <= {EXPAND_CAP})"


@query("graph_edges", EDGES + " SELECT src, dst, relation, weight FROM e")
def graph_edges(spark, d):
    return _edges(spark, d)


@query("graph_neighbors", NEAR + " SELECT query_id, seed, neighbour, relation, weight, seed_score, seed_rank FROM g")
def graph_neighbors(spark, d):
    return graph.neighbours(_seeds(spark, d), _edges(spark, d), RELATIONS)


@query("graph_expand", PLAN + " SELECT query_id, id, score, seed, seed_rank, relation, \"order\" FROM plan")
def graph_expand(spark, d):
    return graph.expansion_plan(_seeds(spark, d), _edges(spark, d), RELATIONS, digits=9)


@query("merge_adjacent", PLAN + ", u AS (SELECT query_id, id, score, rank AS place, 0 AS near FROM seeds UNION ALL SELECT query_id, id, score, seed_rank, 1 FROM plan), v AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY place, near, score DESC) AS nth FROM u) SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY place, near, score DESC, id))::INT AS rank FROM v WHERE nth = 1")
def merge_adjacent(spark, d):
    seeds = _seeds(spark, d)
    return graph.merge_adjacent(seeds, graph.expansion_plan(seeds, _edges(spark, d), RELATIONS, digits=9))


@query("merge_discounted", PLAN + ", u AS (SELECT query_id, id, score FROM seeds UNION ALL SELECT query_id, id, score FROM plan) SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM u")
def merge_discounted(spark, d):
    seeds = _seeds(spark, d)
    return graph.merge_discounted(seeds, graph.expansion_plan(seeds, _edges(spark, d), RELATIONS, digits=9))


@query("chunk_cover_asof", """
WITH c AS (SELECT l_orderkey AS path, l_linenumber AS id, (l_linenumber - 1) * 10::BIGINT AS off, l_quantity::BIGINT % 10 + 1 AS len FROM lineitem),
p AS (SELECT o_orderkey AS path, o_custkey AS place_id, (o_custkey % 80)::BIGINT AS "at" FROM orders),
j AS (SELECT p.*, c.id, c.off, "at" < off + len AS inside FROM p JOIN c ON p.path = c.path AND off <= "at"),
k AS (SELECT path, place_id, "at", coalesce(min({'off': off, 'id': id}) FILTER (inside), max({'off': off, 'id': id})).id AS id FROM j GROUP BY 1, 2, 3)
SELECT p.path, p.place_id, p."at", k.id FROM (SELECT DISTINCT * FROM p) p LEFT JOIN k USING (path, place_id, "at")
""")  # fmt: skip
def chunk_cover_asof(spark, d):
    """Line items are chunks of their order, each ten bytes after the other with gaps; a byte of every order asks."""
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("id"), ((F.col("l_linenumber") - 1) * 10).cast("long").alias("off"), (F.col("l_quantity").cast("long") % 10 + 1).alias("len"))
    places = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("place_id"), (F.col("o_custkey") % 80).cast("long").alias("at"))
    return graph.covering_chunk(places, chunks)


GOLD = BM25 + ", h AS (SELECT * FROM (" + ranked_sql("bm", 50) + ")), gold AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _gold(spark, d):
    """Documents that hold a benchmark text as it stands."""
    docs, items = texts(spark, d).select(F.col("doc_id").alias("id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"))
    return lexical.holding(docs, items)


@query("recall_precision", GOLD + """, f AS (SELECT h.query_id, count(*) AS n, count(gold.id) AS hits FROM h LEFT JOIN gold USING (query_id, id) WHERE rank <= 10 GROUP BY 1), w AS (SELECT query_id, count(DISTINCT id) AS want FROM gold GROUP BY 1), e AS (SELECT query_id FROM h UNION SELECT query_id FROM gold)
SELECT query_id, coalesce(hits, 0)::BIGINT AS hits, CASE WHEN coalesce(want, 0) > 0 THEN coalesce(hits, 0) / want ELSE 1.0 END AS recall, CASE WHEN coalesce(n, 0) > 0 THEN hits / n ELSE 1.0 END AS precision FROM e LEFT JOIN f USING (query_id) LEFT JOIN w USING (query_id)""")
def recall_precision(spark, d):
    return evaluation.recall_precision(bm25_hits(spark, d, 50), _gold(spark, d), 10)


@query("first_gold_rank", GOLD + ", f AS (SELECT query_id, min(rank)::BIGINT AS gold_rank FROM h JOIN gold USING (query_id, id) GROUP BY 1) SELECT item_id AS query_id, gold_rank FROM benchmark LEFT JOIN f ON query_id = item_id")
def first_gold_rank(spark, d):
    return evaluation.first_gold(bm25_hits(spark, d, 50), _gold(spark, d), questions(spark, d))
