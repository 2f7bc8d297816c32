"""Pieces of DuckDB text that several queries' SQL share."""

from __future__ import annotations


def tokens_sql(name: str, source: str, ident: str, text: str) -> str:
    """A table of index terms (id, term) with repeats."""
    broken = "r"
    for pattern in (r"(\P{Lu})(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{L})([0-9])", r"([0-9])(\p{L})"):
        broken = f"regexp_replace({broken}, '{pattern}', '\\1 \\2', 'g')"
    return f"""{name}_runs AS (SELECT {ident} AS id, unnest(regexp_extract_all(coalesce({text}, ''), '[\\p{{L}}\\p{{N}}]+')) AS r FROM {source}),
{name}_parts AS (SELECT id, r, string_split({broken}, ' ') AS s FROM {name}_runs),
{name} AS (SELECT id, term FROM (SELECT id, lower(r) AS term FROM {name}_parts UNION ALL SELECT id, lower(unnest(s)) FROM {name}_parts WHERE len(s) > 1) WHERE strlen(term) > 1)"""


TOKENS = "WITH " + tokens_sql("tok", "documents", "doc_id", "text")
BM25 = TOKENS + ", " + tokens_sql("qt", "benchmark", "item_id", "text") + """,
asked AS (SELECT id AS query_id, term, count(*) AS times FROM qt GROUP BY 1, 2),
dls AS (SELECT id, count(*) AS dl FROM tok GROUP BY 1),
cs AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dls)::DOUBLE / (SELECT count(*) FROM documents) AS avg_dl),
post AS (SELECT term, id, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
bm AS (SELECT query_id, id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl))), 6) AS score
       FROM asked JOIN post USING (term) JOIN dfs USING (term) JOIN dls USING (id), cs GROUP BY 1, 2)
"""


def ranked_sql(source: str, k: int) -> str:
    return f" SELECT query_id, id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM {source}) WHERE rank <= {k}"


def _normal(name: str) -> str:
    return f"SELECT query_id, id, (score - min(score) OVER w) / greatest(greatest(max(score) OVER w, 0) - min(score) OVER w, 1.1920929e-7) AS norm FROM {name} WINDOW w AS (PARTITION BY query_id)"


HYBRID = BM25 + f""",
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
cos AS (SELECT q.id AS query_id, c.id, round(list_inner_product(q.e, c.e) / (q.n * c.n), 6) AS score FROM v q JOIN benchmark ON item_id = q.id, v c),
ha AS ({ranked_sql('cos', 30)}), hb AS ({ranked_sql('bm', 30)}),
na AS ({_normal('ha')}), nb AS ({_normal('hb')}),
j AS (SELECT query_id, id, na.norm AS a, nb.norm AS b FROM na FULL OUTER JOIN nb USING (query_id, id))
"""
EDGES = "WITH e AS (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, l_returnflag AS relation, max(round(1 - l_discount, 6)) AS weight FROM lineitem GROUP BY 1, 2, 3)"
SEEDS = ", sd AS (SELECT o_custkey AS query_id, 'o' || o_orderkey AS id, round(o_totalprice / 1e6, 6) AS score FROM orders), seeds AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM sd) WHERE rank <= 5)"
