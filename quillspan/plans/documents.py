"""Document queries: stubs, chunks, hashes, kinds, topics, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import protocol, ranges, text as tx
from ..operators import graph, ingest, lexical, provenance, stubs
from ..registry import query, table, texts
from ..sources import files, sampling

WS = r"[\t-\r \x{85}\p{Z}]+"
WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}'), lambda w: w <> '')"
TOPIC = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "], t))"
DOCS = "WITH d AS (SELECT source || '/' || doc_id || '.txt' AS path, text AS content, doc_id, source FROM documents)"
FIRST_LINE = "(list_filter(regexp_split_to_array(regexp_replace(content, '\\r?\\n$', ''), '\\r?\\n'), lambda x: regexp_replace(x, '" + WS + "', '', 'g') <> ''))[1]"


def corpus(spark, d):
    return files.as_documents(texts(spark, d))


@query("token_counts", f"WITH w AS (SELECT doc_id, text, {WORDS} AS w FROM documents) SELECT doc_id, greatest(len(w), 1)::BIGINT AS tokens, (strlen(text) // 3)::BIGINT AS cheap, strlen(text) // 3 <= 500 AS one_chunk, array_to_string(w[6:15], ' ') AS part FROM w")
def token_counts(spark, d):
    t = F.col("text")
    return texts(spark, d).select("doc_id", tx.token_count(t).alias("tokens"), tx.cheap_tokens(t).alias("cheap"), (tx.cheap_tokens(t) <= 500).alias("one_chunk"), tx.token_range(t, F.lit(5), F.lit(10)).alias("part"))


@query("content_hash_dups", "SELECT sha256(text) AS content_hash, min(doc_id) AS keep_id, count(*)::BIGINT AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    return ingest.first_by_hash(docs).where("n > 1")


@query("plain_summary", DOCS + f" SELECT path, CASE WHEN strlen({FIRST_LINE}) <= 200 THEN {FIRST_LINE} ELSE left({FIRST_LINE}, 197) || '...' END AS summary FROM d")
def plain_summary(spark, d):
    return corpus(spark, d).select("path", ingest.plain_summary(F.col("content")).alias("summary"))


@query("length_histogram", "WITH l AS (SELECT CASE WHEN n_chars <= 100 THEN 100 WHEN n_chars <= 1000 THEN 1000 WHEN n_chars <= 5000 THEN 5000 END::BIGINT AS bucket FROM documents) SELECT bucket, count(*)::BIGINT AS n FROM l GROUP BY 1")
def length_histogram(spark, d):
    return ingest.length_histogram(table(spark, d, "documents"), "n_chars", [100, 1000, 5000])


@query("stub_ingest")
def stub_ingest(spark, d):
    """Every document's stubs; chunking is a loop over cuts, so tests hold it against plain Python."""
    return ingest.stubs(corpus(spark, d)).drop("embed_text", "body")


@query("chunk_tiling", DOCS + " SELECT path, strlen(content)::BIGINT AS bytes, TRUE AS tiled, TRUE AS same FROM d")
def chunk_tiling(spark, d):
    """Whether the chunks' bodies tile their file and make it up again."""
    docs = corpus(spark, d)
    made = ingest.stubs(docs).join(docs.select("path", "content"), "path")
    body = ranges.body_slice(F.col("content"), F.col("byte_offset"), F.col("byte_length"))
    parts = made.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("byte_offset", "byte_length", body.alias("b")))).alias("p"), F.first("content").alias("content"), F.sum("byte_length").alias("bytes"))
    ends = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("at"), F.lit(True).alias("ok")), lambda s, x: F.struct((x["byte_offset"] + x["byte_length"]).alias("at"), (s["ok"] & (x["byte_offset"] == s["at"])).alias("ok")), lambda s: s["ok"])
    return parts.select("path", "bytes", ends.alias("tiled"), (F.array_join(F.col("p.b"), "") == F.col("content")).alias("same"))


@query("stub_signal", DOCS + f", s AS (SELECT path, strlen(content) // 3 AS t, CASE WHEN strlen({FIRST_LINE}) <= 200 THEN {FIRST_LINE} ELSE left({FIRST_LINE}, 197) || '...' END AS summary FROM d) SELECT path FROM s WHERE t >= 10 AND strlen(trim(summary)) >= 15")
def stub_signal(spark, d):
    docs = corpus(spark, d).select("path", tx.cheap_tokens(F.col("content")).alias("t"), ingest.plain_summary(F.col("content")).alias("summary"))
    return docs.where(files.has_signal(F.col("t"), F.col("summary"))).select("path")


@query("page_kinds", r"""
WITH p AS (SELECT page_id, regexp_replace(split_part(url, '?', 1), '^https?://', '') AS path FROM pages),
x AS (SELECT *, nullif(regexp_extract(path, '[^/]\.([^./]+)$', 1), '') AS ext, string_split(path, '/') AS parts FROM p)
SELECT page_id, path, CASE WHEN ext IN ('md','mdx','markdown') THEN 'Markdown' WHEN ext IN ('txt','log','cfg','conf','ini','env','toml','yaml','yml','json','xml') THEN 'PlainText' WHEN ext IN ('csv','tsv','parquet') THEN 'Tabular' WHEN ext IN ('srt','vtt') THEN 'Transcript'
  WHEN ext IN ('rs','py','js','ts','tsx','jsx','go','c','cpp','h','hpp','java','rb','ex','exs','zig','lua','sh','bash','zsh','cs','swift','kt','scala','r','R','pl','pm','php') THEN 'Code' ELSE 'Other' END AS kind,
  len(list_filter(parts, lambda c: c IN ('target','node_modules','__pycache__','dist','build','vendor','scripts','qa') OR starts_with(c, '.'))) > 0 OR coalesce(ext IN ('lock','png','jpg','jpeg','gif','ico','svg','zip','tar','gz','exe','so','o','a','db','class'), FALSE) AS skipped,
  CASE WHEN contains(lower(path), 'changelog') THEN 'changelog' WHEN contains(lower(path), 'copyright') THEN 'copyright' WHEN contains(lower(path), 'readme') THEN 'readme' WHEN contains(lower(path), 'news') THEN 'news' ELSE 'doc' END AS doc_type FROM x
""")  # fmt: skip
def page_kinds(spark, d):
    path = F.regexp_replace(F.substring_index("url", "?", 1), "^https?://", "")
    rows = table(spark, d, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", "path", files.content_kind(F.col("path")).alias("kind"), files.skipped(F.col("path")).alias("skipped"), tx.document_type(F.col("path")).alias("doc_type"))


@query("builder_counts", r"WITH p AS (SELECT regexp_replace(split_part(url, '?', 1), '^https?://', '') AS path FROM pages), x AS (SELECT *, nullif(regexp_extract(path, '[^/]\.([^./]+)$', 1), '') AS ext FROM p) SELECT CASE WHEN len(list_filter(string_split(path, '/'), lambda c: starts_with(c, '.') OR c IN ('scripts','target','node_modules'))) > 0 THEN 'skipped' WHEN ext IN ('zip','tar','gz','bz2','xz','7z','rar') THEN 'archive' ELSE 'indexed' END AS class, count(*)::BIGINT AS n FROM x GROUP BY 1")
def builder_counts(spark, d):
    return files.builder_counts(table(spark, d, "pages").select(F.regexp_replace(F.substring_index("url", "?", 1), "^https?://", "").alias("path")))


@query("incremental_skip", DOCS + " SELECT path, doc_id % 7 AS mtime FROM d WHERE doc_id % 7 <> doc_id % 5")
def incremental_skip(spark, d):
    """What was indexed at another time than now."""
    docs = corpus(spark, d)
    return files.new_only(docs.select("path", (F.col("doc_id") % 7).alias("mtime")), docs.select("path", (F.col("doc_id") % 5).alias("mtime")))


STUBS = "WITH s AS (SELECT 'o' || l_orderkey || '#' || l_linenumber AS id, 'o' || l_orderkey AS path, l_linenumber::BIGINT AS chunk_index, (l_orderkey % 4 + 2)::BIGINT AS chunk_total, l_linenumber % 5 = 0 AS stale, l_returnflag = 'R' AS ignored, (l_partkey % 3)::BIGINT AS mtime FROM lineitem)"


def _stubs(spark, d):
    """Line items as chunks of their orders."""
    path = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    return table(spark, d, "lineitem").select(
        F.concat(path, F.lit("#"), F.col("l_linenumber").cast("string")).alias("id"), path.alias("path"), F.col("l_linenumber").cast("long").alias("chunk_index"), (F.col("l_orderkey") % 4 + 2).cast("long").alias("chunk_total"),
        (F.col("l_linenumber") % 5 == 0).alias("stale"), (F.col("l_returnflag") == "R").alias("ignored"), (F.col("l_partkey") % 3).cast("long").alias("mtime"),
    )


@query("complete_files", STUBS + " SELECT path, mtime FROM s WHERE NOT stale GROUP BY 1, 2 HAVING count(*) >= max(chunk_total)")
def complete_files(spark, d):
    return stubs.complete_files(_stubs(spark, d))


@query("stale_paths", STUBS + " SELECT DISTINCT path FROM s WHERE stale")
def stale_paths(spark, d):
    return stubs.stale_paths(_stubs(spark, d))


@query("live_stubs", STUBS + " SELECT id, path FROM s WHERE NOT stale AND NOT ignored")
def live_stubs(spark, d):
    return stubs.live(_stubs(spark, d)).select("id", "path")


@query("detect_stale", STUBS + ", o AS (SELECT 'o' || o_orderkey AS path, (o_custkey % 3)::BIGINT AS now FROM orders WHERE o_orderstatus <> 'P') SELECT id, stale OR now IS NULL OR (mtime <> 0 AND mtime <> now) AS stale FROM s LEFT JOIN o USING (path)")
def detect_stale(spark, d):
    current = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_custkey") % 3).cast("long").alias("mtime"))
    return stubs.detect_stale(_stubs(spark, d), current).select("id", "stale")


@query("mark_stale", STUBS + " SELECT count(*) FILTER (mtime = 1 AND NOT stale)::BIGINT AS changed FROM s")
def mark_stale(spark, d):
    return stubs.mark_stale(_stubs(spark, d), F.col("mtime") == 1)[1]


@query("apply_ignores", STUBS + " SELECT count(*) FILTER (path LIKE 'o1%' AND NOT ignored)::BIGINT AS ignored, count(*) FILTER (path NOT LIKE 'o1%' AND ignored)::BIGINT AS cleared FROM s")
def apply_ignores(spark, d):
    return stubs.apply_ignores(_stubs(spark, d), ["o1*"])[1]


@query("replace_path", STUBS + ", n AS (SELECT * FROM s WHERE mtime = 1 AND chunk_index = 1) SELECT id, path, FALSE AS stale FROM n UNION ALL SELECT id, path, stale FROM s WHERE path NOT IN (SELECT path FROM n)")
def replace_path(spark, d):
    s = _stubs(spark, d)
    return stubs.replace_path(s, s.where("mtime = 1 AND chunk_index = 1")).select("id", "path", "stale")


@query("delete_cascade", STUBS + ", g AS (SELECT DISTINCT path FROM s WHERE mtime = 2) SELECT (SELECT count(*) FROM s WHERE path NOT IN (SELECT path FROM g))::BIGINT AS stubs, (SELECT count(*) FROM s WHERE path NOT IN (SELECT path FROM g) AND chunk_index <= 3)::BIGINT AS notes")
def delete_cascade(spark, d):
    s = _stubs(spark, d)
    left, notes = stubs.delete_paths(s.where("mtime = 2").select("path"), s, s.where("chunk_index <= 3").select(F.col("id").alias("stub_id")))
    return left.agg(F.count("*").alias("stubs")).join(notes.agg(F.count("*").alias("notes")))


@query("stub_upsert", STUBS + ", n AS (SELECT DISTINCT id FROM s WHERE mtime = 1) SELECT DISTINCT id, id IN (SELECT id FROM n) AS new FROM s")
def stub_upsert(spark, d):
    s = _stubs(spark, d).select("id", "mtime").dropDuplicates(["id"]).select("id", F.lit(False).alias("new"))
    fresh = _stubs(spark, d).where("mtime = 1").select("id", F.lit(True).alias("new"))
    return stubs.upsert(s, fresh)


TERMS = f"WITH t AS (SELECT doc_id AS id, unnest({TOPIC.format('text')}) AS term FROM documents), c AS (SELECT id, term, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT id, term, n::BIGINT AS n, (row_number() OVER (PARTITION BY id ORDER BY n DESC, term))::INT AS rank FROM c), top AS (SELECT * FROM r WHERE rank <= 20)"


@query("topic_terms", TERMS + " SELECT id, term, n, rank FROM top")
def topic_terms(spark, d):
    return provenance.topic_terms(texts(spark, d), ident="doc_id", text="text")


@query("topic_overlap", TERMS + """, y AS (SELECT id, source, list_sort(list(term)) AS s FROM top JOIN documents ON doc_id = id GROUP BY 1, 2),
z AS (SELECT min(id) AS id, source, s, len(s) AS n, count(*)::BIGINT AS copies FROM y GROUP BY source, s), e AS (SELECT id, source, unnest(s) AS term FROM z),
m AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM e a JOIN e b ON a.term = b.term AND a.id < b.id AND a.source <> b.source),
p AS (SELECT id_a, id_b, x.source AS source_a, w.source AS source_b, x.copies AS copies_a, w.copies AS copies_b, list_sort(list_intersect(x.s, w.s)) AS shared, least(x.n, w.n) AS k FROM m JOIN z x ON x.id = id_a JOIN z w ON w.id = id_b)
SELECT id_a, id_b, source_a, source_b, copies_a, copies_b, array_to_string(shared, ',') AS shared, round(len(shared) / k, 6) AS overlap FROM p WHERE round(len(shared) / k, 6) > 0.3""")
def topic_overlap(spark, d):
    docs = table(spark, d, "documents")
    # by id before the words are taken: the texts are shuffled once, their words never
    terms = provenance.topic_terms(docs.select("doc_id", "text").repartition("doc_id"), ident="doc_id", text="text").select("id", "term")
    return provenance.topic_overlaps(terms, docs.select(F.col("doc_id").alias("id"), "source"), joint=",")


@query("weighted_sample", "WITH d AS (SELECT source || '/' || doc_id || '.txt' AS path, doc_id % 3 + 1 AS w FROM documents), k AS (SELECT path, -ln((('0x' || substr(md5('s1' || path), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / w AS k FROM d) SELECT path FROM k ORDER BY k, path LIMIT 50")
def weighted_sample(spark, d):
    """Fifty files, chances by weight (a sampling operator: the limit is the feature)."""
    return sampling.weighted_sample(corpus(spark, d), 50, "s1", weight=F.col("doc_id") % 3 + 1).select("path")


@query("curated_haystack", "WITH d AS (SELECT source || '/' || doc_id || '.txt' AS path, doc_id FROM documents), g AS (SELECT path FROM d WHERE doc_id IN (SELECT item_id FROM benchmark)), k AS (SELECT path, -ln((('0x' || substr(md5('h1' || path), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS k FROM d WHERE path NOT IN (SELECT path FROM g)) SELECT path FROM g UNION ALL SELECT path FROM (SELECT path FROM k ORDER BY k, path LIMIT 80)")
def curated_haystack(spark, d):
    docs = corpus(spark, d)
    wanted = docs.join(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi").select("path")
    return sampling.curated(docs, wanted, 80, "h1").select("path")


@query("line_offsets", "SELECT doc_id, (strlen(text) - strlen(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines, CASE WHEN contains(text, chr(10)) THEN strlen(split_part(text, chr(10), 1)) + 1 ELSE 0 END::BIGINT AS second FROM documents")
def line_offsets(spark, d):
    t = F.col("text")
    return texts(spark, d).select("doc_id", graph.line_count(t).alias("n_lines"), graph.line_offset(t, F.lit(2)).alias("second"))


@query("line_starts", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1)::INT AS line FROM l) SELECT doc_id::VARCHAR AS path, line, coalesce(sum(strlen(x) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"at\" FROM u")
def line_starts(spark, d):
    return graph.line_starts(texts(spark, d).select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")))


@query("range_apply", "WITH l AS (SELECT doc_id, text, regexp_split_to_array(regexp_replace(text, '\\r?\\n$', ''), '\\r?\\n') AS l FROM documents) SELECT doc_id, array_to_string(l[2:3], chr(10)) AS lines, CASE WHEN len(l) >= 2 THEN l[2] ELSE '' END AS one, '2-3' AS locator FROM l")
def range_apply(spark, d):
    t = F.col("text")
    asked = ranges.parse_range(F.lit("L2-L3"))
    return texts(spark, d).select("doc_id", ranges.apply_range(t, asked).alias("lines"), ranges.apply_range(t, ranges.parse_range(F.lit("2"))).alias("one"), ranges.locator(asked).alias("locator"))


@query("quote_grounding", f"SELECT item_id, doc_id FROM benchmark b JOIN documents d ON length(trim(regexp_replace(lower(b.text), '{WS}', ' ', 'g'))) >= 10 AND contains(trim(regexp_replace(lower(d.text), '{WS}', ' ', 'g')), trim(regexp_replace(lower(b.text), '{WS}', ' ', 'g')))")
def quote_grounding(spark, d):
    """Documents that hold a benchmark text apart from case and white space."""
    docs = texts(spark, d).select(F.col("doc_id").alias("id"), tx.squeezed(F.col("text")).alias("text"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), tx.squeezed(F.col("text")).alias("needle")).where(F.length("needle") >= 10)
    return lexical.holding(docs, items).toDF("item_id", "doc_id")
