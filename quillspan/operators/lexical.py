"""Postings, BM25 and keyword overlap."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BM25_B, BM25_K1
from ..functions.text import index_tokens, run_terms
from ..storage import exists, fingerprint, moved, new_path, shared_dir, stored
from .knn import ranked

#: Changes when an index holds something else than before.
LAYOUT = 1


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """term, id, tf.

    Texts are dealt by id first, in the one shuffle there is: their words, which take more room, are
    exploded and counted where they lie, and a term that every document has is spread over all tasks.
    Runs are exploded before they are brought to terms, so all of it is generated code.
    Null texts have no terms; rows that share an id count together.
    """
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias(text)).repartition("id")
    runs = docs.select("id", F.explode(F.split(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}\p{N}]+")).alias("run")).where("run != ''")
    terms = runs.select("id", F.explode(run_terms(F.col("run"))).alias("term")).where(F.octet_length("term") > 1)
    return terms.groupBy("term", "id").agg(F.count("*").alias("tf"))


class Index(NamedTuple):
    """A stored inverted index: postings (term, id, tf), terms (term, df, cf, most), lengths (id, dl), and two numbers."""

    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    n: int
    avg_dl: float


def build_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the index of ``docs`` under ``path``: the texts are read once, searches read the index alone.

    Files of postings are sorted by term, so that their statistics tell which row groups hold it.
    """
    spark = docs.sparkSession
    postings(docs, doc_id, text).sortWithinPartitions("term", "id").write.parquet(f"{path}/postings")
    held = spark.read.parquet(f"{path}/postings")
    held.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("most")).write.parquet(f"{path}/terms")
    held.groupBy("id").agg(F.sum("tf").alias("dl")).write.parquet(f"{path}/lengths")
    total = spark.read.parquet(f"{path}/lengths").agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("words"))
    total.select(F.lit(docs.count()).cast("long").alias("n"), "words").write.parquet(f"{path}/stats")


def open_index(spark: SparkSession, path: str) -> Index:
    n, words_ = spark.read.parquet(f"{path}/stats").first()
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "lengths")), n, words_ / n if n else 0.0)


def index_of(spark: SparkSession, table: str, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of a Parquet table, built in the shared folder the first time it is asked for.

    It is found again by the names, sizes and times of the table's files, in later sessions too; a table
    that was written anew gets a new one.  It appears by one rename, so a lost driver leaves no half.
    """
    path = f"{shared_dir(spark)}/lexical/{LAYOUT}-{doc_id}-{text}-{fingerprint(spark, table)}"
    if not exists(spark, path):
        made = new_path(spark, "lexical-new")
        build_index(spark.read.parquet(table), made, doc_id, text)
        moved(spark, made, path)
    return open_index(spark, path)


def bm25_topk(index: Index, queries: DataFrame, k: int | None, *, k1: float = BM25_K1, b: float = BM25_B, digits: int = 6) -> DataFrame:
    """query_id, id, score, rank of ``queries`` (query_id, text); a term that a query repeats counts again.

    The queries' terms meet the dictionary first; what is left of them is written, so that the planner
    knows its size and broadcasts it if that allows it.  Only postings of these terms are shuffled, by id,
    before they meet the queries: a document's scores are summed where its postings lie.
    """
    asked = queries.select("query_id", F.explode(index_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    idf = F.log((F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = stored(asked.join(index.terms.select("term", "df"), "term").select("query_id", "term", (F.col("times") * idf).alias("w")).coalesce(1), "weights")
    asked_for = index.postings.join(weights.select("term").distinct(), "term", "left_semi").repartition("id")
    met = asked_for.join(index.lengths, "id").join(weights, "term")
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(index.avg_dl)))
    return ranked(met.groupBy("query_id", "id").agg(F.round(F.sum(part), digits).alias("score")), k)


def keyword_direct(q: Column, path: Column, summary: Column, outline: Column) -> Column:
    """What holds the whole query (in lower case): 0.8 for the path, 0.6 for the summary, 0.4 for an outline entry."""
    has = lambda c: F.contains(F.lower(c), q)
    return F.when(has(path), 0.8).otherwise(0.0) + F.when(has(summary), 0.6).otherwise(0.0) + F.when(F.exists(outline, has), 0.4).otherwise(0.0)


def keyword_score(query: Column, path: Column, summary: Column, outline: Column) -> Column:
    """0.8 for the path, 0.6 for the summary, 0.4 for an outline entry that holds the whole query, in lower case;
    if that is nothing, the share of the query's words that path, summary and outline hold."""
    q = F.lower(query)
    direct = keyword_direct(q, path, summary, outline)
    everything = F.lower(F.concat_ws(" ", path, summary, F.array_join(outline, " ")))
    terms = F.filter(F.split(q, r"\s+"), lambda t: t != "")
    share = F.size(F.filter(terms, lambda t: F.contains(everything, t))) / F.size(terms)
    return F.when(direct > 0, direct).when(F.size(terms) > 0, share).otherwise(0.0)


def grams(text: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Distinct stretches of these lengths."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*map(of, sizes)))


def keyword_topk(queries: DataFrame, stubs: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """query_id, id, score, rank: the k best of all ``stubs`` (id, path, summary, outline) by :func:`keyword_score`.

    A query word scores where it is part of a token, so words meet the tokens' vocabulary by their
    first three characters, then the tokens' stubs; queries never meet all stubs.  A stub that holds
    a whole query holds its words too.  Queries (query_id, query) with fewer than k finds are filled up
    with the smallest ids, whose score is 0; a query without words gives nothing.
    """
    spaced = lambda c: F.filter(F.split(c, r"\s+"), lambda t: t != "")
    terms = queries.select("query_id", F.lower("query").alias("q")).withColumn("terms", spaced(F.col("q"))).where(F.size("terms") > 0)
    asked = terms.select("query_id", "q", F.size("terms").alias("size"), F.explode("terms").alias("word")).groupBy("query_id", "q", "size", "word").agg(F.count("*").alias("times"))
    everything = F.lower(F.concat_ws(" ", "path", "summary", F.array_join("outline", " ")))
    held = stubs.select("id", F.explode(F.array_distinct(spaced(everything))).alias("token"))
    vocabulary = held.select("token").distinct().select("token", F.explode(grams(F.col("token"))).alias("gram"))
    words = asked.select("word", F.substring("word", 1, 3).alias("gram")).distinct()
    pairs = vocabulary.join(words, "gram").where(F.contains("token", "word")).select("word", "token")
    found = held.join(pairs, "token").select("word", "id").distinct()
    matched = asked.join(found, "word").groupBy("query_id", "q", "size", "id").agg(F.sum("times").alias("matched"))
    direct = keyword_direct(F.col("q"), F.col("path"), F.col("summary"), F.col("outline"))
    scored = matched.join(stubs, "id").select("query_id", "id", F.round(F.when(direct > 0, direct).otherwise(F.col("matched") / F.col("size")), digits).alias("score"))
    best = ranked(scored, k)
    first = [r["id"] for r in stubs.select("id").orderBy("id").limit(2 * k).collect()]  # of 2k ids, k at least have no score
    few = terms.select("query_id").join(best.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k)
    filler = few.select("query_id", F.explode(F.lit(first).cast(f"array<{stubs.schema['id'].dataType.simpleString()}>")).alias("id"), F.lit(0.0).alias("score"))
    filler = filler.join(best.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return ranked(best.select("query_id", "id", "score").unionByName(filler), k)


def holding(docs: DataFrame, needles: DataFrame) -> DataFrame:
    """query_id, id of the ``docs`` (id, text) that hold a needle (query_id, needle) as it stands.

    What stands between a needle's first and last word is whole words of the text too.  Its three inner
    words in a row with the smallest hash are the key of an equi-join with the texts' words; a needle
    with fewer inner words is found by its first three characters.  ``contains`` decides on the pairs.
    Null and empty needles are in no text.  The pairs and their needles are written before they meet the
    texts, so that the planner knows their size: few of them come to the texts, which are not shuffled then.
    """
    asked = needles.where(F.length("needle") > 0).select("query_id", "needle", F.split("needle", " ").alias("w"))
    key = lambda a, b, c: F.xxhash64(a, b, c)
    inner = F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: key(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    long = asked.where(F.size("w") >= 5).select("query_id", F.array_min(inner).alias("key"))
    w = F.split(F.coalesce("text", F.lit("")), " ")
    thrice = docs.select("id", w.alias("w")).where(F.size("w") >= 3)
    thrice = thrice.select("id", F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"), F.slice("w", F.lit(3), F.size("w")).alias("c"))).alias("z"))
    pairs = thrice.select("id", key("z.a", "z.b", "z.c").alias("key")).join(long, "key").select("query_id", "id")
    short = asked.where(F.size("w") < 5)
    if not short.isEmpty():
        first = short.select("query_id", F.substring("needle", 1, 3).alias("gram"))
        pairs = pairs.union(docs.select("id", F.explode(grams(F.col("text"))).alias("gram")).join(first, "gram").select("query_id", "id"))
    told = docs.join(stored(pairs.distinct().join(needles.select("query_id", "needle"), "query_id"), "holding"), "id")
    return told.where(F.contains("text", "needle")).select("query_id", "id")
