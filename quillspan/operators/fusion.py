"""Fusion of ranked lists (query_id, id, score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BM25_WEIGHT, COSINE_WEIGHT, F32_EPSILON, RRF_K
from .knn import ranked


def min_max(hits: DataFrame, digits: int | None = None) -> DataFrame:
    """``hits`` with norm: (score - least) / range per query, the most counting as 0 at least."""
    w = Window.partitionBy("query_id")
    least = F.min("score").over(w)
    span = F.greatest(F.greatest(F.max("score").over(w), F.lit(0.0)) - least, F.lit(F32_EPSILON))
    return hits.withColumn("norm", (F.col("score") - least) / span)


def _joined(a: DataFrame, b: DataFrame) -> DataFrame:
    left = min_max(a).select("query_id", "id", F.col("norm").alias("a"))
    right = min_max(b).select("query_id", "id", F.col("norm").alias("b"))
    return left.join(right, ["query_id", "id"], "full_outer")


def hybrid(a: DataFrame, b: DataFrame, k: int, weights: tuple[float, float] = (COSINE_WEIGHT, BM25_WEIGHT), digits: int = 6) -> DataFrame:
    """Weighted sum over all weights, an item absent from a list having 0 there."""
    total = sum(weights)
    score = (F.coalesce("a", F.lit(0.0)) * weights[0] + F.coalesce("b", F.lit(0.0)) * weights[1]) / total
    return ranked(_joined(a, b).select("query_id", "id", F.round(score, digits).alias("score")), k)


def present_weight(a: DataFrame, b: DataFrame, k: int, weights: tuple[float, float] = (COSINE_WEIGHT, BM25_WEIGHT), digits: int = 6) -> DataFrame:
    """As :func:`hybrid`, over the weights of the lists that an item is in."""
    has = lambda c, w: F.when(F.col(c).isNotNull(), w).otherwise(0.0)
    score = (F.coalesce("a", F.lit(0.0)) * weights[0] + F.coalesce("b", F.lit(0.0)) * weights[1]) / (has("a", weights[0]) + has("b", weights[1]))
    return ranked(_joined(a, b).select("query_id", "id", F.round(score, digits).alias("score")), k)


def reciprocal_rank(lists: list[tuple[DataFrame, float]], k: int, constant: int = RRF_K, digits: int = 9) -> DataFrame:
    """Sum of weight / (constant + rank) over the lists."""
    parts = [hits.select("query_id", "id", (F.lit(w) / (F.lit(constant) + F.col("rank"))).alias("part")) for hits, w in lists]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return ranked(union.groupBy("query_id", "id").agg(F.round(F.sum("part"), digits).alias("score")), k)


def coverage_first(hits: DataFrame, source: str = "source") -> DataFrame:
    """``hits`` with order: each source's first by rank, then the rest by rank."""
    nth = F.row_number().over(Window.partitionBy("query_id", source).orderBy("rank"))
    later = hits.withColumn("again", (nth > 1).cast("int"))
    return later.withColumn("order", F.row_number().over(Window.partitionBy("query_id").orderBy("again", "rank"))).drop("again")


#: What an inventory question is searched with.  Fixed text.
INVENTORY = " files paths artifacts names list"


def inventory_query(text: Column) -> Column:
    return F.concat(text, F.lit(INVENTORY))


def rewrite_scores(hits: DataFrame, *, explanation: Column, query: Column, kind: str = "kind", path: str = "path", boost: float = 1.5, most_code: int = 5, penalty: float = 0.25, doc_suffix: str = ".md", penal_path: str = "bench", penal_terms: tuple[str, ...] = ("benchmark", "bench", "score", "niah", "workload", "precision", "recall@k")) -> DataFrame:
    """Scores for explanation queries (documents up, code after the fifth to 0) and for benchmark paths.

    The path and term lists are parameters.  Ranks are given anew after each rewrite.
    """
    is_doc = F.endswith(F.col(path), F.lit(doc_suffix))
    out = hits.withColumn("score", F.when(explanation & is_doc, F.least(F.col("score") * boost, F.lit(1.0))).otherwise(F.col("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    nth_code = F.sum((F.col(kind) == "Code").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.withColumn("nth", nth_code).withColumn("score", F.when(explanation & (F.col(kind) == "Code") & (F.col("nth") > most_code), 0.0).otherwise(F.col("score"))).drop("nth")
    about = F.lit(False)
    for t in penal_terms:
        about = about | F.contains(F.lower(query), F.lit(t))
    out = out.withColumn("score", F.when(~about & F.contains(F.col(path), F.lit(penal_path)), F.col("score") * penalty).otherwise(F.col("score")))
    return ranked(out.drop("rank"))


def ambiguous(hits: DataFrame, *, load: float, unload: float, most: int = 4, path: str = "path") -> DataFrame:
    """query_id, above_load, paths_above_unload, list_instead, list_threshold."""
    out = hits.groupBy("query_id").agg(F.count(F.when(F.col("score") >= load, 1)).alias("above_load"), F.count_distinct(F.when(F.col("score") >= unload, F.col(path))).alias("paths_above_unload"))
    return out.withColumn("list_instead", (F.col("above_load") > most) | (F.col("paths_above_unload") > most)).withColumn("list_threshold", F.when(F.col("above_load") > most, load).otherwise(unload))


#: Wording of the candidate list.  Fixed text.
CANDIDATE_LEAD = (
    "These files match your query but have not been loaded. Treat this list as discovery metadata, not evidence. "
    "Mention the specific files you need if you want them loaded, and do not claim details that are not written explicitly below:\n\n"
)


def candidate_list(hits: DataFrame, threshold: Column | float, path: str = "path", summary: str = "summary") -> DataFrame:
    """query_id, stub_id, content: the best chunk of each path at or above the threshold, by rank."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    best = hits.where(F.col("score") >= limit).withColumn("nth", F.row_number().over(Window.partitionBy("query_id", path).orderBy("rank"))).where("nth = 1")
    line = F.when(F.coalesce(F.col(summary), F.lit("")) == "", F.concat(F.lit("- "), F.col(path))).otherwise(F.concat(F.lit("- "), F.col(path), F.lit(" — "), F.col(summary)))
    lines = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return lines.select("query_id", F.lit("__candidates__").alias("stub_id"), F.concat(F.lit(CANDIDATE_LEAD), F.array_join(F.col("l.line"), "\n")).alias("content"))


def mentioned(candidates: DataFrame, responses: DataFrame, load: float, path: str = "path") -> DataFrame:
    """Candidates at or above ``load`` whose path the query's response names, the best of each path."""
    found = candidates.where(F.col("score") >= load).join(responses.select("query_id", "response"), "query_id").where(F.contains("response", path)).drop("response")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", path).orderBy("rank"))).where("nth = 1").drop("nth")
