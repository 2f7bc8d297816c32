"""Edges between stubs: build from a code graph, neighbours, expansion, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EXPAND_CAP, EXPAND_DISCOUNT
from ..storage import replaced


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n")).cast("long")


def line_offset(text: Column, line: Column) -> Column:
    """Byte offset of a line (1 first), clamped to the last; line 0 is 0.  One look through the text."""
    before = F.least(line.cast("int"), line_count(text).cast("int")) - 1
    return F.when(before <= 0, F.lit(0)).otherwise(F.octet_length(F.call_function("substring_index", text, F.lit("\n"), before)) + 1).cast("long")


def line_starts(docs: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, line (1 first), at: the byte offsets at which all lines begin, for files that many places point into."""
    lines = docs.select(F.col(path).alias("path"), F.posexplode(F.split(F.coalesce(F.col(content), F.lit("")), "\n")).alias("n", "line"))
    before = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).cast("long")
    return lines.select("path", (F.col("n") + 1).alias("line"), at.alias("at"))


def covering_chunk(places: DataFrame, chunks: DataFrame, key: str = "path") -> DataFrame:
    """``places`` (key, place_id, at) with the id of the chunk (key, id, off, len) that holds the byte.

    Without one, the chunk with the greatest offset not past it; null if there is none either.
    The range join is an equi-join on the key with both predicates on top; one aggregation picks.
    """
    pairs = places.join(chunks, key, "left").where(F.col("off").isNull() | (F.col("off") <= F.col("at")))
    inside = F.col("at") < F.col("off") + F.col("len")
    picked = pairs.groupBy(key, "place_id", "at").agg(F.min(F.when(inside, F.struct("off", "id"))).alias("a"), F.max(F.struct("off", "id")).alias("b"))
    picked = picked.select(key, "place_id", "at", F.coalesce("a.id", "b.id").alias("id"))
    return places.select(key, "place_id", "at").distinct().join(picked, [key, "place_id", "at"], "left")


def build_edges(links: DataFrame, *, relations: list[str] | None = None, confidences: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, relation, weight) of mapped links and one row of counts by reason for what was left out.

    ``links``: src, dst (null where a node has no stub), relation, confidence, weight.  Equal edges
    keep the largest weight, 1 where none is given.
    """
    reason = F.when(~F.col("relation").isin(relations) if relations else F.lit(False), "relation").when(~F.col("confidence").isin(confidences) if confidences else F.lit(False), "confidence")
    reason = reason.when(F.col("src").isNull() | F.col("dst").isNull(), "unmapped").when(F.col("src") == F.col("dst"), "self")
    told = links.withColumn("reason", reason)
    edges = told.where("reason IS NULL").groupBy("src", "dst", "relation").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    return edges, told.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def write_edges(edges: DataFrame, path: str) -> DataFrame:
    """The edges in place of whatever ``path`` held, and the table as it then is.

    A new folder is written whole and takes the old one's place, so what is read may be what is replaced.
    """
    unique = edges.groupBy("src", "dst", "relation").agg(F.max("weight").alias("weight"))
    return replaced(unique, path)


def neighbours(seeds: DataFrame, edges: DataFrame, relations: list[str]) -> DataFrame:
    """query_id, seed, neighbour, relation, weight, seed_score; edges between two seeds give two rows."""
    kept = edges.where(F.col("relation").isin(relations)) if relations else edges.where(F.lit(False))
    s = seeds.select("query_id", F.col("id").alias("seed"), F.col("score").alias("seed_score"), F.col("rank").alias("seed_rank"))
    out = s.join(kept, s.seed == kept.src).select("query_id", "seed", F.col("dst").alias("neighbour"), "relation", "weight", "seed_score", "seed_rank")
    back = s.join(kept, s.seed == kept.dst).select("query_id", "seed", F.col("src").alias("neighbour"), "relation", "weight", "seed_score", "seed_rank")
    return out.unionByName(back)


def expansion_plan(seeds: DataFrame, edges: DataFrame, relations: list[str], *, discount: float = EXPAND_DISCOUNT, cap: int = EXPAND_CAP, digits: int = 6) -> DataFrame:
    """query_id, id, score, seed, seed_rank, relation, order: best per neighbour that is no seed, the first ``cap``."""
    near = neighbours(seeds, edges, relations).withColumn("score", F.round(F.col("seed_score") * discount * F.col("weight"), digits))
    near = near.join(seeds.select("query_id", F.col("id").alias("neighbour")), ["query_id", "neighbour"], "left_anti")
    best = Window.partitionBy("query_id", "neighbour").orderBy(F.desc("score"), "seed_rank", "relation")
    near = near.withColumn("nth", F.row_number().over(best)).where("nth = 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour")
    return near.withColumn("order", F.row_number().over(order)).where(F.col("order") <= cap).select("query_id", F.col("neighbour").alias("id"), "score", "seed", "seed_rank", "relation", "order")


def merge_adjacent(seeds: DataFrame, plan: DataFrame) -> DataFrame:
    """query_id, id, score, rank: neighbours right after their seed, best first."""
    a = seeds.select("query_id", "id", "score", F.col("rank").alias("at"), F.lit(0).alias("near"))
    b = plan.select("query_id", "id", "score", F.col("seed_rank").alias("at"), F.lit(1).alias("near"))
    order = Window.partitionBy("query_id").orderBy("at", "near", F.desc("score"), "id")
    both = a.unionByName(b).withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("at", "near", F.desc("score")))).where("nth = 1")
    return both.withColumn("rank", F.row_number().over(order)).select("query_id", "id", "score", "rank")


def merge_discounted(seeds: DataFrame, plan: DataFrame) -> DataFrame:
    from .knn import ranked

    return ranked(seeds.select("query_id", "id", "score").unionByName(plan.select("query_id", "id", "score")))
