"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _edges(df: DataFrame) -> DataFrame:
    return df.where("u != v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _edges(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _edges(down.join(least, "u").select("v", "m").union(least.select("u", "m")).toDF("u", "v"))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, component (smallest id reachable) of every node with an edge; ``edges`` has u and v, long.

    Every round is written to the shared folder.  Hub nodes are aggregated partially before the
    shuffle; their edges meet in one join key.  Null ends, loops and repeated edges count for nothing; a
    table without edges gives none.
    """
    now, mark = stored(_edges(edges.select("u", "v")), "components"), None
    for _ in range(most_rounds):
        after = stored(_small_star(_large_star(now)), "components")
        dropped(now)
        now = after
        seen = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v"))).distinct()
