"""Exact nearest neighbours of a stated query set, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, VECTOR_BLOCK = 1024, 16_384


def normalized(vector: Column) -> Column:
    """v / |v|; a zero vector stays."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(doubles, lambda x: x / norm)).otherwise(doubles)


def block_scorer(k: int, digits: int):
    """What a task does with a block of queries and one of vectors: k rows a query, ties to smaller ids."""

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": a.column("query_id").slice(0, 0), "id": b.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        matrix = lambda t: np.stack([np.asarray(v, np.float64) for v in t.column("vector").to_numpy()])
        b = b.take(pa.array(np.argsort(b.column("id").to_numpy(), kind="stable")))  # ties go to the first
        query, held_vectors = matrix(a), matrix(b)
        at_q, at_v, scores = [], [], []
        for start in range(0, len(query), 128):
            found = np.round(query[start : start + 128] @ held_vectors.T, digits)
            for r, row in enumerate(found):
                least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                among = np.flatnonzero(row >= least)
                top = among[np.argsort(-row[among], kind="stable")][:k]
                at_q.append(np.full(len(top), start + r))
                at_v.append(top)
                scores.append(row[top])
        at_q, at_v = np.concatenate(at_q), np.concatenate(at_v)
        return pa.table({"query_id": a.column("query_id").take(pa.array(at_q)), "id": b.column("id").take(pa.array(at_v)), "score": np.concatenate(scores)})

    return block


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, *, digits: int = 6, blocks: tuple[int, int] | None = None) -> DataFrame:
    """query_id, id, score, rank: the k largest inner products of ``queries`` (query_id, vector) with ``vectors`` (id, vector).

    Scores are rounded to ``digits`` before they are ranked, ties go to smaller ids.  A block of
    queries meets a block of vectors in one task and gives k rows a query, whatever the table's
    size; counts that set the number of blocks are read from the tables.
    """
    if blocks is None:
        blocks = (-(-queries.count() // QUERY_BLOCK), -(-vectors.count() // VECTOR_BLOCK))
    n_q, n_v = (max(1, b) for b in blocks)
    asked = queries.select("query_id", "vector").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))))
    held = vectors.select("id", "vector").withColumn("vb", F.pmod(F.xxhash64("id"), F.lit(n_v)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    kind_q, kind_v = queries.schema["query_id"].dataType, vectors.schema["id"].dataType

    found = asked.groupBy("qb", "vb").cogroup(held.groupBy("qb", "vb")).applyInArrow(block_scorer(k, digits), f"query_id {kind_q.simpleString()}, id {kind_v.simpleString()}, score double")
    return ranked(found, k)


def ranked(hits: DataFrame, k: int | None = None, score: str = "score") -> DataFrame:
    """``hits`` (query_id, id, score) with a rank from 1, ties to smaller ids; the first k."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "id")
    out = hits.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k) if k is not None else out
