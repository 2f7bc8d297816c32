"""Nearest neighbours by randomly rotated one-bit codes.

Every vector is centred on the corpus mean (of all vectors), brought to length 1, padded with
zeros to ``CODE_BITS`` coordinates at least and rotated by one random orthogonal matrix; the signs
of its coordinates are its code, packed to bits.  With the two correction scalars of a code (the
vector's distance from the centre, and the inner product of the unit vector with its own code)
the inner product with a rotated query is estimated without bias, and its error is bounded: it
stays within ``confidence`` standard widths but for a probability that falls with
``exp(-c * confidence**2)``.  More coordinates make the widths narrower.

A query block meets a candidate block in one task.  Estimates come from the unpacked bits in one
matrix product.  The best estimates are read in full; the k-th best of their scores is a floor,
and every candidate whose upper bound reaches it is read and scored too, in double precision.
Each task returns at most ``k`` rows a query, and the k best of these are the result.  Blocks have
a fixed number of rows, so no task grows with the table; the work is the stated queries times
all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, VECTOR_BLOCK = 1024, 16_384
SEED = 7
#: Coordinates of a code, at least: the error of an estimate falls with their square root.
CODE_BITS = 256


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite numbers, not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@lru_cache(maxsize=4)
def rotation(size: int) -> np.ndarray:
    """The first ``size`` columns of a random orthogonal matrix; the same for every call with this size."""
    bits = max(CODE_BITS, -(-size // 64) * 64)
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(SEED)).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:, :size]


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, distances from the centre, inner products of unit vectors with their codes."""
    rest = vectors - centre
    far = np.linalg.norm(rest, axis=1)
    unit = (rest / np.where(far > 0, far, 1)[:, None]) @ turn.T
    bits = unit > 0
    own = np.abs(unit).sum(axis=1) / np.sqrt(len(turn))
    return np.packbits(bits, axis=1), far, own


def bounds(query: np.ndarray, codes: np.ndarray, far: np.ndarray, own: np.ndarray, centre: np.ndarray, turn: np.ndarray, along: np.ndarray, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the inner products of queries (rows) with coded vectors, and the errors' bound.

    ``along``: the queries' inner products with the centre.
    """
    size = len(turn)
    signs = (np.unpackbits(codes, axis=1, count=size).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(size))
    turned = query @ turn.T
    safe = np.where(own > 0, own, 1)
    estimate = (turned.astype(np.float32) @ signs.T) * (far / safe).astype(np.float32) + along[:, None].astype(np.float32)
    width = np.sqrt(np.maximum(0, 1 - own**2)) / safe / np.sqrt(max(1, size - 1)) * far
    return estimate, confidence * np.linalg.norm(query, axis=1)[:, None].astype(np.float32) * width[None, :].astype(np.float32) + np.float32(1e-5)


def inner_products(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact scores in double precision, components added from first to last, so equal vectors tie."""
    total = np.zeros(len(vectors))
    for j in range(len(query)):
        total = total + vectors[:, j] * query[j]
    return total


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= least)
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))][:k]


INDEX = "vec_id long, size int, vector array<double>, code binary, far double, own double"


def coded(vectors: DataFrame, centres: dict[int, list[float]]) -> DataFrame:
    """The index: codes and correction scalars of every usable vector (vec_id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for n in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == n))
                data = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                codes, far, own = encode(data, np.array(centres[n]), rotation(n))
                yield pa.record_batch([part.column("vec_id"), pa.array(np.full(len(data), n, np.int32)), part.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far), pa.array(own)], names=["vec_id", "size", "vector", "code", "far", "own"])

    return vectors.mapInArrow(run, INDEX)


def nearest(table: DataFrame, queries: Column, k: int = 20, *, vec_id: str = "vec_id", vector: str = "embedding", confidence: float = 4.0, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest (largest inner product) of every query row.

    ``queries`` says which rows ask; all rows but the query's own answer.  Vectors that are null,
    empty, zero or hold null or non-finite components take no part, nor do rows without an id;
    vectors meet those of their own length.  Rows that repeat an id are answers each,
    but ask once, with the smallest vector.  A table without queries gives none.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    # one row a length: its centre and counts
    stats = rows.select(F.size("vector").alias("size"), "asks", F.posexplode("vector").alias("j", "x")).groupBy("size", "j").agg(F.avg("x").alias("m"), F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q"))
    stats = stats.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("j", "m"))).alias("c"), F.max("n").alias("n"), F.max("q").alias("q")).collect()
    centres = {r["size"]: [x["m"] for x in r["c"]] for r in stats}
    split = {r["size"]: (max(1, -(-r["q"] // query_block)), max(1, -(-r["n"] // vector_block))) for r in stats}
    index = coded(rows.select("vec_id", "vector"), centres)
    n_q = F.coalesce(*[F.when(F.col("size") == s, F.lit(q)) for s, (q, _) in split.items()]) if split else F.lit(1)
    n_v = F.coalesce(*[F.when(F.col("size") == s, F.lit(v)) for s, (_, v) in split.items()]) if split else F.lit(1)
    asking = rows.where("asks").groupBy("vec_id").agg(F.min("vector").alias("vector")).select("vec_id", F.size("vector").alias("size"), "vector")
    asking = asking.withColumn("qb", F.pmod(F.xxhash64("vec_id"), n_q).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), n_v - 1)))
    index = index.withColumn("vb", F.pmod(F.xxhash64("vec_id", "vector"), n_v).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), n_q - 1)))

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        n = held.column("size")[0].as_py()
        matrix = lambda t: np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("vector").chunks]).reshape(-1, n)
        query, vectors = matrix(asked), matrix(held)
        ids, query_ids = held.column("vec_id").to_numpy(), asked.column("vec_id").to_numpy()
        codes = np.stack([np.frombuffer(c.as_buffer(), np.uint8) for chunk in held.column("code").chunks for c in chunk])
        far, own, centre, turn = held.column("far").to_numpy(), held.column("own").to_numpy(), np.array(centres[n]), rotation(n)
        out_q, out_v, out_s = [], [], []
        for start in range(0, len(query), 128):
            part = query[start : start + 128]
            estimate, error = bounds(part, codes, far, own, centre, turn, part @ centre, confidence)
            for r in range(len(part)):
                estimate[r][ids == query_ids[start + r]] = -np.inf
                answers = np.flatnonzero(estimate[r] > -np.inf)
                if not len(answers):
                    continue
                floor = -np.inf
                if len(answers) > k:
                    first = np.argpartition(estimate[r], -min(len(ids), 4 * k))[-4 * k :]
                    seen = vectors[first[estimate[r][first] > -np.inf]] @ part[r]
                    floor = np.partition(seen, len(seen) - k)[len(seen) - k] if len(seen) >= k else floor
                may = np.flatnonzero(estimate[r] + error[r] >= floor)
                may = may[estimate[r][may] > -np.inf]
                # products in any order say who can be among the k best; their scores are then added up in one order
                rough = vectors[may] @ part[r]
                if len(may) > k:
                    may = may[rough >= np.partition(rough, len(may) - k)[len(may) - k] - 1e-9 * (1 + np.abs(rough).max())]
                scores = inner_products(part[r], vectors[may])
                top = best(scores, ids[may], k)
                out_q.append(np.full(len(top), query_ids[start + r]))
                out_v.append(ids[may][top])
                out_s.append(scores[top])
        if not out_q:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    found = asking.groupBy("size", "qb", "vb").cogroup(index.groupBy("size", "qb", "vb")).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_rabit_search(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP10_SQL = r"""
WITH v AS (SELECT vec_id::BIGINT AS vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
      FROM u q JOIN u c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
