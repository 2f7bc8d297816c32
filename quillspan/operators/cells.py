"""Approximate nearest neighbours: an index of cells, saved and opened again.

Centroids come from a bounded sample by spherical k-means on the driver; every vector goes to the cell
of its nearest centroid.  A search reads the cells nearest to a query and scores their vectors exactly;
``probes`` sets how many, and all of them give the exact result.  How many are enough is measured when
the index is built: vectors of the sample ask the sample, by brute force.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .knn import QUERY_BLOCK, VECTOR_BLOCK, block_scorer, ranked

#: Vectors that the centroids are fitted on at most, cells at most, and rounds of k-means.
SAMPLE, MOST_CELLS, ROUNDS, SEED = 65_536, 4096, 12, 42
#: Recall that the default number of probes is fitted to, by so many queries for so many neighbours.
RECALL, ASKED, NEIGHBOURS = 0.95, 256, 10


class Cells(NamedTuple):
    """vectors (id, vector, cell, part), sizes (cell, n, parts), and the centroids."""

    vectors: DataFrame
    sizes: DataFrame
    centroids: np.ndarray
    n: int
    probes: int


def _probes(sample: np.ndarray, centroids: np.ndarray) -> int:
    """The least number of cells that holds ``RECALL`` of the sample's neighbours of its first vectors."""
    asked = sample[:ASKED]
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, : min(NEIGHBOURS, len(sample) - 1)]
    cell = np.concatenate([(sample[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
    order = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    places = np.sort(np.take_along_axis(order, cell[best], axis=1).ravel())
    return int(places[min(len(places) - 1, int(RECALL * len(places)))]) + 1 if len(places) else 1


def _fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centroids = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(ROUNDS):
        nearest = np.concatenate([(sample[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column.to_numpy(zero_copy_only=False)])


def build_cells(vectors: DataFrame, path: str, cells: int | None = None) -> None:
    """Write the index of unit ``vectors`` (id, vector) under ``path``.

    Null vectors are left out; an empty table gives an empty index.  ``cells``: about the root of the
    number of vectors by default.  A cell's vectors are dealt into parts of bounded size.
    """
    spark = vectors.sparkSession
    held = vectors.where(F.col("vector").isNotNull()).select("id", F.col("vector").cast("array<double>").alias("vector"))
    n = held.count()
    sample = [r["vector"] for r in held.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(SAMPLE).select("vector").collect()]
    cells = min(cells or max(1, round(n**0.5)), MOST_CELLS, max(1, len(sample)))
    centroids = _fitted(np.array(sample), cells) if sample else np.zeros((1, 1))

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                cell = (_matrix(batch.column("vector")) @ centroids.T).argmax(axis=1)
                yield pa.record_batch([*batch.columns, pa.array(cell, pa.int32())], names=["id", "vector", "cell"])

    kind = vectors.schema["id"].dataType.simpleString()
    held.mapInArrow(placed, f"id {kind}, vector array<double>, cell int").sortWithinPartitions("cell", "id").write.parquet(f"{path}/vectors")
    sizes = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"))
    sizes.withColumn("parts", F.ceil(F.col("n") / VECTOR_BLOCK).cast("int")).write.parquet(f"{path}/sizes")
    enough = _probes(np.array(sample), centroids) if sample else 1
    spark.createDataFrame([(i, c.tolist(), enough) for i, c in enumerate(centroids)], "cell int, centroid array<double>, probes int").coalesce(1).write.parquet(f"{path}/centroids")


def open_cells(spark: SparkSession, path: str, n: int | None = None) -> Cells:
    """The index at ``path``; with ``n``, one of another number of vectors raises ValueError."""
    sizes = spark.read.parquet(f"{path}/sizes")
    held = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if n is not None and n != held:
        raise ValueError(f"the index holds {held} vectors, not {n}")
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return Cells(spark.read.parquet(f"{path}/vectors"), sizes, np.array([r["centroid"] for r in rows]), held, rows[0]["probes"])


def cells_topk(index: Cells, queries: DataFrame, k: int, probes: int | None = None, digits: int = 6) -> DataFrame:
    """query_id, id, score, rank: the k best of the ``probes`` cells nearest to each query (by default, what the index measured).

    A block of queries meets a part of a cell in one task, which gives k rows a query.
    """
    probes = min(probes or index.probes, len(index.centroids))
    n_q = max(1, -(-queries.count() // QUERY_BLOCK))
    centroids = index.centroids
    kind_q, kind_v = (t.simpleString() for t in (queries.schema["query_id"].dataType, index.vectors.schema["id"].dataType))

    def near(batches):
        for batch in batches:
            if batch.num_rows:
                close = np.argsort(-(_matrix(batch.column("vector")) @ centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.record_batch([*batch.columns, pa.array(list(close), pa.list_(pa.int32()))], names=["query_id", "vector", "cells"])

    asked = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    asked = asked.mapInArrow(near, f"query_id {kind_q}, vector array<double>, cells array<int>").select("query_id", "vector", F.explode("cells").alias("cell"))
    asked = asked.join(index.sizes.select("cell", "parts"), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int"))
    held = index.vectors.join(index.sizes.select("cell", "parts"), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    keys = ["cell", "part", "qb"]
    found = asked.select(*keys, "query_id", "vector").groupBy(*keys).cogroup(held.select(*keys, "id", "vector").groupBy(*keys)).applyInArrow(block_scorer(k, digits), f"query_id {kind_q}, id {kind_v}, score double")
    return ranked(found, k)
