"""The stub table: upserts, staleness, ignore flags, completeness, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import ignore_regex


def live(stubs: DataFrame) -> DataFrame:
    return stubs.where("NOT stale AND NOT ignored")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", dimension: int | None = None, vector: str = "embedding") -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; of equal keys in ``new`` the largest sequence wins.

    With ``dimension``, a vector of another length raises when the rows are read.
    """
    if dimension is not None:
        bad = F.raise_error(F.concat(F.lit(f"expected {dimension} components, got "), F.size(vector).cast("string")))
        new = new.withColumn(vector, F.when(F.size(vector) == dimension, F.col(vector)).otherwise(bad))
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new.dropDuplicates([key]), allowMissingColumns=True)


def replace_path(old: DataFrame, new: DataFrame, path: str = "path") -> DataFrame:
    """All rows of the new rows' paths go, the new ones come, not stale."""
    return old.join(new.select(path).distinct(), path, "left_anti").unionByName(new.withColumn("stale", F.lit(False)))


def delete_paths(paths: DataFrame, stubs: DataFrame, *dependents: DataFrame) -> tuple[DataFrame, ...]:
    """The stubs without these paths, and each dependent table (stub_id) without their stubs."""
    gone = stubs.join(paths.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("stub_id"))
    return (stubs.join(paths.select("path").distinct(), "path", "left_anti"), *(d.join(gone, "stub_id", "left_anti") for d in dependents))


def complete_files(stubs: DataFrame) -> DataFrame:
    """path, mtime of files all of whose chunks are there and not stale."""
    return stubs.where("NOT stale").groupBy("path", "mtime").agg(F.count("*").alias("have"), F.max("chunk_total").alias("want")).where("have >= want").select("path", "mtime")


def stale_paths(stubs: DataFrame) -> DataFrame:
    return stubs.where("stale").select("path").distinct()


def mark_stale(stubs: DataFrame, which: Column) -> tuple[DataFrame, DataFrame]:
    """The stubs with ``which`` marked, and one row: how many changed."""
    changed = which & ~F.col("stale")
    return stubs.withColumn("stale", F.col("stale") | F.coalesce(which, F.lit(False))), stubs.agg(F.count(F.when(changed, 1)).alias("changed"))


def detect_stale(stubs: DataFrame, current: DataFrame) -> DataFrame:
    """Stubs whose source is gone or has another time than the one stored (0: unknown) are stale; marks stay."""
    now = current.select("path", F.col("mtime").alias("now"))
    out = stubs.join(now, "path", "left")
    moved = F.col("now").isNull() | ((F.col("mtime") != 0) & (F.col("mtime") != F.col("now")))
    return out.withColumn("stale", F.col("stale") | moved).drop("now")


def apply_ignores(stubs: DataFrame, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
    """``ignored`` as the patterns say, and one row: newly ignored, cleared."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("path").rlike(ignore_regex(p))
    counts = stubs.agg(F.count(F.when(hit & ~F.col("ignored"), 1)).alias("ignored"), F.count(F.when(~hit & F.col("ignored"), 1)).alias("cleared"))
    return stubs.withColumn("ignored", hit), counts


def chunks_of(stubs: DataFrame, path: Column | str) -> DataFrame:
    return live(stubs).where(F.col("path") == path).orderBy("byte_offset").select("id", "byte_offset")


def geometry(stubs: DataFrame) -> DataFrame:
    return live(stubs).select("path", "id", F.col("byte_offset").alias("off"), F.col("byte_length").alias("len"))


def searchable(hits: DataFrame, stubs: DataFrame) -> DataFrame:
    """Hits whose stub is there and live, with its columns; fewer than asked may remain."""
    return hits.join(live(stubs), "id")


def save_notes(notes: DataFrame, path: str) -> None:
    notes.write.mode("append").parquet(path)


def load_notes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy("created_at", "stub_id")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")
