"""Main text of web pages by the recurrent block labeller."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import row_groups
from .html_blocks import blocks
from .html_model import BlockLabeller, features, labels, trained


def main_texts(model: BlockLabeller, pages: list[str]) -> list[str]:
    """Article blocks of each page, one a line."""
    split = [blocks(p) for p in pages]
    chosen = labels(model, [features(b) for b in split])
    return ["\n".join(b.text for b, yes in zip(found, keep) if yes) for found, keep in zip(split, chosen)]


def with_main_text(pages: DataFrame, *, html: str = "html", out: str = "text", drop_html: bool = True) -> DataFrame:
    """``pages`` with the main text in ``out``; the page's source goes unless ``drop_html`` is False.

    Null and empty html, and pages without an article, give an empty text; very long pages are read
    whole.  Equal pages give equal texts; an empty table gives an empty result.  Raises ValueError
    where ``out`` is a column already; other columns pass, whatever their names.
    """
    if out in pages.columns:
        raise ValueError(f"column {out!r} is there already")
    kept = [f for f in pages.schema.fields if not (drop_html and f.name == html)]
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sources in row_groups(batches, html):
            columns = [rows.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(main_texts(model, sources), pa.string())], names=[*(f.name for f in kept), out])

    return pages.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType())]))


def op5_html_extract(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return with_main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
