"""A training-corpus pipeline: quality rules, near duplicates, secrets, source mix, pieces.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the
shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import mixing, neardup, pieces, quality, secrets
from quillspan.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines and rejected documents go.

    Null, empty and wordless texts are rejected; very long ones are judged whole; repeated rows fare
    alike; all columns stay; an empty table stays empty.
    """
    return quality.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets with a similarity of 0.8 stays.

    Null ids and wordless texts all stay; very long texts count whole; repeated rows count once; ties
    go to the smallest id; all columns stay; an empty table stays empty.
    """
    return neardup.deduplicated(docs, size=5, num=80, den=100)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays.

    Null and empty texts stay as they are; very long ones are scanned whole; repeated rows change
    alike; all columns stay; an empty table stays empty.
    """
    return secrets.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is one of its own; texts without words have no words to take and go with their
    source's complete epochs; repeated rows count each; all columns stay; an empty table stays empty.
    """
    return mixing.repeated(mixing.mix_sources(docs))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and source with the ids of the text and their count.

    Null and empty texts have no ids; very long ones are encoded whole; repeated rows give a row each;
    an empty table stays empty.
    """
    encoded = pieces.encode_pieces(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "source", F.size("piece_ids").cast("long").alias("n_tokens"), "piece_ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("piece_ids", piece_ids),
]

#: SQL expresses neither the line rules' verdicts nor the encoding; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
