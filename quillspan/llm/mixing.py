"""Mixing sources to target weights with Efraimidis-Spirakis sampling, in DataFrame functions alone.

Every document gets the key ``-ln(u) / w``: ``u`` from a hash of seed, id and source, ``w`` its
quality weight.  A source's target is cut into complete epochs of all its documents and one
fractional epoch, which takes documents in order of their keys until the budget is met.

No source is sorted whole.  Keys fall into ``key_buckets`` ranges; one aggregation gives the size
of each (source, range), a running sum over at most ``key_buckets`` rows a source finds the range
that the budget ends in, and only rows of one (source, range) are ordered together.  So a source
that holds most of the rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Characters that lower a document's quality weight by their share.
SYMBOLS = "#*$%&|<>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def symbol_quality(text: Column) -> Column:
    """Share of characters that are no symbols, 0.1 at least; 1 for null or empty texts."""
    share = F.try_divide(F.length(F.translate(text, SYMBOLS, "")), F.length(text))
    return F.greatest(F.lit(0.1), F.coalesce(share, F.lit(1.0)))


def targets(sizes: DataFrame, weights: Column | None = None, limit: float = 3.0) -> DataFrame:
    """Water-filling of the targets: ``sizes`` has one row a source (source, nil, source_size).

    ``weights``: by default 1, 2, 3, repeating, over the sources by code point, null last.  The
    windows without a key below order one row a source, not documents.
    """
    by_name = Window.orderBy("nil", "source")
    named = sizes.withColumn("n", F.row_number().over(by_name))
    named = named.withColumn("w", (weights if weights is not None else (F.col("n") - 1) % 3 + 1).cast("double")).withColumn("most", F.col("source_size") * F.lit(limit))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("w"), "n").rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        named.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_w", F.sum("w").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
        .withColumn("full", F.col("most") <= F.col("level") * F.col("w"))
    )
    held = F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(everything)
    open_w = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everything)
    share = F.when(open_w > 0, (F.col("total") - held) / F.when(open_w > 0, open_w) * F.col("w"))
    return filled.select("nil", "source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.least("most", share)).alias("target"))


def mix_sources(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", size: Column | None = None, quality: Column | None = None, weights: Column | None = None, limit: float = 3.0, seed: str = "mix-1", key_buckets: int = 4096, stand_in: Column | None = None, out: str = "mix") -> DataFrame:
    """``docs`` with a struct ``out``: size, source_size, target, copies, taken.

    Nulls: a null text has size 0 and a null source is a source of its own.  Empty texts, and texts
    without words, are taken with 0 words.  Very long texts are measured whole.  A row without an id
    is known by ``stand_in`` (its text's hash, where ``text`` is a column), so that such rows do not
    share one key.  Repeated rows have equal keys and each counts; ties of keys go by id, then size.
    An empty table gives an empty result.  A column that is already called ``out`` raises ValueError;
    all other columns pass, whatever their names.
    """
    if out in docs.columns:
        raise ValueError(f"column {out!r} is there already")
    size = word_count(F.col(text)) if size is None else size
    quality = symbol_quality(F.col(text)) if quality is None else quality
    stand_in = stand_in if stand_in is not None else F.md5(F.col(text)) if text in docs.columns else F.lit(None)
    named = F.coalesce(F.col(doc_id).cast("string"), stand_in, F.lit("null"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), named, F.coalesce(F.col(source), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    key = -F.log(u) / quality
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(source).isNull().cast("int").alias("nil"), F.col(doc_id).alias("id"), size.alias("size"), key.alias("key"))
    rows = rows.withColumn("bucket", F.least(F.lit(key_buckets - 1), F.floor((1 - F.exp(-F.col("key"))) * key_buckets)).cast("int"))
    summed = rows.groupBy("nil", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    up_to = Window.partitionBy("nil", "source").orderBy("bucket")
    summed = summed.withColumn("below", F.sum("bucket_size").over(up_to) - F.col("bucket_size"))
    goals = targets(summed.groupBy("nil", "source").agg(F.sum("bucket_size").alias("source_size")), weights, limit)
    plan = summed.join(goals, ["nil", "source"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    in_order = Window.partitionBy("nil", "source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(plan, ["nil", "source", "bucket"]).withColumn("before", F.col("below") + F.sum("size").over(in_order) - F.col("size"))
    # the document that the budget ends in is taken if its middle lies within
    more = (F.col("rest") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("rest"))
    copies = F.col("epochs") + more.cast("long")
    return placed.select("row.*", F.struct("size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")).alias(out))


def repeated(mixed: DataFrame, out: str = "mix") -> DataFrame:
    """The mix itself: each document as often as it is taken, without the struct.

    Rows, nulls and texts pass as they are; an empty table stays empty.  A column that is already
    called ``__copy`` raises ValueError.
    """
    if "__copy" in mixed.columns:
        raise ValueError("column '__copy' is there already")
    columns = [c for c in mixed.columns if c != out]
    times = F.explode(F.sequence(F.lit(1), F.col(f"{out}.copies").cast("int")))
    return mixed.where(F.col(f"{out}.copies") > 0).select(*[F.col(f"`{c}`") for c in columns], times.alias("__copy")).drop("__copy")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The texts are read and measured once: what the mix needs of them is a small table, written and read twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    measured = docs.select("doc_id", "source", word_count(F.col("text")).alias("words"), symbol_quality(F.col("text")).alias("quality"), F.when(F.col("doc_id").isNull(), F.md5("text")).alias("stand_in"))
    return mix_sources(stored(measured, "measured"), size=F.col("words"), quality=F.col("quality"), stand_in=F.col("stand_in")).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "source", "mix.copies")


#: The same without buckets: whole sources ordered by key.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         greatest(0.1, coalesce(CASE WHEN length(text) > 0 THEN length(translate(text, '#*$%&|<>', ''))::DOUBLE / length(text) END, 1.0)) AS q,
         (('0x' || substr(md5(concat_ws('|', 'mix-1', coalesce(doc_id::VARCHAR, md5(text), 'null'), coalesce(source, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (SELECT *, -ln(u) / q AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM k GROUP BY source),
w AS (SELECT *, ((n - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS most, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(most) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM w
      WINDOW b AS (ORDER BY most / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, most <= level * w AS filled FROM l),
t AS (SELECT source, source_size,
        CASE WHEN filled THEN most ELSE least(most, (total - sum(CASE WHEN filled THEN most ELSE 0 END) OVER ()) / sum(CASE WHEN filled THEN 0 ELSE w END) OVER () * w) END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.source, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, ((epochs + (rest > 0 AND before + size / 2.0 <= rest)::INT) * size)::BIGINT AS taken, source,
       (epochs + (rest > 0 AND before + size / 2.0 <= rest)::INT)::BIGINT AS copies FROM p
"""
