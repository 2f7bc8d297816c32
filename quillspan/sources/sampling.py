"""Haystacks and samples of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import item

#: Multiplier and increment of the 64-bit generator.  Fixed values.
LCG = (6364136223846793005, 1442695040888963407)
SUBJECTS = "the archive|a quiet committee|the northern station|an old ledger|the survey team|a passing engineer|the second draft|the harbour office".split("|")
VERBS = "records|compares|postpones|describes|collects|revises|questions|arranges".split("|")
OBJECTS = "seasonal measurements|routine deliveries|minor repairs|unrelated correspondence|spare parts|old timetables|visitor notes|weather reports".split("|")


class Generator:
    """The linear congruential generator with wrap-around."""

    def __init__(self, seed: int):
        self.state = seed & (2**64 - 1)

    def next(self) -> int:
        self.state = (self.state * LCG[0] + LCG[1]) & (2**64 - 1)
        return self.state

    def pick(self, n: int) -> int:
        return self.next() % n


def haystack(paragraphs: int, seed: int, needle: str, position: int) -> list[str]:
    """Filler paragraphs of three to six sentences with the needle at a position, clamped."""
    g = Generator(seed)
    out = []
    for _ in range(paragraphs):
        n = 3 + g.pick(4)
        out.append(" ".join(f"{SUBJECTS[g.pick(len(SUBJECTS))].capitalize()} {VERBS[g.pick(len(VERBS))]} {OBJECTS[g.pick(len(OBJECTS))]}." for _ in range(n)))
    out.insert(max(0, min(position, len(out))), needle)
    return out


def haystack_documents(spark: SparkSession, items: list[tuple[str, str, int, int]], paragraphs: int = 80) -> DataFrame:
    """item, path, content, is_needle: a document a paragraph, of items (id, needle, seed, position)."""

    def rows(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                made = haystack(paragraphs, r.seed, r.needle, r.position)
                yield __import__("pandas").DataFrame([(r.item, f"{r.item}/{i:04d}.txt", t, t == r.needle) for i, t in enumerate(made)], columns=["item", "path", "content", "is_needle"])

    return spark.createDataFrame(items, "item string, needle string, seed long, position long").mapInPandas(rows, "item string, path string, content string, is_needle boolean")


def file_weight(path: Column) -> Column:
    """3 for READMEs, 2 for change logs and news, 1 for the rest."""
    name = F.lower(item(F.split(path, "/"), -1))
    return F.when(F.startswith(name, F.lit("readme")), 3).when(name.rlike("^(changelog|changes|news)"), 2).otherwise(1)


def weighted_sample(files: DataFrame, n: int, seed: str, *, weight: Column | None = None, newer_than: int | None = None, key: str = "path") -> DataFrame:
    """``n`` rows without replacement, chances by weight: the smallest of -ln(u)/weight, u from a hash of the key."""
    weight = file_weight(F.col(key)) if weight is None else weight
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    rows = files.where(F.col("mtime") >= newer_than) if newer_than is not None else files
    return rows.withColumn("__key", -F.log(u) / weight).orderBy("__key", key).limit(n).drop("__key")


def curated(documents: DataFrame, referenced: DataFrame, distractors: int, seed: str, key: str = "path") -> DataFrame:
    """Everything referenced and a uniform sample of the rest."""
    rest = documents.join(referenced.select(key).distinct(), key, "left_anti")
    return documents.join(referenced.select(key).distinct(), key, "left_semi").unionByName(weighted_sample(rest, distractors, seed, weight=F.lit(1.0), key=key))
