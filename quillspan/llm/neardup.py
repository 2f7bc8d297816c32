"""Near duplicates by circulant MinHash, banding and exact Jaccard on full shingle sets.

1. One pass over the texts gives each document its set's fingerprint, size, a signature of
   ``bands * rows`` coordinates and the bands' hashes.  Two permutations make all coordinates:
   the first (a hash onto the ring) places a shingle, the second is read from that place on,
   shifted circularly by one for each coordinate; so a shingle's values are one slice of a table.
2. Equal sets are one class with the smallest id as representative (a partial aggregation, so
   thousands of copies are one row from here on).
3. Representatives in a band's bucket form a star around the smallest one, not all pairs.
   Star pairs whose sizes allow it are verified exactly on full sets.
4. Components of the verified links.  Buckets that still hold members of different components
   are the rest.  Their members, with those they share such buckets with, are families; a family
   is dealt into blocks of bounded size, each two blocks meet in a task, and members of different
   components whose signatures come near the threshold are verified exactly there.  A task gives
   links alone, so no link that a bucket has seen is lost and no pairs are written out.
5. Components again, over all links; a class passes its component on to its copies.

A pair at the threshold of 0.8 shares none of 24 bands of 4 rows with probability 3e-6; at 0.85, 2e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, row_groups, stored
from .components import connected_components

RING = 1 << 21
SEED = 20_240_001
#: Members and shingles of a block, on average, in the comparison of what stars have left over.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: Standard errors below the threshold at which a signature's estimate still counts as near.
SLACK = 4.5
LOWER = {i: i + 32 for i in range(65, 91)}


@lru_cache(maxsize=2)
def _ring(coordinates: int) -> np.ndarray:
    """The second permutation, its start repeated at its end, so that each slice is contiguous."""
    ring = np.random.Generator(np.random.PCG64(SEED)).permutation(RING).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[: coordinates - 1]]), coordinates)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Words()


def shingle_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and how many each has.

    A-Z are lowered and words are what ASCII white space parts; a text of fewer than ``size`` words
    has its whole sequence as one shingle, one without words has none.
    """
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]  # of bytes: A-Z alone are lowered
    counts = np.fromiter(map(len, words), np.int64, len(words))
    hashes = np.fromiter((h for w in words for h in map(_WORDS.__getitem__, w)), np.uint64, int(counts.sum()))
    owner = np.repeat(np.arange(len(texts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))  # words from here to the text's end
    length = np.minimum(size, np.repeat(counts, counts))
    starts = np.flatnonzero(left >= length)
    out = np.full(len(starts), SEED, np.uint64)
    for k in range(size):
        inside = length[starts] > k
        at = np.minimum(starts + k, max(0, len(hashes) - 1))
        out = np.where(inside, _mixed(out + hashes[at] * np.uint64(2 * k + 3)), out) if len(starts) else out
    owner = owner[starts]
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], np.bincount(owner[new], minlength=len(texts)).astype(np.int64)


def signatures(flat: np.ndarray, counts: np.ndarray, coordinates: int, step: int = 512) -> np.ndarray:
    """Coordinates of each set, a row a set; sets without shingles get the largest numbers."""
    table = _ring(coordinates)
    out = np.full((len(counts), coordinates), np.iinfo(np.uint32).max, np.uint32)
    at = (_mixed(flat + np.uint64(SEED)) % np.uint64(RING)).astype(np.int64)
    ends = np.cumsum(counts)
    for row, n, end in zip(out, counts.tolist(), ends.tolist()):
        for i in range(end - n, end, step):  # slices that stay in the cache
            np.minimum(row, table[at[i : min(end, i + step)]].min(axis=0), out=row)
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash of each band, different for equal values in different bands."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for k in range(rows):
        h = _mixed(h ^ (parts[:, :, k] + np.uint64((k + 1) * 0xD1B54A32D192ED03 % 2**64)))
    return h.view(np.int64)


SKETCH = "doc_id long, n_shingles long, fp binary, signature binary, bands array<long>"


def sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in row_groups(batches, "text", 1_000_000):
            flat, counts = shingle_sets(texts, size)
            ends = np.cumsum(counts)
            prints = [hashlib.blake2b(flat[e - n : e].tobytes(), digest_size=16).digest() if n else None for e, n in zip(ends.tolist(), counts.tolist())]
            signature = signatures(flat, counts, bands * rows)
            hashed = band_hashes(signature, bands, rows)
            lists = pa.ListArray.from_arrays(np.arange(0, len(texts) * bands + 1, bands, dtype=np.int32), pa.array(hashed.ravel()))
            yield pa.record_batch([part.column("doc_id"), pa.array(counts), pa.array(prints, pa.binary()), pa.array([s.tobytes() for s in signature], pa.binary()), lists], names=["doc_id", "n_shingles", "fp", "signature", "bands"])

    return docs.mapInArrow(run, SKETCH)


def _sets(wanted: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """id, fp, shingles of the wanted classes (id, fp), made anew from the texts of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in row_groups(batches, "text", 1_000_000):
            flat, counts = shingle_sets(texts, size)
            ends = np.cumsum(counts)
            sets = [flat[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist())]
            same = [hashlib.blake2b(s, digest_size=16).digest() == f for s, f in zip(sets, part.column("fp").to_pylist())]
            yield pa.record_batch([part.column("doc_id"), part.column("fp"), pa.array(sets, pa.binary())], names=["id", "fp", "shingles"]).filter(pa.array(same))

    found = docs.join(wanted.select(F.col("id").alias("doc_id"), "fp"), "doc_id").select("doc_id", "fp", "text")
    return found.mapInArrow(run, "id long, fp binary, shingles binary").dropDuplicates(["id", "fp"])


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, fa, b, fb), those whose full sets are similar enough, as edges u, v."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("u", "v", "x", "y")]
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(columns[k][i].as_buffer(), np.uint64) for k in (2, 3))
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if den * shared >= num * (len(both) - shared):
                    keep.append(i)
            yield pa.record_batch([columns[0], columns[1]], names=["u", "v"]).take(pa.array(keep, pa.int64()))

    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("fp").alias("fb"), F.col("shingles").alias("y")), ["b", "fb"])
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("fp").alias("fa"), F.col("shingles").alias("x")), ["a", "fa"])
    return both.select(F.col("a").alias("u"), F.col("b").alias("v"), "x", "y").mapInArrow(compare, "u long, v long")


def _may(n: Column, m: Column, num: int, den: int) -> Column:
    """Sets of these sizes can reach the threshold."""
    return F.least(n, m) * den >= F.greatest(n, m) * num


def _left_over(members: DataFrame, num: int, den: int, coordinates: int) -> DataFrame:
    """Links u, v between different components of a family.

    ``members``: family, id, fp, n, signature, shingles, component, blocks (how many the family is dealt into).
    """
    near = num / den - SLACK * (num / den * (1 - num / den) / coordinates) ** 0.5
    own = F.pmod(F.xxhash64("id", "fp"), F.col("blocks")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "signature", "shingles", "component")

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, ids, sizes, comps = (table.column(c).to_numpy() for c in ("own", "id", "n", "component"))
        sig = np.stack([np.frombuffer(s.as_buffer(), np.uint32) for c in table.column("signature").chunks for s in c])
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for c in table.column("shingles").chunks for s in c]
        names, comp = np.unique(comps, return_inverse=True)  # merged as links are found
        u, v = [], []
        others = np.flatnonzero(own == j)
        for r in np.flatnonzero(own == i).tolist():
            may = others[others > r] if i == j else others
            may = may[comp[may] != comp[r]]
            may = may[np.minimum(sizes[may], sizes[r]) * den >= np.maximum(sizes[may], sizes[r]) * num]
            may = may[(sig[may] == sig[r]).mean(axis=1) >= near] if len(may) else may
            if not len(may):
                continue
            several = np.concatenate([sets[k] for k in may])
            at = np.minimum(np.searchsorted(sets[r], several), len(sets[r]) - 1)
            shared = np.add.reduceat((sets[r][at] == several).astype(np.int64), np.cumsum(sizes[may]) - sizes[may])
            for k in may[den * shared >= num * (sizes[may] + sizes[r] - shared)].tolist():
                if comp[k] != comp[r]:
                    comp[comp == comp[k]] = comp[r]
                    u.append(ids[r])
                    v.append(ids[k])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return dealt.groupBy("family", "i", "j").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, *, size: int = 5, num: int = 80, den: int = 100, bands: int = 24, rows: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept, for every row of ``docs``.

    Links: ``den * intersection >= num * union`` of the sets of ``size``-word shingles.  Null, empty
    and wordless texts have no shingles and are linked with nothing; very long texts count whole.  A
    null id has no component and is kept.  Repeated rows each get their class's component; rows that
    share an id count as one document with the links of any of them.  An empty table gives an empty
    result.  Other columns, whatever their names, are not read.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    table = stored(sketches(texts, size, bands, rows), "sketches")
    real = table.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(real.groupBy("fp").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands")), "classes")
    small = classes.select("id", "fp", "n")
    placed = classes.select("id", F.explode("bands").alias("bucket"))
    centres = placed.groupBy("bucket").agg(F.min("id").alias("c"), F.count("*").alias("k")).where("k > 1")
    held = stored(placed.join(centres, "bucket"), "buckets")  # members of buckets with company
    sets = stored(_sets(small.join(held.select("id").distinct(), "id"), texts.where(F.col("doc_id").isNotNull()), size), "sets")
    stars = held.where("id != c").select(F.col("c").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(small.toDF("b", "fb", "nb"), "b").join(small.toDF("a", "fa", "na"), "a").where(_may(F.col("na"), F.col("nb"), num, den))
    links = stored(_verified(stars, sets, num, den), "links")
    found = stored(connected_components(links), "components")
    # what stars have left: buckets of three or more whose members are in different components
    # a bucket of k members is dealt into as many parts as hold BLOCK of them each, so a hot one is many keys
    parts = F.ceil(F.col("k") / BLOCK).cast("int")
    named = held.where("k > 2").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = named.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    in_parts = named.groupBy("bucket", "k", "part").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = in_parts.groupBy("bucket", "k").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high")
    mixed = mixed.select("bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    rest = stored(named.join(mixed, ["bucket", "part"]).select("id", "c", "component").distinct(), "rest")
    if not rest.isEmpty():
        families = connected_components(rest.select(F.col("c").alias("u"), F.col("id").alias("v"))).toDF("id", "family")
        members = rest.select("id", "component").distinct().join(families, "id").join(classes.select("id", "fp", "n", "signature"), "id")
        sizes = members.groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
        sizes = sizes.select("family", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        members = members.join(sizes, "family").join(sets, ["id", "fp"])
        extra = _left_over(members, num, den, bands * rows)
        before, found = found, stored(connected_components(links.unionByName(extra)), "components")
        dropped(before)
    for done in (held, sets, links, rest):  # the result reads sketches, classes and components alone
        dropped(done)
    # a class passes its component on; the join's hot side is split by AQE
    named = classes.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    out = table.select("doc_id", "n_shingles", "fp").join(named, "fp", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One document of each group: its smallest id; repeated rows of that id and text count once.

    Rows of that id with other texts all stay.  Of rows with the same id and text, the one whose other
    columns have the smallest hash stays (maps are not hashed).  Documents without words, or without
    an id, all stay; an empty table stays empty.  Columns ``__nd_id``, ``__nd_text`` and ``__nd_nth``
    raise ValueError; all other columns pass, whatever their names.
    """
    if clash := {"__nd_id", "__nd_text", "__nd_nth"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    key, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    verdict = near_duplicates(docs, **options)
    kept = verdict.where("kept AND n_shingles > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__nd_id")).distinct()
    wordless = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.where(~wordless & F.col(key).isNotNull()).join(kept, F.col(key).cast("long") == F.col("__nd_id")).drop("__nd_id")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    order = Window.partitionBy(key, "__nd_text").orderBy(F.xxhash64(*hashed))
    one_each = rows.withColumn("__nd_text", F.xxhash64(text)).withColumn("__nd_nth", F.row_number().over(order)).where("__nd_nth = 1").drop("__nd_text", "__nd_nth")
    return one_each.unionByName(docs.where(wordless | F.col(key).isNull()))


def op9_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, num=85, den=100)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+2], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT sym.b, r.root FROM r JOIN sym ON sym.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id
"""
