"""What came from where: topic terms and overlaps between sources."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TOPIC_OVERLAP, TOPIC_TERMS
from ..functions.text import STOPWORDS
from ..storage import stored

#: Classes in a block: at most, and at least where more blocks only feed more cores; pairs in a batch.
BLOCK, LEAST_BLOCK, PAIR_BATCH = 65_536, 1024, 32_768
PAIR = ["id_a", "id_b", "source_a", "source_b", "copies_a", "copies_b", "shared", "overlap"]


def topic_terms(fragments: DataFrame, most: int = TOPIC_TERMS, ident: str = "id", text: str = "content") -> DataFrame:
    """id, term, n, rank: the most frequent terms of each, ties by term."""
    # exploded first: the tests of the terms are generated code then
    parts = fragments.select(F.col(ident).alias("id"), F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")).alias("term"))
    counted = parts.where((F.octet_length("term") > 2) & ~F.col("term").isin(*STOPWORDS)).groupBy("id", "term").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "term"))).where(F.col("rank") <= most)


def pair_finder(least: float, digits: int, joint: str | None = None):
    """What a task does with two blocks of classes, or one with itself: batches of the pairs that share enough.

    The second block's postings are held; each class of the first marks in a row of bits which of its terms
    every held class has.  Memory is a block's, whatever the number of pairs.  A class's pairs are told by
    what they share, so that equal and similar texts lie side by side: files of pairs are smaller then.
    """

    def value(shared: int, size: int) -> float:  # as Spark rounds: the shortest decimal form, half up
        return float(Decimal(repr(shared / size)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))

    def found(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        rank = np.unique(t["id"].to_numpy(), return_inverse=True)[1]
        order = np.lexsort((rank, t["block"].to_numpy()))
        t, rank, block = t.take(order), rank[order], t["block"].to_numpy()[order]
        itself = t["other"][0].as_py() == block[0]
        if not itself and block[0] == block[-1]:
            return  # the other block is empty
        asking = len(block) if itself else int(np.searchsorted(block, block[-1]))
        first = 0 if itself else asking
        sets = t["s"].combine_chunks()
        terms = sets.flatten().dictionary_encode()
        at, code = sets.offsets.to_numpy(), terms.indices.to_numpy()
        size = np.diff(at)
        kin = t["kin"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        held_code = code[at[first] :]
        by = np.argsort(held_code, kind="stable")
        posting = np.repeat(np.arange(len(size) - first), size[first:])[by]
        start = np.searchsorted(held_code[by], np.arange(len(terms.dictionary) + 1))
        never = int(size.max()) + 1
        need = np.array([next((c for c in range(max(1, int(k * least)), k + 1) if value(c, k) > least), never) for k in range(never)])
        need = need.astype(np.uint8 if never < 256 else np.int32)
        needs = {n: need[np.minimum(size[first:], n)] for n in np.unique(size[:asking]).tolist()[-64:]}
        marks = np.zeros((-(-(never - 1) // 32), len(size) - first), np.uint32)

        def batch(asked, told, bits):
            asked, told, bits = np.concatenate(asked), np.concatenate(told), np.concatenate(bits, axis=1)
            n, swap = np.bitwise_count(bits).sum(axis=0, dtype=np.int64), rank[asked] > rank[told]
            order = np.lexsort((told, *bits[::-1], n, swap, asked))
            asked, told, bits, n, swap = asked[order], told[order], bits[:, order], n[order], swap[order]
            fresh = np.concatenate([[True], (asked[1:] != asked[:-1]) | (bits[:, 1:] != bits[:, :-1]).any(axis=0)])  # each text is made once
            row, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(bits[:, fresh].T).astype(">u4").view(np.uint8), axis=1))
            words = terms.dictionary.take(pa.array(code[at[asked[fresh][row]] + bit]))
            shared = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[fresh])]), pa.int32()), words)
            cases, which = np.unique(n * never + np.minimum(size[asked], size[told]), return_inverse=True)
            a, b = pa.array(np.where(swap, told, asked)), pa.array(np.where(swap, asked, told))
            columns = [t[c].take(x).combine_chunks() for c in ("id", "source", "copies") for x in (a, b)]
            columns.append((shared if joint is None else pc.binary_join(shared, joint)).take(pa.array(np.cumsum(fresh) - 1)))
            columns.append(pa.array(np.array([value(*divmod(c, never)) for c in cases.tolist()])[which]))
            return pa.RecordBatch.from_arrays(columns, PAIR)

        parts, rows = ([], [], []), 0
        for q in range(asking):
            mine = code[at[q] : at[q + 1]].tolist()
            marks[:] = 0
            for p, c in enumerate(mine):
                if p and c == mine[p - 1]:
                    continue
                has = posting[start[c] : start[c + 1]]
                if itself:
                    has = has[np.searchsorted(has, q + 1) :]
                marks[p >> 5][has] |= np.uint32(1 << 31 >> (p & 31))
            n = np.bitwise_count(marks[0]) if len(marks) == 1 else np.bitwise_count(marks).sum(axis=0)
            least_of = needs[len(mine)] if len(mine) in needs else need[np.minimum(size[first:], len(mine))]
            near = np.flatnonzero(n >= least_of)
            told = near + first
            right = (rank[told] != rank[q]) & ((kin[told] != kin[q]) | (kin[q] < 0))
            near, told = near[right], told[right]
            if len(near):
                for part, x in zip(parts, (np.full(len(near), q), told, marks[:, near]), strict=True):
                    part.append(x)
                rows += len(near)
            if rows >= PAIR_BATCH:
                yield batch(*parts)
                parts, rows = ([], [], []), 0
        if rows:
            yield batch(*parts)

    return found


def topic_overlaps(terms: DataFrame, sources: DataFrame, least: float = TOPIC_OVERLAP, digits: int = 6, *, joint: str | None = None, blocks: int | None = None) -> DataFrame:
    """Pairs a < b of different sources that share more than ``least`` of the smaller term set: shared, overlap.

    ``terms``: id, term; ``sources``: id, source.  Fragments of one source with the same terms are one
    class, named by its smallest id: ``copies_a`` and ``copies_b`` say how many it has, and no pairs are
    made within it.  The classes are written once and dealt into blocks; a task takes two blocks (or one
    with itself) and tells their pairs.  Pairs are told as they are found: they are never shuffled, sorted
    or held, so disk is the classes' alone, once a block.  Their number can grow with the square of the
    classes' all the same.  No pair of classes is lost.
    ``joint`` joins the shared terms to a string.
    """
    rows = terms.select("id", "term").join(sources, "id")
    sets = rows.groupBy("id", "source").agg(F.array_sort(F.collect_list("term")).alias("s"))
    made = sets.groupBy("source", "s").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    # an id of several sources differs from any (no kin), one without a source from none
    lo, hi = (f("source").over(Window.partitionBy("id")) for f in (F.min, F.max))
    classes = stored(made.withColumn("lo", lo).withColumn("kin", F.when(F.col("lo") == hi, F.col("lo"))).where("lo IS NOT NULL").drop("lo"), "topic-sets")
    if blocks is None:
        n, cores = classes.count(), terms.sparkSession.sparkContext.defaultParallelism
        blocks = max(1, -(-n // BLOCK), min(-(-n // LEAST_BLOCK), math.ceil(math.sqrt(8 * cores))))
    dealt = classes.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    tasks = dealt.repartitionById(blocks * (blocks + 1) // 2, (high * (high + 1) / 2).cast("int") + low)
    kind, of = (classes.schema[c].dataType.simpleString() for c in ("id", "source"))
    schema = f"id_a {kind}, id_b {kind}, source_a {of}, source_b {of}, copies_a long, copies_b long, shared {'array<string>' if joint is None else 'string'}, overlap double"
    return tasks.mapInArrow(pair_finder(least, digits, joint), schema)


def overlap_warning(path_a: Column, path_b: Column, shared: Column, overlap: Column) -> Column:
    return F.format_string("- '%s' and '%s' share terms [%s] (%.0f%% overlap)", path_a, path_b, F.array_join(shared, ", "), F.bround(overlap * 100, 0))


def record(ledger: DataFrame, fragments: DataFrame) -> DataFrame:
    """The ledger with new fragments and their terms (line references too)."""
    terms = topic_terms(fragments).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("t"))
    return ledger.unionByName(fragments.join(terms, "id", "left").withColumn("terms", F.coalesce(F.col("t.term"), F.array().cast("array<string>"))).drop("t"), allowMissingColumns=True)
