"""Retrieval, answer and classification metrics as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10, 20, 50)


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def rounded(c: Column, digits: int) -> Column:
    """A double as C's ``round(c * 10^digits) / 10^digits`` has it: the product is rounded, not the decimal form, and
    what comes to zero keeps its sign (``F.round`` makes 0.285 0.29 and -0.001 0.0; this 0.28 and -0.0)."""
    n = F.round(c * 10.0**digits)
    return F.when(n == 0, c * 0.0).otherwise(n / 10.0**digits)


def recall_precision(retrieved: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """query_id, hits, recall, precision over the first k (query_id, id, rank against query_id, id).

    Nothing expected: recall 1; nothing retrieved: precision 1.  Retrieved rows count each.
    """
    wanted = expected.select("query_id", "id").distinct().withColumn("hit", F.lit(True))
    met = retrieved.select("query_id", "id", "rank").join(wanted, ["query_id", "id"], "full")  # each is read once
    first, hit = F.col("rank") <= k, F.col("hit")
    known = lambda c: F.when(F.col("query_id").isNotNull(), c).otherwise(F.lit(0))
    out = met.groupBy("query_id").agg(known(F.count(F.when(first, 1))).alias("n"), known(F.count(F.when(first & hit, 1))).alias("hits"), known(F.count_distinct(F.when(hit, F.col("id")))).alias("want"))
    return out.select("query_id", "hits", ratio(F.col("hits"), F.col("want"), 1.0).alias("recall"), ratio(F.col("hits"), F.col("n"), 1.0).alias("precision"))


def path_metrics(loaded: DataFrame, expected: DataFrame, digits: int = 6) -> DataFrame:
    """query_id, recall, stub_recall, relevance, precision_at_1, mrr of loaded paths against expected ones.

    ``loaded``: query_id, path, rank, stub (only its descriptor is there); ``expected``: query_id, path,
    each row counts.  All but ``stub_recall`` are of bodies alone, ranked among themselves.  Paths match if
    they are equal or one ends the other after a slash, so they have their last part in common: that is
    the key they meet by.  Nothing expected: recalls and mrr 1; no bodies: relevance and precision 0.
    """
    from ..functions.text import path_matches

    part = lambda c: F.substring_index(c, "/", -1).alias("part")
    place = F.row_number().over(Window.partitionBy("query_id", "stub").orderBy("rank", "path"))
    have = loaded.select("query_id", "path", "stub", part("path"), place.alias("place"))
    want = expected.groupBy("query_id", F.col("path").alias("want")).agg(F.count("*").alias("times")).select("*", part("want"))
    met = want.join(have, ["query_id", "part"]).where(path_matches(F.col("path"), F.col("want")))
    body = ~F.col("stub")
    found = met.groupBy("query_id", "want").agg(F.min(F.when(body, F.col("place"))).alias("first"))
    recalled = want.join(found.withColumn("any", F.lit(True)), ["query_id", "want"], "left").groupBy("query_id").agg(
        F.sum("times").alias("n"), F.sum(F.when(F.col("first").isNotNull(), F.col("times")).otherwise(0)).alias("bodies"), F.sum(F.when(F.col("any"), F.col("times")).otherwise(0)).alias("some"), F.sum(F.coalesce(F.col("times") / F.col("first"), F.lit(0.0))).alias("reciprocal")
    )
    right = met.where(body).select("query_id", "place").distinct().groupBy("query_id").agg(F.count("*").alias("right"), F.max((F.col("place") == 1).cast("double")).alias("top"))
    count = have.where(body).groupBy("query_id").agg(F.count("*").alias("held"))
    every = loaded.select("query_id").union(expected.select("query_id")).distinct()
    out = every.join(recalled, "query_id", "left").join(right, "query_id", "left").join(count, "query_id", "left")
    share = lambda a, b, empty: F.round(ratio(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)), empty), digits)
    n, held = F.col("n"), F.col("held")
    return out.select("query_id", share(F.col("bodies"), n, 1.0).alias("recall"), share(F.col("some"), n, 1.0).alias("stub_recall"), share(F.col("right"), held, 0.0).alias("relevance"), F.coalesce("top", F.lit(0.0)).alias("precision_at_1"), share(F.col("reciprocal"), n, 1.0).alias("mrr"))


def first_gold(retrieved: DataFrame, gold: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """query_id, gold_rank (null: missed)."""
    found = retrieved.join(gold.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").cast("long").alias("gold_rank"))
    every = (queries if queries is not None else gold).select("query_id").distinct()
    return every.join(found, "query_id", "left")


def rank_report(ranks: DataFrame, by: str | None = None, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Overall (and per ``by``) n, improved, regressed, MRR and recall@k of two rankings.

    ``ranks``: query_id, base, expanded (ranks or null).  Grouping sets give all rows in one pass.
    """
    mrr = lambda c: F.avg(F.coalesce(1 / F.col(c), F.lit(0.0)))
    far = F.lit(2**31)
    better, worse = F.coalesce("expanded", far) < F.coalesce("base", far), F.coalesce("expanded", far) > F.coalesce("base", far)
    made = [F.count("*").alias("n"), F.count(F.when(better, 1)).alias("improved"), F.count(F.when(worse, 1)).alias("regressed"), F.round(mrr("base"), 6).alias("base_mrr"), F.round(mrr("expanded"), 6).alias("expanded_mrr")]
    for k in cuts:
        for c in ("base", "expanded"):
            made.append(F.round(F.avg(F.coalesce((F.col(c) <= k).cast("double"), F.lit(0.0))), 6).alias(f"{c}_recall_{k}"))
    if by is None:
        return ranks.agg(*made)
    return ranks.groupingSets([[], [by]], by).agg(*made)


def rescues(ranks: DataFrame, attribution: DataFrame, cut: int = 10) -> DataFrame:
    """relation, n: gold from outside the first ``cut`` to inside, by the edge that brought it (query_id, relation)."""
    lifted = ranks.where((F.coalesce("base", F.lit(2**31)) > cut) & (F.col("expanded") <= cut))
    return lifted.join(attribution, "query_id", "left").groupBy(F.coalesce("relation", F.lit("none")).alias("relation")).agg(F.count_distinct("query_id").alias("n"))


def false_recall_rate(rows: DataFrame, flagged: str = "flagged", overlap: str = "overlap", least: float = 0.15) -> DataFrame:
    bad = F.col(flagged) | (F.col(overlap) < least)
    return rows.agg(F.coalesce(F.avg(bad.cast("double")), F.lit(0.0)).alias("false_recall_rate"))


def context_efficiency(content: Column, nominal: Column) -> Column:
    return ratio(content, nominal)


def context_share(content: Column, system: Column, question: Column, fragments: Column) -> Column:
    """Content over content and overhead, 15 tokens a fragment."""
    return ratio(content, content + system + question + 15 * fragments)


def thrashing(events: DataFrame, *, within: int = 5, step: float = 0.05, most: int = 4, load: float = 0.7, unload: float = 0.55) -> tuple[DataFrame, DataFrame]:
    """Evictions (session, id, step, held, thrashed), and per session their number, share and suggested thresholds.

    ``events``: session, id, step, kind (load or evict).  An eviction thrashes if the fragment is loaded
    again within ``within`` steps after it; ``held`` is from its latest load not after it.  The range
    join keeps one row an eviction: the nearest loads come from ordered windows.
    """
    ordered = Window.partitionBy("session", "id").orderBy("step", "order")
    told = events.withColumn("order", (F.col("kind") == "evict").cast("int"))
    last = F.last(F.when(F.col("kind") == "load", F.col("step")), ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    later = Window.partitionBy("session", "id").orderBy("step").rangeBetween(1, within)
    again = F.count(F.when(F.col("kind") == "load", 1)).over(later) > 0
    out = told.withColumn("loaded_at", last).withColumn("thrashed", again).where("kind = 'evict'")
    out = out.select("session", "id", "step", (F.col("step") - F.col("loaded_at")).alias("held"), "thrashed")
    n = F.count(F.when(F.col("thrashed"), 1))
    shift = step * F.least(n, F.lit(most))
    sums = out.groupBy("session").agg(F.count("*").alias("evictions"), n.alias("thrashed"), F.avg("held").alias("avg_held"), F.least(F.lit(0.95), F.lit(load) + shift).alias("suggest_load"), F.greatest(F.lit(0.1), F.lit(unload) - shift).alias("suggest_unload"))
    return out, sums


def cooperation(events: DataFrame) -> DataFrame:
    """session, probes_per_turn, annotations_per_turn, useful_share, annotation_quality.

    ``events``: session, seq, kind (turn, probe, annotation, recall), id, matched, summary, content.  A note's
    quality is the word overlap with the latest recall of its stub before it.
    """
    from ..functions.text import jaccard_words

    w = Window.partitionBy("session", "id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = events.withColumn("recalled", F.last(F.when(F.col("kind") == "recall", F.col("content")), ignorenulls=True).over(w))
    quality = F.when(F.col("kind") == "annotation", F.coalesce(jaccard_words(F.col("summary"), F.col("recalled")), F.lit(0.0)))
    count = lambda k: F.count(F.when(F.col("kind") == k, 1))
    out = told.groupBy("session").agg(count("turn").alias("turns"), count("probe").alias("probes"), count("annotation").alias("annotations"), F.count(F.when((F.col("kind") == "probe") & F.col("matched"), 1)).alias("useful"), F.avg(quality).alias("quality"))
    return out.select("session", ratio(F.col("probes"), F.col("turns")).alias("probes_per_turn"), ratio(F.col("annotations"), F.col("turns")).alias("annotations_per_turn"), ratio(F.col("useful"), F.col("probes")).alias("useful_share"), F.coalesce("quality", F.lit(0.0)).alias("annotation_quality"))


def session_counters(events: DataFrame) -> DataFrame:
    """session, recalls, evictions, probes, and the ids of recalls and evictions in order."""
    count = lambda k: F.count(F.when(F.col("kind") == k, 1))
    order = lambda k: F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("seq", "id"))))
    out = events.groupBy("session").agg(count("recall").alias("recalls"), count("evict").alias("evictions"), count("probe").alias("probes"), order("recall").alias("r"), order("evict").alias("e"))
    return out.select("session", "recalls", "evictions", "probes", F.col("r.id").alias("recalled_ids"), F.col("e.id").alias("evicted_ids"))


def mode_summary(results: DataFrame, metrics: list[str], mode: str = "mode", degenerate: str = "degenerate") -> DataFrame:
    """Means of the metrics, degenerate items and items per mode."""
    return results.groupBy(mode).agg(F.count("*").alias("items"), F.count(F.when(F.col(degenerate), 1)).alias("degenerate"), *(F.round(F.avg(m), 6).alias(m) for m in metrics))


def paired_deltas(results: DataFrame, metrics: list[str], on: str, off: str, item: str = "item", mode: str = "mode", digits: int = 6) -> DataFrame:
    """metric, n, mean, sd, se, wins, ties, losses of ``on`` minus ``off`` over items that have both.

    One aggregation by item pairs the modes; no join.
    """
    both = results.where(F.col(mode).isin(on, off)).groupBy(item).agg(*(F.max(F.when(F.col(mode) == m, F.col(c).cast("double"))).alias(f"{c}__{t}") for c in metrics for m, t in ((on, "on"), (off, "off"))))
    long = both.select(item, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), (F.col(f"{c}__on") - F.col(f"{c}__off")).alias("d")) for c in metrics))).alias("x")).select(item, "x.metric", "x.d").where("d IS NOT NULL")
    sd = F.coalesce(F.stddev_samp("d"), F.lit(0.0))
    n = F.count("*")
    made = [n.alias("n"), F.round(F.avg("d"), digits).alias("mean"), F.round(sd, digits).alias("sd"), F.round(sd / F.sqrt(n), digits).alias("se")]
    made += [F.count(F.when(c, 1)).alias(a) for c, a in ((F.col("d") > 0, "wins"), (F.col("d") == 0, "ties"), (F.col("d") < 0, "losses"))]
    return long.groupBy("metric").agg(*made)


def answer_score(answer: Column, needle: Column, judged: Column, degenerate: Column) -> Column:
    """1 if the needle is in the answer (in any case), else the judge's score, else 0; 0 for degenerate answers."""
    has = needle.isNotNull() & F.contains(F.lower(answer), F.lower(needle))
    return F.when(degenerate, 0.0).when(has, 1.0).otherwise(F.coalesce(judged, F.lit(0.0)))


def rejudged(results: DataFrame) -> DataFrame:
    return results.where(F.coalesce(F.col("reference_answer"), F.lit("")) != "")


def confusion(pairs: DataFrame, by: list[str], predicted: str = "predicted", actual: str = "actual", digits: int = 6) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1, accuracy; an absent value is false."""
    p, a = F.coalesce(F.col(predicted), F.lit(False)), F.coalesce(F.col(actual), F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    out = pairs.groupBy(*by).agg(n(p & a).alias("tp"), n(p & ~a).alias("fp"), n(~p & ~a).alias("tn"), n(~p & a).alias("fn"))
    return with_scores(out, digits)


def with_scores(counts: DataFrame, digits: int = 6) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    out = counts.withColumn("precision", F.round(precision, digits)).withColumn("recall", F.round(recall, digits))
    return out.withColumn("f1", F.round(ratio(2 * precision * recall, precision + recall), digits)).withColumn("accuracy", F.round(ratio(tp + tn, tp + fp + tn + fn), digits))


def micro(counts: DataFrame, by: list[str]) -> DataFrame:
    return with_scores(counts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn"))))


def unpivoted_flags(cases: DataFrame, ids: list[str], flags: list[str], predicted: str, actual: str) -> DataFrame:
    """A row a flag of two structs: ids, field, predicted, actual."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{predicted}.{f}").alias("predicted"), F.col(f"{actual}.{f}").alias("actual")) for f in flags))
    return cases.select(*ids, F.explode(each).alias("x")).select(*ids, "x.*")


def tag_rates(cases: DataFrame, model: str = "model", tags: str = "tags", exact: str = "exact") -> DataFrame:
    """model, tag, n, exact_rate, and whether it is a winner of the tag (ties all are)."""
    out = cases.select(model, F.explode(tags).alias("tag"), exact).groupBy(model, "tag").agg(F.count("*").alias("n"), F.avg(F.col(exact).cast("double")).alias("exact_rate"))
    return out.withColumn("winner", F.col("exact_rate") == F.max("exact_rate").over(Window.partitionBy("tag")))


def model_ranking(models: DataFrame) -> DataFrame:
    """``models`` (model, f1, failures) with rank: F1 down, failures up, name up, nulls last; one row a model."""
    return models.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("f1"), F.asc_nulls_last("failures"), F.asc_nulls_last("model"))))


def f_beta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    b = beta * beta
    return F.when(precision.isNotNull() & recall.isNotNull(), ratio((1 + b) * precision * recall, b * precision + recall))


def model_selection(runs: DataFrame, least_runs: int = 1) -> DataFrame:
    """model, runs, quality: mean F0.5 less its parse failures; without precision, 0.6 of the mean and 0.4 of the least score."""
    f = F.avg(f_beta(F.col("precision"), F.col("recall")))
    fallback = 0.6 * F.avg("score") + 0.4 * F.min("score")
    out = runs.groupBy("model").agg(F.count("*").alias("runs"), (F.coalesce(f, fallback) * (1 - F.avg(F.coalesce("parse_failure", F.lit(0.0))))).alias("quality"))
    return out.where(F.col("runs") >= least_runs)


def weighted_answer_score(runs: DataFrame, mode: str = "recall_on") -> DataFrame:
    return runs.where(F.col("mode") == mode).groupBy("model").agg((F.sum(F.col("answer_score") * F.col("items")) / F.sum("items")).alias("answer_score"))


def cooperation_advice(gain: Column, probes: Column, useful: Column) -> Column:
    """What the probe statistics say, by three thresholds."""
    return F.when((gain >= 0.03) & (useful >= 0.5), "enable").when((gain < -0.03) | ((probes >= 0.4) & (useful < 0.5)), "disable").otherwise("inconclusive")


def parameter_grid(axes: list[tuple[str, DataFrame]], finished: DataFrame | None = None) -> DataFrame:
    """cell, params of every combination of the axes' values (each one column, ``value``); later axes win.

    A cross join of parameter values, not of data.  ``cell`` is the first 16 hex digits of the
    SHA-256 of the sorted parameters; finished cells are left out.
    """
    latest = dict(axes)
    out = None
    for name, values in sorted(latest.items()):
        side = values.select(F.col("value").cast("string").alias(name))
        out = side if out is None else out.crossJoin(side)
    params = F.create_map(*(x for n in sorted(latest) for x in (F.lit(n), F.col(n))))
    out = out.select(F.substring(F.sha2(F.to_json(params), 256), 1, 16).alias("cell"), params.alias("params"))
    return out.join(finished.select("cell"), "cell", "left_anti") if finished is not None else out


def phase_split(total: Column, generation: Column, judge: Column) -> Column:
    return F.struct(generation.alias("generation"), judge.alias("judge"), F.greatest(total - generation - judge, F.lit(0.0)).alias("other"))


def second_moments(vectors: DataFrame, vector: str, dimension: int):
    """Number, sum and sum of outer products of the vectors, as numpy arrays.

    Every task sums its batches' X'X; its one sum is what is shuffled, cell by cell, and the driver
    gets d * d + d + 1 numbers, whatever the number of rows or tasks.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        n, sums, products = 0, np.zeros(dimension), np.zeros((dimension, dimension))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimension)
            n, sums, products = n + len(x), sums + x.sum(axis=0), products + x.T @ x
        yield pa.record_batch([pa.array([np.concatenate([[n], sums, products.ravel()])])], names=["s"])

    held = vectors.where(F.size(vector) == dimension).select(F.col(vector).cast("array<double>").alias("v"))
    cells = held.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    flat = np.zeros(1 + dimension + dimension**2)
    for r in cells.collect():
        flat[r["i"]] = r["x"]
    return flat[0], flat[1 : dimension + 1], flat[dimension + 1 :].reshape(dimension, dimension)


def whitened(vectors: DataFrame, components: int, ident: str = "id", vector: str = "vector") -> DataFrame:
    """Vectors without their mean and their first principal components, normalized again.

    Null vectors are left out; an empty table gives an empty result.
    """
    import numpy as np

    kept = vectors.where(F.col(vector).isNotNull())
    schema = f"{ident} {vectors.schema[ident].dataType.simpleString()}, vector array<double>"
    first = kept.select(F.size(vector)).first()
    if first is None:
        return kept.select(ident, F.col(vector).cast("array<double>").alias("vector"))
    n, sums, products = second_moments(kept, vector, first[0])
    mean = sums / n
    top = np.linalg.eigh(products / n - np.outer(mean, mean))[1][:, ::-1][:, :components]

    def run(batches):
        for pdf in batches:
            m = np.stack(pdf["v"].to_numpy()) - mean
            m = m - (m @ top) @ top.T
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            yield pdf[[ident]].assign(vector=list(m / np.where(norm > 0, norm, 1)))

    return kept.select(F.col(ident), F.col(vector).cast("array<double>").alias("v")).mapInPandas(run, schema)


def diagnose_misses(misses: DataFrame, cutoff: int = 10) -> Column:
    """Why a gold was missed, from status, cosine_rank, bm25_rank, overlap, summary_len.  The reasons are fixed texts."""
    found = lambda c: F.coalesce(F.col(c) <= cutoff, F.lit(False))
    status = F.col("status")
    return (
        F.when(status == "stale", "gold stub withheld: flagged stale=1").when(status == "missing", "gold stub absent from index").when(status == "unreadable", "gold stub read error").when(status == "empty", "empty indexed content (ingestion gap)")
        .when((F.col("summary_len") < 15) & (F.col("overlap") == 0), "thin stub + register dead-end")
        .when(found("cosine_rank") & found("bm25_rank"), "both halves found it — fusion drowned it")
        .when(found("bm25_rank"), "BM25 found it — cosine + fusion buried it")
        .when(found("cosine_rank"), "cosine found it — BM25 + fusion buried it")
        .when(F.col("overlap") == 0, "register dead-end (no shared tokens)")
        .otherwise("findable but buried (ranking/scoring)")
    )
