"""Admission under a token budget: ordered scans whose decisions depend on earlier ones.

Each group (a query or a session) is a bounded list of candidates, so the scan runs in
``applyInPandas``; groups are spread by key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Recall, Thresholds


def clamp(candidates: DataFrame, budget: int, per_source: int = 3) -> DataFrame:
    """Dispositions in rank order: content_miss, duplicate_source, budget_full, clamped, admitted.

    ``candidates``: query_id, id, source, rank, tokens (null: no body).  The first that does not fit
    is clamped if something was admitted (else it is admitted, whatever its size), and from then on
    the budget is full.  Sources count admitted rows only.
    """
    def scan(group: pd.DataFrame) -> pd.DataFrame:
        used, full, seen, out = 0, False, {}, []
        group = group.sort_values("rank", kind="stable")
        for source, tokens in zip(group["source"], group["tokens"]):
            if pd.isna(tokens):
                out.append("content_miss")
            elif seen.get(source, 0) >= per_source:
                out.append("duplicate_source")
            elif full:
                out.append("budget_full")
            elif used + tokens > budget and used > 0:
                full = True
                out.append("clamped")
            else:
                used += int(tokens)
                seen[source] = seen.get(source, 0) + 1
                out.append("admitted")
        return group[["query_id", "id", "rank"]].assign(disposition=out)

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    kept = candidates.select("query_id", "id", "source", "rank", F.col("tokens").cast("double").alias("tokens"))
    return kept.groupBy("query_id").applyInPandas(scan, f"query_id {kinds['query_id']}, id {kinds['id']}, rank {kinds['rank']}, disposition string")


def schedule(calls: DataFrame, budget: int, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """The greedy scheduler over a session's calls, its remembered scores being its state.

    ``calls``: session, call, role (loaded or candidate), pos, id, tokens, score (candidates').  Loaded
    fragments stay in order if their remembered score (1 at first) is not below ``unload`` and they
    fit; then candidates at or above ``load`` that are not there and fit.  One that does not fit is
    passed over.  Gives session, call, id, decision (keep, admitted, evicted).
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        scores: dict[str, float] = {}
        rows = []
        for call, part in group.sort_values(["call", "pos"], kind="stable").groupby("call", sort=True):
            loaded, candidates = part[part["role"] == "loaded"], part[part["role"] == "candidate"]
            scores |= dict(zip(candidates["id"], candidates["score"]))
            used, chosen = 0, set()
            for i, tokens in zip(loaded["id"], loaded["tokens"]):
                if scores.get(i, 1.0) >= thresholds.unload and used + tokens <= budget:
                    used += tokens
                    chosen.add(i)
                    rows.append((call, i, "keep"))
            for i, tokens, score in zip(candidates["id"], candidates["tokens"], candidates["score"]):
                if score >= thresholds.load and i not in chosen and used + tokens <= budget:
                    used += tokens
                    chosen.add(i)
                    rows.append((call, i, "admitted"))
            rows += [(call, i, "evicted") for i in loaded["id"] if i not in chosen]
        out = pd.DataFrame(rows, columns=["call", "id", "decision"])
        out.insert(0, "session", group["session"].iloc[0])
        return out

    kinds = {f.name: f.dataType.simpleString() for f in calls.schema.fields}
    return calls.groupBy("session").applyInPandas(run, f"session {kinds['session']}, call {kinds['call']}, id {kinds['id']}, decision string")


def load_fragments(candidates: DataFrame, budget: int, recall: Recall = Recall()) -> DataFrame:
    """What a session loads of its candidates: session, id, outcome, score.

    ``candidates``: session, pos, id, source, tokens, score, resident (score of the fragment if it is
    loaded, else null), history and exempt (booleans).  A resident fragment's score may only rise.
    Loading stops at the fragment cap or when the budget is used up; a candidate below ``load``, past
    the history's share, past its source's cap (unless exempt) or too large is passed over.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos", kind="stable")
        there = group[group["resident"].notna()]
        used, past = int(there["tokens"].sum()), int(there.loc[there["history"], "tokens"].sum())
        n, per = len(there), there["source"].value_counts().to_dict()
        out, stopped = [], None
        for r in group.itertuples():
            if not pd.isna(r.resident):
                out.append(("raised" if r.score > r.resident else "resident", max(r.score, r.resident)))
            elif stopped or n >= recall.max_fragments or used >= budget:
                stopped = stopped or ("fragment_cap" if n >= recall.max_fragments else "budget_full")
                out.append((stopped, r.score))
            elif r.score < recall.thresholds.load:
                out.append(("below_load", r.score))
            elif r.history and past + r.tokens > int(budget * recall.history_share):
                out.append(("history_cap", r.score))
            elif not r.exempt and per.get(r.source, 0) >= recall.per_source:
                out.append(("source_cap", r.score))
            elif used + r.tokens > budget:
                out.append(("too_large", r.score))
            else:
                used, n, past = used + r.tokens, n + 1, past + (r.tokens if r.history else 0)
                per[r.source] = per.get(r.source, 0) + 1
                out.append(("loaded", r.score))
        return group[["session", "id"]].assign(outcome=[o for o, _ in out], score=[float(s) for _, s in out])

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    return candidates.groupBy("session").applyInPandas(run, f"session {kinds['session']}, id {kinds['id']}, outcome string, score double")


def evictions(loaded: DataFrame, budget: int, unload: float = Thresholds.unload, latest_only: bool = False, ranges: int = 1024) -> DataFrame:
    """``loaded`` (session, id, tokens, score, mtime) with evicted.

    From the lowest score (then the oldest, with ``latest_only``) fragments go while their score is below
    ``unload`` or what is left is over the budget.  Whoever is kept ends it, so what goes is a
    prefix: a running sum decides, without a loop.  Scores fall into ``ranges`` (of 0 to 1) and the
    ranges' sums say for all but one of a session whether they are before or past the budget; only rows
    of that range are ordered together, all others are dealt by id.  So a session may hold any share of
    all rows.  Null scores come first.
    """
    at = F.when(F.col("score").isNull(), -1).otherwise(F.greatest(F.lit(0), F.least(F.lit(ranges - 1), F.floor(F.col("score") * ranges))).cast("int"))
    rows = loaded.withColumn("__range", at)
    up_to = Window.partitionBy("session").orderBy("__range")
    sums = rows.groupBy("session", "__range").agg(F.sum("tokens").alias("size"))
    sums = sums.withColumn("below", F.sum("size").over(up_to) - F.col("size")).withColumn("total", F.sum("size").over(Window.partitionBy("session")))
    over, under = F.col("total") - F.col("below") - F.col("size") > budget, F.col("total") - F.col("below") <= budget
    plan = sums.select("session", "__range", F.col("below").alias("__below"), F.col("total").alias("__total"), (~over & ~under).alias("__edge"), over.alias("__over"))
    told = rows.join(plan, ["session", "__range"]).withColumn("__deal", F.when(F.col("__edge"), -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int")))
    keys = [F.col("score"), *([F.col("mtime")] if latest_only else []), F.col("id")]
    before = Window.partitionBy("session", "__range", "__deal").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__total") - F.col("__below") - F.coalesce(F.sum("tokens").over(before), F.lit(0))
    out = told.withColumn("__left", left)
    gone = (F.col("score") < unload) | F.when(F.col("__edge"), F.col("__left") > budget).otherwise(F.col("__over"))
    return out.select(*(F.col(f"`{c}`") for c in loaded.columns), gone.alias("evicted"))
