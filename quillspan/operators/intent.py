"""Query intents: parsing, guidance, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.protocol import json_object
from ..functions.text import bound

#: Flags of an intent.  Fixed values, in order.
FLAGS = (
    "is_inventory_request", "is_results_request", "is_status_request", "is_next_step_request", "wants_exact_names_or_paths", "wants_numeric_values", "wants_latest_run_only",
    "wants_comparison", "wants_explanation", "wants_completion_state", "wants_recommended_actions", "needs_grounded_evidence_only", "abstain",
)
#: Verbs that a key may begin with.  Fixed values.
VERBS = ("wants_", "want_", "needs_", "need_", "requires_", "require_", "are_", "is_")
SIGNALS = (*FLAGS[:4], "wants_latest_run_only", "wants_explanation")
#: A line of guidance per flag.  Fixed text.
GUIDANCE = {
    "is_inventory_request": "For inventory-style questions, list exact names or paths present in recalled evidence before summarizing.",
    "is_results_request": "For result-oriented questions, report only metrics and values explicitly present in recalled evidence.",
    "is_status_request": "For status questions, distinguish clearly between completed, pending, and unknown work based on recalled evidence.",
    "is_next_step_request": "For next-step questions, recommend concrete next actions grounded in recalled evidence rather than generic advice.",
    "wants_exact_names_or_paths": "Prefer precise artifact names, file names, and paths over paraphrases.",
    "wants_numeric_values": "Prefer exact numeric values and units when they are available in recalled evidence.",
    "wants_latest_run_only": "If multiple runs are present, prioritize the newest clearly identified run or timestamped artifact.",
    "wants_comparison": "Keep compared artifacts separate and label each metric or claim with the corresponding artifact.",
    "wants_explanation": "Separate direct evidence from inference when explaining causes or tradeoffs.",
    "wants_completion_state": "State explicitly whether each relevant task or artifact is completed, still pending, or not evidenced; if completion cannot be determined, say what evidence is needed to decide it.",
    "wants_recommended_actions": "When recommending next actions, tie each action to recalled evidence; if evidence is insufficient, say what planning or status evidence is needed before recommending a next step.",
    "needs_grounded_evidence_only": "If recalled context lacks direct evidence, do not guess; state what evidence, artifact, or file is needed to fulfill the request.",
}


def key_core(key: Column) -> Column:
    """A key without its verb and a final ``_request``, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(key), "^(" + "|".join(VERBS) + ")", ""), "_request$", "")


def parse_intent(raw: Column) -> Column:
    """Struct of flags, confidence, extra (other keys, as JSON text) and keys; null without a JSON object.

    A key whose core equals a flag's sets that flag, so ``is_explanation`` counts as ``wants_explanation``.
    """
    return bound(F.from_json(json_object(raw), "map<string,string>"), _intent)


def _intent(values: Column) -> Column:
    entries = F.transform(F.map_entries(values), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), key_core(e["key"]).alias("core")))
    known = F.array(*(key_core(F.lit(f)) for f in FLAGS))

    def made(entries: Column) -> Column:
        return bound(F.transform(F.filter(entries, lambda e: e["value"] == "true"), lambda e: e["core"]), lambda true: told(entries, true))

    def told(entries: Column, true: Column) -> Column:
        flag = lambda name: F.array_contains(true, key_core(F.lit(name)))
        other = F.filter(entries, lambda e: ~(F.array_contains(known, e["core"]) & e["value"].isin("true", "false")) & (e["key"] != "confidence"))
        extra = F.map_from_entries(F.transform(other, lambda e: F.struct(e["key"], e["value"])))
        confidence = F.try_element_at(values, F.lit("confidence")).try_cast("double")
        clamped = F.when(F.isnan(confidence), 0.0).when(confidence.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)))
        return F.when(values.isNotNull(), F.struct(*(flag(f).alias(f) for f in FLAGS), clamped.alias("confidence"), extra.alias("extra"), F.map_keys(values).alias("keys")))

    return bound(entries, made)


def guidance(intent: Column) -> Column:
    """Lines for the answer model; none when the intent abstains."""
    fixed = F.filter(F.array(*(F.when(intent[f], F.lit(t)) for f, t in GUIDANCE.items())), lambda x: x.isNotNull())
    entries = F.array_sort(F.map_entries(F.coalesce(intent["extra"], F.create_map().cast("map<string,string>"))))
    more = F.transform(entries, lambda e: F.when(e["value"] == "true", F.concat(F.lit("Additional context: "), F.replace(e["key"], F.lit("_"), F.lit(" ")), F.lit("."))).when(~e["value"].isin("false", "", "null") & ~e["value"].rlike(r"^[\d\[{-]"), e["value"]))
    return F.when(intent["abstain"], F.array().cast("array<string>")).otherwise(F.concat(fixed, F.filter(more, lambda x: x.isNotNull())))


def actionable(intent: Column, least: float) -> Column:
    return ~intent["abstain"] & (F.coalesce(intent["confidence"], F.lit(1.0)) >= least)


def substantive(intent: Column) -> Column:
    out = F.lit(False)
    for f in FLAGS[:-1]:
        out = out | intent[f]
    return out


def signals(intent: Column) -> Column:
    """Struct of what says which context to load, with hints (other keys that are true)."""
    hints = F.map_keys(F.map_filter(intent["extra"], lambda k, v: v == "true"))
    return F.struct(*(intent[f].alias(f) for f in SIGNALS), F.array_sort(hints).alias("extra_hints"))


def no_signals(found: Column) -> Column:
    out = F.size(found["extra_hints"]) == 0
    for f in SIGNALS:
        out = out & ~found[f]
    return out


def majority_vote(votes: DataFrame, key: str = "case", intent: str = "intent") -> DataFrame:
    """``key``, intent: flags that more than half of the votes set, the mean confidence; a sole vote stays as it is.

    Each vote is read once: it gives a row of its own and one for each of its hints, and both are counted
    together, before the shuffle; a case is one row a hint from then on.
    """
    hints = F.map_keys(F.map_filter(F.coalesce(F.col(f"{intent}.extra"), F.create_map().cast("map<string,string>")), lambda k, v: v == "true"))
    rows = votes.select(key, *(F.col(f"{intent}.{f}").cast("int").alias(f) for f in FLAGS), F.col(f"{intent}.confidence").alias("confidence"), F.explode(F.concat(F.array(F.lit(None).cast("string")), hints)).alias("hint"))
    counted = rows.groupBy(key, "hint").agg(*(F.sum(f).alias(f) for f in FLAGS), F.avg("confidence").alias("confidence"), F.count("*").alias("n"))
    own = F.col("hint").isNull()
    n = F.max(F.when(own, F.col("n")))
    flag = lambda f: F.max(F.when(own, F.col(f))) >= F.floor(n / 2) + 1
    told = F.collect_list(F.when(~own, F.struct("hint", "n")))
    out = counted.groupBy(key).agg(*(flag(f).alias(f) for f in FLAGS), F.max(F.when(own, F.col("confidence"))).alias("confidence"), n.alias("votes"), told.alias("told"))
    agreed = F.filter("told", lambda h: h["n"] >= F.floor(F.col("votes") / 2) + 1)
    return out.withColumn("hints", F.array_sort(F.transform(agreed, lambda h: h["hint"]))).drop("told")


def ensemble(votes: DataFrame, models: DataFrame, top: int, case: str = "case") -> DataFrame:
    """The majority vote of the ``top`` models by F1 (model, f1, failures)."""
    from .evaluation import model_ranking

    best = model_ranking(models).where(F.col("rank") <= top).select("model")
    return majority_vote(votes.join(best, "model", "left_semi"), case)
