"""A session's workspace: decay, refresh, upgrade, notes, health, and the turn loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Recall
from ..functions.protocol import trimmed
from ..functions.text import bound, clipped, overlap_topics, words

#: Phrases of an answer that has none.  Fixed values, in lower case so that they can match.
HEDGES = ("no specific information", "no information available", "no information provided", "i don't have", "i cannot find", "there is no information", "there is no specific")
#: Wording of a note's head.  Fixed text.
NOTES_HEAD = "[Prior session notes for this source:\n"


def decayed(score: Column, steps: Column | int, rate: float = 0.8) -> Column:
    return score * F.pow(F.lit(rate), F.lit(steps) if isinstance(steps, int) else steps)


def refreshed(score: Column, context: Column, content: Column, margin: float = 0.2) -> Column:
    """The overlap of context and content, if it is more than ``margin`` above the score."""
    now = overlap_topics(context, content)
    return F.when(now > score + margin, now).otherwise(score)


def eviction_note(score: Column, query: Column, source: Column, content: Column) -> Column:
    return F.format_string("Evicted (relevance decayed to %.2f) during query about '%s'. Source: %s. Topic: %s", score, clipped(query, 100), source, clipped(trimmed(content), 120))


def with_notes(content: Column, notes: Column) -> Column:
    """The last two notes before the content; older ones are counted."""
    older = F.greatest(F.size(notes) - 2, F.lit(0))
    lines = F.transform(F.slice(notes, F.greatest(F.size(notes) - 1, F.lit(1)), 2), lambda n: F.concat(F.lit("- "), n))
    more = F.when(older > 0, F.concat(F.lit("\n("), older.cast("string"), F.lit(" older eviction(s) omitted)"))).otherwise("")
    return F.when(F.size(notes) > 0, F.concat(F.lit(NOTES_HEAD), F.array_join(lines, "\n"), more, F.lit("\n]\n\n"), content)).otherwise(content)


def without_notes(content: Column) -> Column:
    end = F.instr(content, "]\n\n")
    return F.when(F.startswith(content, F.lit(NOTES_HEAD)) & (end > 0), F.substring(content, end + 3, F.length(content))).otherwise(content)


def upgraded(body: Column, tokens: Column, source: Column, recall: Recall = Recall()) -> Column:
    """A stub's body; of long ones the beginning and how to get the rest."""
    hint = F.concat(F.lit("\n… [truncated: "), tokens.cast("string"), F.lit(" tokens; ask for a range of "), source, F.lit("]"))
    return F.when(tokens > recall.upgrade_stub_tokens, F.concat(F.substring(body, 1, recall.upgrade_chars), hint)).otherwise(body)


def answer_quality(answer: Column) -> Column:
    """Words, times 0.3 for answers that hedge."""
    low, hedges = F.lower(answer), F.lit(False)
    for h in HEDGES:
        hedges = hedges | F.contains(low, F.lit(h))
    return F.size(words(answer)) * F.when(hedges, 0.3).otherwise(1.0)


def compress_answer(text: Column, most: int = 300) -> Column:
    """Whole sentences within the limit and an ellipsis; cut at a character, never inside one."""
    head = F.substring(text, 1, most - 1)
    sentence = F.regexp_extract(head, r"(?s)^(.*\.) ", 1)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.when(sentence != "", sentence).otherwise(head), r"\s+$", ""), F.lit("…")))


def tail_windows(text: Column, size: int = 192, every: int = 32) -> Column:
    """Queries of passive injection: after each ``every`` tokens, the last ``size`` of them."""

    def windows(w: Column) -> Column:
        ends = F.when(F.size(w) >= every, F.sequence(F.lit(every), F.size(w), F.lit(every))).otherwise(F.array().cast("array<int>"))
        return F.transform(ends, lambda e: F.array_join(F.slice(w, F.greatest(e - size + 1, F.lit(1)), F.least(e, F.lit(size))), " "))

    return bound(words(text), windows)


#: Health states, from best to worst.
HEALTHY, DEGRADED, DOWN = "Healthy", "Degraded", "Down"


def health_step(state: dict, ok: bool, latency_ms: float, latency_limit: float = 5000.0) -> dict:
    """The next state of a component after one call.

    Latency over the limit, or an error rate over 0.3 in ten calls or more, degrades; a rate over 0.6
    and a failed last call bring it down; five successes in a row bring it up by one.
    """
    calls, errors = state["calls"] + 1, state["errors"] + (not ok)
    row, health = (state["row"] + 1 if ok else 0), state["health"]
    rate = errors / calls
    if health != DOWN and calls >= 10 and rate > 0.6 and not ok:
        health = DOWN
    elif health == HEALTHY and (latency_ms > latency_limit or (calls >= 10 and rate > 0.3)):
        health, row = DEGRADED, 0
    elif row >= 5 and health != HEALTHY:
        health, row, calls, errors = (DEGRADED if health == DOWN else HEALTHY), 0, 0, 0
    return {"calls": calls, "errors": errors, "row": row, "health": health}


START = {"calls": 0, "errors": 0, "row": 0, "health": HEALTHY}


def health_history(calls: DataFrame, latency_limit: float = 5000.0) -> DataFrame:
    """component, seq, health after every call (component, seq, ok, latency_ms).

    A state machine whose state holds running counts, so a component's calls are read in order by one
    task.  They stream through it in Arrow batches with one small state: a component of any length
    needs no more memory than a batch.
    """
    import pyarrow as pa

    schema = f"component {calls.schema['component'].dataType.simpleString()}, seq {calls.schema['seq'].dataType.simpleString()}, health string"

    def run(batches):
        at, state = object(), dict(START)
        for batch in batches:
            out = []
            for component, ok, ms in zip(*(batch.column(c).to_pylist() for c in ("component", "ok", "latency_ms"))):
                if component != at:
                    at, state = component, dict(START)
                state = health_step(state, bool(ok), float(ms or 0.0), latency_limit)
                out.append(state["health"])
            yield pa.record_batch([batch.column("component"), batch.column("seq"), pa.array(out, pa.string())], names=["component", "seq", "health"])

    return calls.select("component", "seq", "ok", "latency_ms").repartition("component").sortWithinPartitions("component", "seq").mapInArrow(run, schema)


def effective_tier(summary: Column, embedding: Column, throttled: Column) -> Column:
    return F.when(summary == DOWN, "PassThrough").when((embedding != HEALTHY) | throttled, "StubsAndToolsOnly").otherwise("FullRecall")


def probe_rate(events: DataFrame, *, user: str = "user_id", seconds: str = "seconds", tie: str = "event_id", window: int = 60, limit: int = 10) -> DataFrame:
    """``events`` with in_window (probes up to and with this one) and throttled.

    Those over ``window`` seconds old no longer count.  A RANGE frame would count later ones of the
    same second too, so what has expired is taken from the running number.
    """
    w = Window.partitionBy(user)
    number = F.row_number().over(w.orderBy(seconds, tie))
    expired = F.count("*").over(w.orderBy(seconds).rangeBetween(Window.unboundedPreceding, -window - 1))
    return events.withColumn("in_window", number - expired).withColumn("throttled", F.col("in_window") >= limit)


def with_history(retrieve: Callable[[list[str]], DataFrame], search: Callable[[list[str]], DataFrame]) -> Callable[[list[str]], DataFrame]:
    """``retrieve`` with what ``search`` finds in earlier sessions (:func:`..sources.records.session_stubs`) among it, best first."""
    return lambda texts: retrieve(texts).unionByName(search(texts), allowMissingColumns=True).orderBy(F.desc("score"), "id")


def named(source: str, path: str) -> bool:
    """Whether a source is what a reference names: one ends the other."""
    source = source.removeprefix("./")
    return source.endswith(path) or path.endswith(source)


def run_turn(question: str, retrieve: Callable[[list[str]], DataFrame], complete: Callable[[str, list[dict]], str], *, budget: int, recall: Recall = Recall(), quality: Callable[[str], float] = lambda a: float(len(a.split())), read_range: Callable[[str, int, int], dict | None] | None = None) -> dict:
    """One conversational turn: retrieve, answer, then up to ``max_passes`` refinements; the best answer is kept.

    ``retrieve`` takes query texts and gives id, source, tokens, score, content, best first; each pass
    asks it once for all its probes and thinking steps.  ``complete`` is the injected model.  With
    ``read_range`` (id, first, last line: tokens and content, or None), lines that an answer refers to
    (``file.ext:3-9``) are loaded too: of a resident stub in its place, else of what is found for the
    path.  Fragments of earlier sessions take ``history_share`` of the budget at most and have no source
    cap.  The driver holds one session's workspace alone: at most ``max_fragments`` rows.
    """
    import re

    from ..functions.protocol import LINE_REFERENCE
    from ..sources.records import HISTORY

    loaded: dict[str, dict] = {}
    trace: list[dict] = []
    used = lambda: sum(f["tokens"] for f in loaded.values())

    def load(texts: list[str]) -> int:
        new = 0
        per: dict[str, int] = {}
        for f in loaded.values():
            per[f["source"]] = per.get(f["source"], 0) + 1
        past = sum(f["tokens"] for f in loaded.values() if f["source"] == HISTORY)
        for r in retrieve(texts).limit(recall.max_candidates).collect():
            old = r["source"] == HISTORY
            fits = past + r["tokens"] <= int(budget * recall.history_share) if old else per.get(r["source"], 0) < recall.per_source
            if r["id"] in loaded:
                loaded[r["id"]]["score"] = max(loaded[r["id"]]["score"], r["score"])
            elif len(loaded) < recall.max_fragments and r["score"] >= recall.thresholds.load and fits and used() + r["tokens"] <= budget:
                loaded[r["id"]] = r.asDict()
                per[r["source"]] = per.get(r["source"], 0) + 1
                past += r["tokens"] if old else 0
                new += r["tokens"]
        return new

    def load_lines(answer: str) -> int:
        new = 0
        for path, first, last in re.findall(LINE_REFERENCE, answer) if read_range else ():
            first, last = int(first), max(int(first), int(last or first))
            there = next((f for f in loaded.values() if named(f["source"], path)), None)
            if there and there.get("locator") != "stub":
                continue  # its body is there
            if not there and len(loaded) >= recall.max_fragments:
                break
            hit = there or next((r.asDict() for r in retrieve([path]).limit(5).collect() if named(r["source"], path)), None)
            part = read_range(hit["id"], first, last) if hit else None
            if part and used() - (there["tokens"] if there else 0) + part["tokens"] <= budget:
                new += part["tokens"]
                loaded[hit["id"]] = {**hit, **part, "locator": f"{first}-{last}" if last > first else str(first), "score": max(hit["score"], recall.thresholds.load)}
        return new

    load([question])
    answer = complete(question, list(loaded.values()))
    best = (quality(answer), answer)
    for step in range(recall.max_passes):
        for f in loaded.values():
            f["score"] *= recall.decay
        queries = re.findall(r"<probe>(.*?)</probe>", answer) + [s for s in re.findall(r"(?s)<think>(.*?)</think>", answer) if len(s.encode()) >= 20]
        new = (load(queries) if queries else 0) + load_lines(answer)
        total = used()
        for f in sorted(loaded.values(), key=lambda f: (f["score"], f["id"])):
            if f["score"] >= recall.thresholds.unload and total <= budget:
                break
            del loaded[f["id"]]
            total -= f["tokens"]
        trace.append({"pass": step, "new_tokens": new, "loaded": sorted(loaded)})
        if new < recall.min_new_tokens:
            break
        answer = complete(question, list(loaded.values()))
        best = max(best, (quality(answer), answer), key=lambda x: x[0])
    return {"answer": best[1], "loaded": sorted(loaded), "trace": trace}
