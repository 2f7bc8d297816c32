"""Streaming forms: probe rates, the reindex queue, component health."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.workspace import START, health_step


def windowed_rates(events: DataFrame, *, ts: str = "ts", key: str = "event_type", late: str = "10 minutes", window: str = "1 hour", limit: int = 10) -> DataFrame:
    """key, start, n, throttled per tumbling window; late events within the watermark count."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), "n", (F.col("n") >= limit).alias("throttled"))


def reindex_queue(requests: DataFrame, *, path: str = "path", ts: str = "ts", pending: str = "10 minutes") -> DataFrame:
    """Requests without those for a path already pending; one may be queued again later."""
    return requests.withWatermark(ts, pending).dropDuplicatesWithinWatermark([path])


def drain(queue: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Start working the queue off, a batch at a time."""
    return queue.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def health_stream(calls: DataFrame, latency_limit: float = 5000.0) -> DataFrame:
    """component, calls, health after each micro-batch of calls (component, seq, ok, latency_ms)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ("calls", "errors", "row", "health")
        now = dict(zip(names, state.get)) if state.exists else dict(START)
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            now = health_step(now, bool(r.ok), float(r.latency_ms), latency_limit)
        state.update(tuple(now[n] for n in names))
        yield pd.DataFrame([(key[0], now["calls"], now["health"])], columns=["component", "calls", "health"])

    return calls.groupBy("component").applyInPandasWithState(run, "component string, calls long, health string", "calls long, errors long, row long, health string", "update", GroupStateTimeout.NoTimeout)
