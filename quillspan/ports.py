"""Ports to models and embedders, with deterministic stand-ins."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Completer(Protocol):
    def __call__(self, prompt: str, fragments: list[dict]) -> str: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


def fnv1a(data: bytes) -> int:
    """FNV-1a, 64 bits."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & (2**64 - 1)
    return h


def hash_embedder(dimension: int = 64) -> Embedder:
    """Unit vectors of word counts: each lower-case alphanumeric word adds one at its hash modulo the dimension."""
    import re

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for row, text in zip(out, texts):
            for w in re.findall(r"[^\W_]+", text.lower()):
                row[fnv1a(w.encode()) % dimension] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norm, 1.1920929e-7)

    return embed


def micro_batches(texts: list[str], most_chars: int = 120_000, most_rows: int = 256) -> Iterator[list[int]]:
    """Places of texts of like length that fit together: count times the widest stays within ``most_chars``."""
    held: list[int] = []
    for k in sorted(range(len(texts)), key=lambda k: len(texts[k])):
        if held and ((len(held) + 1) * len(texts[k]) > most_chars or len(held) == most_rows):
            yield held
            held = []
        held.append(k)
    if held:
        yield held


def embedded(rows: DataFrame, make: Callable[[], Embedder], text: str = "embed_text", out: str = "embedding", prefix: str = "") -> DataFrame:
    """``rows`` with unit vectors; ``make`` builds the model once a task, ``prefix`` sets queries apart from documents."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        model = make()
        for pdf in batches:
            texts = [prefix + (t or "")[:2500] for t in pdf[text]]
            vectors: list = [None] * len(texts)
            for group in micro_batches(texts):
                for k, v in zip(group, model([texts[i] for i in group])):
                    vectors[k] = v.tolist()
            yield pdf.assign(**{out: vectors})

    return rows.mapInPandas(run, schema)


def completed(rows: DataFrame, make: Callable[[], Callable[[str], str]], prompt: str, out: str, fallback: Column | None = None) -> DataFrame:
    """``rows`` with the model's answer; where it fails or says nothing, ``fallback``."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        model = make()
        for pdf in batches:
            said = []
            for p in pdf[prompt]:
                try:
                    said.append(model(p) or None)
                except Exception:  # a port may fail in any way; the fallback stands in
                    said.append(None)
            yield pdf.assign(**{out: said})

    done = rows.mapInPandas(run, schema)
    return done.withColumn(out, F.coalesce(F.col(out), fallback)) if fallback is not None else done


class Replay:
    """A model that says what it was given, in order; the last again at the end."""

    def __init__(self, answers: list[str]):
        self.answers, self.calls = list(answers), []

    def __call__(self, prompt: str, fragments: list[dict] = ()) -> str:
        self.calls.append((prompt, [f.get("id") for f in fragments]))
        return self.answers[min(len(self.calls), len(self.answers)) - 1]


def traced(model: Callable[..., str], path: str) -> Callable[..., str]:
    """``model`` with a JSON line for each request and response or error, appended to ``path``."""

    def call(prompt: str, *rest) -> str:
        began = time.time()

        def note(event: str, **more) -> None:
            with open(path, "a", encoding="utf-8") as f:
                f.write(json.dumps({"event": event, "latency_ms": round((time.time() - began) * 1000, 3), **more}, ensure_ascii=False) + "\n")

        note("llm_request", prompt=prompt)
        try:
            answer = model(prompt, *rest)
        except Exception as e:
            note("llm_error", error=str(e))
            raise
        note("llm_response", answer=answer, usage={"prompt_tokens": len(prompt.split()), "answer_tokens": len(answer.split())})
        return answer

    return call


def retried(model: Callable[..., str], degenerate: Callable[[str], bool], attempts: int = 3) -> Callable[..., tuple[str, bool]]:
    """The first answer that is not degenerate, and whether there was one; errors pass through."""

    def call(*args) -> tuple[str, bool]:
        answer = ""
        for _ in range(attempts):
            answer = model(*args)
            if not degenerate(answer):
                return answer, True
        return answer, False

    return call
