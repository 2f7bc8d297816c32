"""License scan: exact phrases, and short notices with a bounded number of edits.

Texts are brought to words (A-Z lowered, one space between) with numpy over the bytes of many
texts at once.  A notice of n bytes may have ``k = n // 20`` edits, 1 at least.  By the
pigeonhole principle one of any k+1 pieces of it then occurs unchanged: the pieces are the seeds,
found with plain substring search, and each hit gives the window in which the notice would have to
be, taken to whole words of the one text.  The regex library verifies the window with bounded errors
and says where the notice is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import row_groups

#: Fixed phrases of the contract.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices, as words, and their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit-notice"),
    ("released under the mit license", "mit-notice"),
    ("licensed under the mit license", "mit-notice"),
    ("licensed under the apache license version 2 0", "apache-notice"),
    ("you may not use this file except in compliance with the license", "apache-notice"),
    ("licensed under the gnu general public license version", "gpl-notice"),
    ("redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("gnu lesser general public license", "lgpl-notice"),
    ("gnu affero general public license", "agpl-notice"),
    ("gnu free documentation license", "gfdl-notice"),
    ("redistribution and use in source and binary forms with or without modification", "bsd-notice"),
    ("redistributions of source code must retain the above copyright notice", "bsd-notice"),
    ("neither the name of the copyright holder nor the names of its contributors", "bsd-notice"),
    ("licensed under the bsd 3 clause license", "bsd-notice"),
    ("subject to the terms of the mozilla public license", "mpl-notice"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc-notice"),
    ("eclipse public license", "epl-notice"),
    ("european union public licence", "eupl-notice"),
    ("boost software license version 1 0", "boost-notice"),
    ("artistic license 2 0", "artistic-notice"),
    ("python software foundation license", "psf-notice"),
    ("sil open font license", "ofl-notice"),
    ("open database license", "odbl-notice"),
    ("server side public license", "sspl-notice"),
    ("business source license", "busl-notice"),
    ("microsoft public license", "ms-pl-notice"),
    ("this software is provided as is without any express or implied warranty", "zlib-notice"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under a creative commons attribution", "cc-notice"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons zero", "cc0"),
    ("cc0 1 0 universal", "cc0"),
    ("spdx license identifier", "spdx"),
    ("released into the public domain", "public-domain"),
    ("the software is provided as is without warranty of any kind", "no-warranty"),
    ("all rights reserved", "all-rights-reserved"),
)
#: Bytes as they stand in words: A-Z lowered, what is in no word 0.
TABLE = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def edits(notice: str) -> int:
    return max(1, len(notice.encode()) // 20)


def seeds(notice: str) -> list[tuple[int, bytes]]:
    """k+1 pieces of the notice and where they begin."""
    data, k = notice.encode(), edits(notice)
    cuts = [len(data) * i // (k + 1) for i in range(k + 2)]
    return [(a, data[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=1)
def _compiled():
    phrases = [(re.compile(rb"(?<![^ \n])" + p.encode() + rb"(?![^ \n])"), p.encode(), label) for p, label in PHRASES.items()]
    # the separator is part of the match: where a search begins, the library takes no byte for inserted
    notices = [(regex.compile(rb"[ \n](?:" + regex.escape(n.encode()) + rb"){e<=%d}(?![^ \n])" % edits(n), regex.BESTMATCH), len(n.encode()), edits(n), label) for n, label in NOTICES]
    by_seed: dict[bytes, list[tuple[int, int]]] = {}
    for i, (n, _) in enumerate(NOTICES):
        for at, seed in seeds(n):
            by_seed.setdefault(seed, []).append((i, at))
    return phrases, notices, by_seed


def places(data: bytes, what: bytes) -> Iterator[int]:
    at = data.find(what)
    while at >= 0:
        yield at
        at = data.find(what, at + 1)


def matches(pattern: regex.Pattern, data: bytes, start: int, end: int, least: int) -> Iterator[regex.Match]:
    """All matches in order: the best of a stretch hides no earlier one with more edits.

    ``end`` is a word's end: the pattern takes it for one, as it sees nothing beyond.
    """
    while end - start >= least and (m := pattern.search(data, start, end)):
        yield from matches(pattern, data, start, m.start(), least)
        yield m
        start = m.end()


def window(data: bytes, at: int, a: int, e: int) -> tuple[int, int]:
    """``a`` to ``e`` within the text (a line) that holds ``at``, taken to the ends of words."""
    a = max(a, data.rfind(b"\n", max(0, a), at) + 1)
    stop = data.find(b"\n", at)
    if e >= stop:
        return a, stop
    space = data.find(b" ", e, stop)
    return a, space if space >= 0 else stop


def words_of(texts: list[str]) -> tuple[bytes, np.ndarray]:
    """The words of all texts with one space after each, a line end after each text; words per text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    low = TABLE[data]
    word = low > 0
    ends = np.cumsum(lengths) - 1
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    counted = np.concatenate([[0], np.cumsum(starts)])
    bounds = np.concatenate([[0], ends + 1])
    per_text = np.diff(counted[bounds])
    after = np.zeros(len(word), bool)
    after[1:] = word[:-1]
    keep = word | (after & ~word)
    keep[ends] = True
    low = np.where(word, low, np.uint8(32))
    low[ends] = 10
    return low[keep].tobytes(), per_text


def scan(texts: list[str]) -> Iterator[dict]:
    """For each text: n_words, base (word number, label), notices (first word, end word, label, errors, bytes of the notice)."""
    phrases, notices, by_seed = _compiled()
    data, per_text = words_of(texts)
    base: dict[int, list[tuple[int, str]]] = {}
    found: dict[int, list[tuple[int, int, str, int, int]]] = {}
    line_ends = word_ends = None

    def where(at: int) -> tuple[int, int]:
        """Text and number of the word that stands at a place."""
        nonlocal line_ends, word_ends
        if line_ends is None:
            flat = np.frombuffer(data, np.uint8)
            line_ends = np.flatnonzero(flat == 10)
            before = np.concatenate([[0], flat[:-1]])
            word_ends = np.flatnonzero(((flat == 32) | (flat == 10)) & (before != 32) & (before != 10) & (before != 0))
        text = int(np.searchsorted(line_ends, at))
        begin = int(line_ends[text - 1]) + 1 if text else 0
        return text, int(np.searchsorted(word_ends, at) - np.searchsorted(word_ends, begin))

    for pattern, plain, label in phrases:
        if plain in data:
            for m in pattern.finditer(data):
                text, word = where(m.start())
                base.setdefault(text, []).append((word, label))
    windows: dict[int, set[tuple[int, int]]] = {}
    for seed, owners in by_seed.items():
        for at in places(data, seed):
            for i, offset in owners:
                length, k = notices[i][1:3]
                windows.setdefault(i, set()).add(window(data, at, at - offset - k, at - offset + length + k))
    lead = b"\n" + data if windows else b""  # so that a separator stands before every word
    for i, spans in windows.items():
        pattern, length, k, label = notices[i]
        merged: list[list[int]] = []
        for a, e in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([a, e])
        for a, e in merged:
            for m in matches(pattern, lead, a, e + 1, length - k):
                text, first = where(m.start())
                found.setdefault(text, []).append((first, where(m.end() - 2)[1] + 1, label, sum(m.fuzzy_counts), length))
    for t, n in enumerate(per_text.tolist()):
        yield {"n_words": n, "base": sorted(base.get(t, [])), "notices": sorted(found.get(t, []))}


def score(base: list, notices: list) -> float:
    """1 for an exact phrase; else the share of the best matched notice that is unchanged; 0 for nothing."""
    return 1.0 if base else max((1 - errors / length for *_, errors, length in notices), default=0.0)


def license_spans(docs: DataFrame, *, text: str = "text", out: str = "licenses") -> DataFrame:
    """``docs`` with an array of structs label, first_word, end_word, errors (exact phrases: 0 errors).

    Null and empty texts have none; very long ones are read whole.  A notice that stands several times
    gives a span each, exact phrases first.  Equal rows get equal spans; an empty table gives an empty
    result.  Raises ValueError where ``out`` is a column already; other columns pass, whatever their names.
    """
    if out in docs.columns:
        raise ValueError(f"column {out!r} is there already")
    fields = [("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("errors", pa.int64())]
    span = T.ArrayType(T.StructType([T.StructField(n, T.StringType() if n == "label" else T.LongType()) for n, _ in fields]))
    words = {label: len(p.split()) for p, label in PHRASES.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in row_groups(batches, text):
            found = [[{"label": x, "first_word": w, "end_word": w + words[x], "errors": 0} for w, x in s["base"]] + [{"label": x, "first_word": a, "end_word": e, "errors": k} for a, e, x, k, _ in s["notices"]] for s in scan(texts)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.list_(pa.struct(fields)))], names=[*rows.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, span)]))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in row_groups(batches, "text"):
            out = []
            for s in scan(texts):
                base, words = {x for _, x in s["base"]}, [w for w, _ in s["base"]]
                labels = base | {x for _, _, x, _, _ in s["notices"]}
                out.append((s["n_words"], len(words), min(words, default=None), max(words, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score(s["base"], s["notices"])))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.record_batch([rows.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
