"""Quality rules, line first: bad lines go, then documents that lost too much of their text.

A line with words fails for one of three reasons:

* punctuation: no closing punctuation at its end (nor, in a long line, between sentences; a line of some
  length that goes on in lower case in the next one needs none), or symbols make up more than a twentieth of it,
  or it shouts (a third of its words end in doubled exclamation marks);
* navigation: three or more menu separators;
* boilerplate: a line that stood before, or a short line with a site's stock phrase.

A document is rejected by the base rules (fewer than 50 words, or more than half of its words in
three-word windows that repeat) or if more than half of its characters are in failing lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import row_groups

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
#: What may close a line: of Latin, CJK, Indic, Arabic, Armenian, Ethiopic and Khmer texts.
CLOSING = ".!?…。！？:;\"'”’»)]}」』।॥؟۔؛։።៖"
#: A line of so many characters whose next line begins in lower case goes on there (hard-wrapped prose).
WRAPPED = 40
SEPARATORS = "|›»•·"
#: Stock phrases of sites, in lower case.
STOCK = ("cookie", "javascript", "click here", "sign in", "log in", "subscribe", "newsletter", "terms of use", "privacy policy", "skip to content", "read more", "share this", "lorem ipsum")
STOCK_RE = re.compile("|".join(map(re.escape, STOCK)), re.IGNORECASE)
SENTENCE, LONG = re.compile(r"[.!?。] "), 200
STOCK_WORDS, MOST_SYMBOLS, MENU, MOST_LOST = 12, 0.05, 3, 0.5


def failure(line: str, after: str = "") -> str | None:
    """Why a line with words fails, apart from having stood before; None if it doesn't.

    ``after`` is the line that follows at once.
    """
    body = line.strip(SPACE)
    if sum(map(body.count, SEPARATORS)) >= MENU:
        return "navigation"
    prose = body[-1] in CLOSING or len(body) >= LONG and SENTENCE.search(body) or len(body) >= WRAPPED and after.lstrip(SPACE)[:1].islower()
    if not prose or sum(map(body.count, SYMBOLS)) > MOST_SYMBOLS * len(body):
        return "punctuation"
    if "!!" in body:
        words = body.split()
        if 3 * sum(w.endswith("!!") for w in words) >= len(words):
            return "punctuation"
    if STOCK_RE.search(body) and len(body.split()) <= STOCK_WORDS:
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    hit = np.fromiter((count[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def judged(text: str) -> dict:
    """The figures of one text and the cleaned text."""
    words = text.encode("utf-8", "surrogatepass").split()  # of bytes: ASCII white space alone
    lines = text.split("\n")
    seen: set[str] = set()
    kept, held, lost, dup = [], 0, 0, 0
    for line, after in zip(lines, [*lines[1:], ""]):
        body = line.strip(SPACE)
        if not body:
            kept.append(line)
            continue
        again = line in seen
        dup += again
        seen.add(line)
        held += len(body)
        if again or failure(line, after):
            lost += len(body)
        else:
            kept.append(line)
    n, repeats = len(words), repeated_words(words)
    base_failed = n < 50 or 100 * repeats > 50 * n
    return {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, SPACE)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": dup,
        "n_repeat_words": repeats,
        "base_failed": base_failed,
        "kept": not base_failed and lost <= MOST_LOST * held,
        "cleaned": "\n".join(kept).strip("\n") if lost else text,
    }


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def quality_figures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the figures of every document.

    Null and empty texts have no words and fail; very long ones are judged whole.  Repeated rows and
    ids give a row each, null ids too; an empty table gives an empty result.  Other columns are not read.
    """
    names = [f.split()[0] for f in FIGURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in row_groups(batches, text):
            found = [judged(t) for t in texts]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.record_batch([rows.column(doc_id), *(pa.array([f[n] for f in found], k) for n, k in zip(names, kinds))], names=["doc_id", *names])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, {FIGURES}")


def cleaned(docs: DataFrame, *, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents that are kept, without their failing lines; ``length`` follows where it is a column.

    All columns stay, whatever their names; rejected documents (null, empty and wordless texts among
    them) go.  Very long texts are judged whole, repeated rows alike; an empty table stays empty.
    """
    length = length if length in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in row_groups(batches, text):
            found = [judged(t) for t in texts]
            columns = dict(zip(rows.schema.names, rows.columns))
            old = columns[text].to_pylist()
            new = [f["cleaned"] if t is not None else None for t, f in zip(old, found)]
            columns[text] = pa.array(new, columns[text].type)
            if length:
                columns[length] = pa.array([len(n) if n != o else k for n, o, k in zip(new, old, columns[length].to_pylist())], columns[length].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).filter(pa.array([f["kept"] for f in found]))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_figures(spark.read.parquet(f"{sf_dir}/documents.parquet"))
