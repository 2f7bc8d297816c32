"""Secret scan: three patterns, and a battery of randomness tests over other long tokens.

A candidate is a run of 20 or more characters of ``[A-Za-z0-9+/_-]`` and the ``=`` after them, outside
the pattern matches; so the value of NAME=VALUE is one of its own.  Its encoding (digits, hex, letters
of one case, base32, base 36 or base 64, by its characters) says which alphabet it should be uniform
over.  Letters of both cases without a digit or sign are not tested, whatever their length.
Three tests are made:

* chi-squared uniformity of the symbols over the alphabet (of its classes of digits, lower and
  upper case, where a token is too short for single symbols);
* Wald-Wolfowitz runs of symbol values above and below the alphabet's middle;
* serial correlation of neighbouring symbol values.

They ask whether the token departs from randomness; one that does (p below ``DEPART``) is no
secret.  The discovery p-value says how likely language comes as close to uniform symbols: the
likelihood ratio of the token's symbol pairs under a model of words, names, paths and numbers
(``language_p``).  Benjamini-Hochberg decides, with weights in proportion to candidate length (mean
1), so long tokens, whose tests have the power, get more of the error budget.  Runs that are not
tested do not count.

The family is every tested candidate of the whole table: ``RATE`` bounds the expected share of false
finds among all finds in it.  A first pass over all texts counts the candidates by their weighted
p-value in bins of a 64th of a natural logarithm, with their number and lengths; that histogram, of
bounded size, gives the cut (``table_cut``), and the second pass takes what lies below it.  A single
text without a cut is a family of its own.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_groups

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SHORTEST = 20
#: '=' is in no alphabet: it ends a token (padding, or a name before its value).
PART = re.compile(r"[A-Za-z0-9+/_-]+=*")
DEPART, RATE = 1e-3, 0.01
#: Bins of a weighted p-value to a natural logarithm, and the last bin (smaller values fall into it).
BINS, LAST_BIN = 64, 64 * 200
#: Share of the language's characters that follow no rule (codes, abbreviations, rare words).
OTHER = 0.05
#: In the language, the class of a character by the class of the one before: digit, lower, upper, other.
CLASSES = {
    "": {"d": 0.15, "l": 0.45, "u": 0.35, "o": 0.05},
    "d": {"d": 0.65, "l": 0.08, "u": 0.07, "o": 0.20},
    "l": {"d": 0.03, "l": 0.86, "u": 0.05, "o": 0.06},
    "u": {"d": 0.08, "l": 0.35, "u": 0.45, "o": 0.12},
    "o": {"d": 0.25, "l": 0.45, "u": 0.20, "o": 0.10},
}
#: Letter pairs of the words in Python's standard library: a row for each letter before, 9 for half of it, each step down half of that.
PAIRS = (
    "04550140402656040666331230 61327010560611530442600050 60316106405521710426400010 52248120600401500443500120 "
    "41553520100646142666032530 60235510700411720644501020 41108045600425410563520001 70008000600111600414300000 "
    "33443540000557530466030203 40308000202000620040600000 41228130600404230252315010 52147700600501520054500040 "
    "74028000500241660042400010 60566360402203620056330020 24451420203457450745534100 70227102400600650636410040 "
    "00000000000302121330900000 61337240502245610555421040 40408024502211440157401030 50326107601310520644502040 "
    "34326330400656250756000000 80008000500011300000000000 60136006700314500641002000 41715201500330160137000330 "
    "13325201400445470376024010 50008202600332520010000020"
).split()

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by their alphabets, the smallest that holds a token counts.
ENCODINGS = {
    "digits": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "hex_upper": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "base36_upper": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_SETS = {name: frozenset(alphabet) for name, alphabet in ENCODINGS.items()}
_VALUES = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ENCODINGS.items()}
_SYMBOLS = _UPPER + _LOWER + _DIGITS + "+/-_"


def _kind(c: str) -> str:
    """Digit, lower, upper or other."""
    return c and ("d" if c in _DIGITS else "l" if c in _LOWER else "u" if c in _UPPER else "o")


def encoding_of(token: str) -> str | None:
    """The token's encoding; None for rulers, for letters of both cases alone, and for what fits none."""
    body = token.rstrip("=")
    seen = frozenset(body)
    if not any(c.isalnum() for c in seen) or body.isalpha() and not (body.islower() or body.isupper()):
        return None
    return next((name for name, symbols in _SETS.items() if seen <= symbols), None)


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


@lru_cache(maxsize=1)
def _language() -> dict[tuple[str, str], float]:
    """Log-probability of a character after another ("" at the start) in words, names, paths and numbers."""
    letters = dict(zip(_LOWER, ([2.0 ** (int(x) - 9) if x > "0" else 2.0**-10 for x in row] for row in PAIRS)))
    letters = {a: {c: v / sum(row) for c, v in zip(_LOWER, row)} for a, row in letters.items()}
    alone = {c: sum(row[c] for row in letters.values()) / 26 for c in _LOWER}
    out = {}
    for a in ("", *_SYMBOLS):
        for c in _SYMBOLS:
            kind, low, before = _kind(c), c.lower(), letters.get(a.lower())
            share = 0.1 if kind == "d" else 0.25 if kind == "o" else 0.6 * before[low] + 0.4 * alone[low] if before else alone[low]
            out[a, c] = math.log((1 - OTHER) * CLASSES[_kind(a)][kind] * share + OTHER / len(_SYMBOLS))
    return out


def language_p(body: str, encoding: str) -> float:
    """A bound of how likely words or repetition come as close to uniform symbols as ``body``.

    The ratio of two likelihoods is at least x with probability 1/x at most under the lower one, so its
    inverse is a p-value at every length.  The lower one is the language, a writer who repeats what followed
    the last symbol before, or one of few symbols (DNA), a third each; the upper one is uniform over one of the encodings, each as likely.
    """
    size, model = len(ENCODINGS[encoding]), _language()
    words = again = few = 0.0
    before, after, counts = "", {}, Counter()
    for i, c in enumerate(body):
        log = model[before, c]
        words += log
        again += math.log(0.5 * (after[before] == c) + 0.5 * math.exp(log)) if before in after else log
        few += math.log(0.5 * counts[c] / i + 0.5 * math.exp(log)) if i else log
        after[before] = c
        counts[c] += 1
        before = c
    high = max(words, again, few)
    low = high + math.log(sum(math.exp(x - high) for x in (words, again, few)) / 3)
    return math.exp(min(0.0, low + len(body) * math.log(size) + math.log(len(ENCODINGS))))


def battery(token: str, encoding: str) -> dict[str, float]:
    """p-values: ``language`` (fit this good under the language alternative), ``uniform``, ``runs``, ``serial``."""
    body = token.rstrip("=")
    values = [_VALUES[encoding][c] for c in body]
    n, size = len(values), len(ENCODINGS[encoding])
    if n >= 4 * size:  # enough symbols for a cell each
        cells = Counter(values)
        expected = {v: n / size for v in range(size)}
    else:
        cells = Counter(map(_kind, body))
        share = Counter(map(_kind, ENCODINGS[encoding]))
        expected = {k: n * v / size for k, v in share.items()}
    chi = sum((cells.get(k, 0) - e) ** 2 / e for k, e in expected.items())
    df = len(expected) - 1
    # the cube root of a chi-squared variable is nearly normal
    uniform = _upper_tail(((chi / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df))) if df else 1.0
    middle = (size - 1) / 2
    above = [v > middle for v in values]
    a, b = sum(above), n - sum(above)
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(above, above[1:]))
        mean, var = 2 * a * b / n + 1, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        runs_p = 2 * _upper_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs_p = 2.0 ** (1 - n)
    average = sum(values) / n
    total = sum((v - average) ** 2 for v in values)
    serial = sum((x - average) * (y - average) for x, y in zip(values, values[1:])) / total if total else 1.0
    serial_p = 2 * _upper_tail(abs(serial + 1 / n) * math.sqrt(n)) if total else 0.0
    return {"language": language_p(body, encoding), "uniform": uniform, "runs": runs_p, "serial": serial_p}


def graded(token: str) -> tuple[int, float] | None:
    """Length of a tested token and its p-value over its length (infinite if it departs from randomness); else None."""
    encoding = encoding_of(token)
    if encoding is None:
        return None
    p = battery(token, encoding)
    random = min(p["uniform"], p["runs"], p["serial"]) >= DEPART
    return len(token), p["language"] / len(token) if random else math.inf


def bin_of(weighted: float) -> int:
    """Bin of a p-value over its length, the larger the smaller the value; -1 for infinite ones."""
    return -1 if weighted == math.inf else LAST_BIN if weighted <= 0 else min(LAST_BIN, max(0, math.floor(-BINS * math.log(weighted))))


def cut_of(histogram: dict[int, int], tested: int, characters: int, rate: float = RATE) -> int:
    """The smallest bin that is found, by Benjamini-Hochberg over the bins' upper edges; past the last one if none is."""
    cut, found = LAST_BIN + 1, 0
    for b in sorted((b for b in histogram if b >= 0), reverse=True):
        found += histogram[b]
        if math.exp(-b / BINS) * characters / tested <= rate * found / tested:
            cut = b
    return cut


def discoveries(tokens: list[str], rate: float = RATE, cut: int | None = None) -> list[bool]:
    """Which tokens are random: below the ``cut`` of their family, or else as a family of their own."""
    grades = [graded(token) for token in tokens]
    bins = [g and bin_of(g[1]) for g in grades]
    if cut is None:
        tested = [g for g in grades if g]
        cut = cut_of(Counter(b for b in bins if b is not None), len(tested), sum(n for n, _ in tested), rate)
    return [b is not None and b >= cut for b in bins]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = []
    low = text.lower()
    if any(w in low for w in WORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[re.Match]:
    """Tokens to test, outside the base spans."""
    # longest reach of base spans that begin before a place, to test for overlap in one pass
    found, reach, k = [], -1, 0
    runs = (m for run in CANDIDATE.finditer(text) for m in PART.finditer(text, *run.span()) if len(m[0]) >= SHORTEST)
    for m in runs:
        while k < len(base) and base[k][0] < m.end():
            reach, k = max(reach, base[k][1]), k + 1
        if reach <= m.start():
            found.append(m)
    return found


def random_spans(text: str, base: list[tuple[int, int, str]], cut: int | None = None) -> list[tuple[int, int, str]]:
    """Candidates that pass the battery."""
    found = candidates(text, base)
    keep = discoveries([m[0] for m in found], cut=cut) if found else []
    return [(m.start(), m.end(), "random") for m, yes in zip(found, keep) if yes]


def scan(text: str, cut: int | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans by start, then kind."""
    base = base_spans(text)
    extra = random_spans(text, base, cut)
    return base, sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))


def table_cut(docs: DataFrame, text: str = "text", rate: float = RATE) -> int:
    """The bin from which on candidates of ``docs`` are found; one pass over all texts.

    What reaches the driver is a histogram of at most ``LAST_BIN`` + 2 bins, whatever the table's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, characters = Counter(), Counter()
        for _, texts in row_groups(batches, text):
            for t in texts:
                for m in candidates(t, base_spans(t)):
                    if grade := graded(m[0]):
                        b = bin_of(grade[1])
                        counts[b] += 1
                        characters[b] += grade[0]
        yield pa.record_batch([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64()), pa.array([characters[b] for b in counts], pa.int64())], names=["bin", "n", "characters"])

    found = docs.select(text).mapInArrow(run, "bin int, n long, characters long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("characters").alias("characters")).collect()
    return cut_of({r["bin"]: r["n"] for r in found}, sum(r["n"] for r in found), sum(r["characters"] for r in found), rate)


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def secret_spans(docs: DataFrame, *, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with an array of structs kind, start, end (code points, end exclusive).

    Null and empty texts have none; very long ones are scanned whole.  Equal rows get equal spans and
    count each in the family.  An empty table gives an empty result.  Raises ValueError where ``out``
    is a column already; other columns pass, whatever their names.  The texts are read once before the
    result is made, for the cut.
    """
    if out in docs.columns:
        raise ValueError(f"column {out!r} is there already")
    cut = table_cut(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for rows, texts in row_groups(batches, text):
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in scan(t, cut)[1]] for t in texts]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, kind)], names=[*rows.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, SPAN)]))


def redact(text: str, mark: str = "[SECRET]", cut: int | None = None) -> str:
    """``text`` with every span, overlapping ones together, replaced by ``mark``."""
    out, at = [], 0
    spans = scan(text, cut)[1]
    i = 0
    while i < len(spans):
        start, end = spans[i][:2]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i, end = i + 1, max(end, spans[i + 1][1])
        out += [text[at:start], mark]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, *, text: str = "text", length: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets replaced; ``length``, where it is a column, follows in changed rows.

    Rows, null and empty texts and all other columns, whatever their names, stay as they are; very long
    texts are scanned whole, equal rows change alike, an empty table stays empty.  The texts are read
    once before the result is made, for the cut.
    """
    schema, cut = docs.schema, table_cut(docs, text)
    length = length if length in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in row_groups(batches, text):
            new = [redact(t, mark, cut) for t in texts]
            changed = [a != b for a, b in zip(texts, new)]
            if any(changed):
                columns = dict(zip(rows.schema.names, rows.columns))
                columns[text] = pa.array([n if c else o for n, c, o in zip(new, changed, columns[text].to_pylist())], columns[text].type)
                if length:
                    columns[length] = pa.array([len(n) if c else o for n, c, o in zip(new, changed, columns[length].to_pylist())], columns[length].type)
                rows = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            yield rows

    return docs.mapInArrow(run, schema)


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = table_cut(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in row_groups(batches, "text"):
            found = [scan(t, cut) for t in texts]
            counts = [[sum(s[2] == k for s in base) for base, _ in found] for k in KINDS[:3]]
            shas = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.record_batch([rows.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas), pa.array([_joined(every) for _, every in found])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
