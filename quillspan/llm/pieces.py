"""SentencePiece BPE by merge rounds over flat numpy arrays.

The symbols of all new units lie in one array.  Each round finds, for every unit, the least rank
among its pairs (``np.minimum.reduceat`` over the unit's segment) and merges, from the left, all
places that have it and do not overlap; then the array is compacted and units without a pair
left leave it.  That equals the library's order (best pair first, leftmost on ties) as long as no
merge makes a pair of the same or a better rank.  Where one does, the unit takes one leftmost
merge a round, and a unit of more than ``STRICT`` symbols goes through a heap instead, which
keeps runs of thousands of spaces from taking as many rounds.

Units: the model has no piece with a space mark after another character and none with a line end,
so a text is cut before each run of marks and around line ends (checked when the model is read;
a model without these properties gets whole texts as units).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import row_groups
from .units import UnitCache

MARK = "▁"
NONE = np.iinfo(np.int32).max
STRICT = 64


class PieceModel:
    """Merge table and ids of a model with byte fallback, dummy prefix and no normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = np.full(256, sp.unk_id(), np.int64)
        pieces: dict[str, tuple[int, float]] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[piece] = (i, sp.get_score(i))
        symbols = {p: k for k, p in enumerate(dict.fromkeys([*pieces, *(c for p in pieces for c in p)]))}
        self.symbols = symbols
        self.piece_id = np.full(len(symbols), -1, np.int64)  # -1: a character that is no piece
        for p, (i, _) in pieces.items():
            self.piece_id[symbols[p]] = i
        self.character = list(symbols)
        score_rank = {s: r for r, s in enumerate(sorted({s for _, s in pieces.values()}, reverse=True))}
        rows = [(symbols[p[:k]] * len(symbols) + symbols[p[k:]], score_rank[s], symbols[p]) for p, (_, s) in pieces.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.merged = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        # the best rank of any pair with this symbol: a merge into it is safe if that is worse than its own
        best, own = np.full(len(symbols), NONE, np.int32), np.full(len(symbols), -1, np.int32)
        np.minimum.at(best, self.keys // max(1, len(symbols)), self.ranks)
        np.minimum.at(best, self.keys % max(1, len(symbols)), self.ranks)
        own[self.merged] = self.ranks
        self.safe = best > own
        inner = any(MARK in p.lstrip(MARK) for p in pieces)
        line = any("\n" in p for p in pieces)
        self.unit = re.compile(r" *[^ \n]+|\n| +" if not inner and not line else r"(?s).+")
        self.width = len(symbols)

    def split(self, text: str) -> list[str]:
        return self.unit.findall(" " + text.replace(MARK, " ")) if text else []

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where there is no such piece) and merged symbol of pairs."""
        key = np.where((left < self.width) & (right < self.width), left.astype(np.int64) * self.width + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE).astype(np.int32), self.merged[at]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units, one after the other, and how many each has."""
        symbols, width = self.symbols, self.width
        extra: dict[str, int] = {}
        known = lambda c: symbols[c] if c in symbols else width + extra.setdefault(c, len(extra))
        if not units:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        joined = "".join(units).replace(" ", MARK)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, place = np.unique(points, return_inverse=True)
        flat = np.array([known(chr(c)) for c in distinct.tolist()], np.int32)[place]
        owner = np.repeat(np.arange(len(units)), np.fromiter(map(len, units), np.int64, len(units)))
        flat, owner = self._merge(flat, owner)
        return self._to_ids(flat, owner, len(units), list(extra))

    def _merge(self, flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done_s, done_o = [], []
        rank, to = self._ranks(flat, owner)
        while len(flat):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(flat)))
            active = least < NONE
            if not active.all():  # compaction: units without a pair left
                keep = np.repeat(active, sizes)
                done_s.append(flat[~keep])
                done_o.append(owner[~keep])
                flat, owner, rank, to = flat[keep], owner[keep], rank[keep], to[keep]
                if not len(flat):
                    break
                least, sizes = least[active], sizes[active]
            segment = np.repeat(np.arange(len(sizes)), sizes)
            hit = rank == least[segment]
            at = np.flatnonzero(hit)
            # of neighbouring hits every second, from the left: number within the run of hits
            run = np.cumsum(np.concatenate([[True], np.diff(at) != 1])) - 1
            begins = np.flatnonzero(np.concatenate([[True], np.diff(run) != 0]))
            at = at[(np.arange(len(at)) - begins[run]) % 2 == 0]
            merged = to[at]
            new, gone = flat.copy(), np.zeros(len(flat), bool)
            new[at] = merged
            gone[at + 1] = True
            unsafe = self._unsafe(flat, owner, at, merged, least, segment)
            if len(unsafe):
                bad = np.zeros(len(sizes), bool)
                bad[unsafe] = True
                long = bad & (sizes > STRICT)
                for k in np.flatnonzero(long):  # one at a time through the heap
                    places = np.flatnonzero(segment == k)
                    kept, symbols = self._heap(flat[places].tolist())
                    gone[places], new[places[kept]] = True, symbols
                    gone[places[kept]] = False
                # the other unsafe units: only their leftmost merge
                seg = segment[at]
                lead = np.concatenate([[True], seg[1:] != seg[:-1]])
                back = at[bad[seg] & ~long[seg] & ~lead]
                new[back], gone[back + 1] = flat[back], False
            changed = np.zeros(len(flat), bool)
            changed[new != flat] = True
            stay = ~gone
            touched = changed[stay]
            flat, owner, rank, to = new[stay], owner[stay], rank[stay], to[stay]
            # ranks change at merged symbols and at the place before them
            look = touched.copy()
            look[:-1] |= touched[1:]
            look = np.flatnonzero(look)
            rank[look], to[look] = self._ranks(flat, owner, look)
        if not done_s:
            return flat, owner
        flat, owner = np.concatenate([*done_s, flat]), np.concatenate([*done_o, owner])
        order = np.argsort(owner, kind="stable")
        return flat[order], owner[order]

    def _ranks(self, flat: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the pair that begins at each place (NONE at a unit's last) and what it merges into."""
        at = np.arange(len(flat)) if at is None else at
        after = np.minimum(at + 1, len(flat) - 1)
        found, to = self.pair(flat[at], flat[after])
        found[(after == at) | (owner[after] != owner[at])] = NONE
        return found, to

    def _unsafe(self, flat, owner, at, merged, least, segment) -> np.ndarray:
        """Units in which a merge of this round makes a pair that should come before another of its merges."""
        doubt = np.flatnonzero(~self.safe[merged])
        if not len(doubt):
            return doubt
        here, what = at[doubt], merged[doubt]
        limit = least[segment[here]]
        left, right = np.maximum(here - 1, 0), np.minimum(here + 2, len(flat) - 1)
        bad = (here > 0) & (owner[left] == owner[here]) & (self.pair(flat[left], what)[0] <= limit)
        bad |= (here + 2 < len(flat)) & (owner[right] == owner[here]) & (self.pair(what, flat[right])[0] <= limit)
        if len(at) > 1:  # two merged symbols side by side
            nxt = np.minimum(doubt + 1, len(at) - 1)
            near = (at[nxt] - here == 2) & (owner[at[nxt]] == owner[here])
            bad |= near & (self.pair(what, merged[nxt])[0] <= limit)
        return np.unique(segment[here[bad]])

    def _heap(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """Places that stay and their symbols, by the library's own order, for one unit."""
        n = len(symbols)
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        agenda: list[tuple[int, int, int, int, int]] = []

        def look(i: int, j: int) -> None:
            if i >= 0 and j >= 0:
                a, b = symbols[i], symbols[j]
                if a < self.width and b < self.width:
                    key = a * self.width + b
                    k = int(np.searchsorted(self.keys, key))
                    if k < len(self.keys) and self.keys[k] == key:
                        heapq.heappush(agenda, (int(self.ranks[k]), i, j, a, b))

        for i in range(n - 1):
            look(i, i + 1)
        while agenda:
            _, i, j, a, b = heapq.heappop(agenda)
            if not (alive[i] and alive[j] and symbols[i] == a and symbols[j] == b and after[i] == j):
                continue
            symbols[i] = int(self.merged[np.searchsorted(self.keys, a * self.width + b)])
            alive[j] = False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            look(before[i], i)
            look(i, after[i])
        kept = [i for i in range(n) if alive[i]]
        return kept, [symbols[i] for i in kept]

    def _to_ids(self, flat, owner, n_units: int, extra: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces to ids; characters that are no piece to the ids of their bytes."""
        ids = np.full(len(flat), -1, np.int64)
        inside = flat < self.width
        ids[inside] = self.piece_id[flat[inside]]
        times = np.ones(len(flat), np.int64)
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            encoded = [(self.character[s] if s < self.width else extra[s - self.width]).encode("utf-8", "surrogatepass") for s in flat[odd].tolist()]
            times[odd] = [len(b) for b in encoded]
            ends = np.cumsum(times)
            ids = np.repeat(ids, times)
            place = np.concatenate([np.arange(e - len(b), e) for e, b in zip(ends[odd].tolist(), encoded)])
            ids[place] = self.byte_ids[np.frombuffer(b"".join(encoded), np.uint8)]
        return ids, np.bincount(np.repeat(owner, times) if len(odd) else owner, minlength=n_units).astype(np.int64)


@lru_cache(maxsize=1)
def _pieces(path: str) -> PieceModel:
    return PieceModel(path)


@lru_cache(maxsize=1)
def _model(path: str, noted: bool = False) -> tuple[PieceModel, UnitCache]:
    """The model and a cache, with the units' ids as decimals if ``noted``; a worker keeps one of them."""
    model = _pieces(path)
    digits = [str(i) for i in range(model.sp.get_piece_size())] if noted else []

    def decimals(flat: np.ndarray, counts: np.ndarray) -> list[str]:
        all_of, ends = list(map(digits.__getitem__, flat.tolist())), np.cumsum(counts)
        return [",".join(all_of[s:e]) for s, e in zip((ends - counts).tolist(), ends.tolist())]

    return model, UnitCache(model.split, model.encode_units, np.int32, max_units=300_000, note=decimals if noted else None)


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    flat, counts = _model(path)[1].ids(texts)
    return np.split(flat, np.cumsum(counts)[:-1]) if texts else []


def decode_ids(path: str, ids: list[int]) -> str:
    return _model(path)[0].sp.decode(ids)


def encode_pieces(docs: DataFrame, model: str, *, text: str = "text", out: str = "piece_ids") -> DataFrame:
    """``docs`` with an array of ids.

    Null and empty texts give no ids, very long ones are encoded whole, equal ones alike; a table
    without rows gives none.  A column already called ``out`` raises ValueError, all other names are
    left alone.
    """
    if out in docs.columns:
        raise ValueError(f"column {out!r} is there already")
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in row_groups(batches, text):
            flat, counts = _model(model)[1].ids(texts)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=[*rows.schema.names, out])

    return docs.mapInArrow(run, schema)


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    A null text counts as empty and has no ids; very long texts are encoded whole.  Repeated rows and
    ids give a row each; an empty table gives an empty result.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in row_groups(batches, "text"):
            pieces, cache = _model(model, noted=True)
            places, per_text = cache.places(texts)
            flat, counts = cache.gathered(places, per_text)
            notes, at, start = list(map(cache.notes.__getitem__, places.tolist())), 0, 0
            ids_sha, text_sha = [], []
            for units, count in zip(per_text.tolist(), counts.tolist()):
                ids_sha.append(hashlib.sha256(",".join(notes[at : at + units]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(pieces.sp.decode(flat[start : start + count].tolist()).encode()).hexdigest())
                at, start = at + units, start + count
            yield pa.record_batch([rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
