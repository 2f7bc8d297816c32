"""Encoding of texts by way of a cache of their units.

A unit is a stretch of text that a tokenizer encodes alike wherever it stands (a word with its
leading space, mostly).  Texts repeat units; each is encoded once a cache and the ids of a text
are gathered with numpy.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

#: Units held by one cache; at this size it starts anew, so a worker's memory stays bounded (about 200 bytes a unit).
MAX_UNITS = 500_000


class Numbers(dict):
    """Gives each new key the next number and notes it in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class UnitCache:
    """Ids of units: ``encode_new(list of new units) -> (flat ids, counts)``."""

    def __init__(self, split: Callable[[str], list[str]], encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype=np.uint32, max_units: int = MAX_UNITS, note: Callable | None = None):
        self.split, self.encode_new, self.dtype, self.max_units, self.note = split, encode_new, dtype, max_units, note
        self._clear()

    def _clear(self) -> None:
        self.at = Numbers()
        self.flat, self.starts, self.counts = np.empty(0, self.dtype), np.empty(0, np.int64), np.empty(0, np.int64)
        self.notes: list = []

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts' units, one after the other, and how many each text has."""
        if len(self.at) > self.max_units:
            self._clear()
        split = [self.split(t) for t in texts]
        per_text = np.fromiter(map(len, split), np.int64, len(split))
        found = np.fromiter(map(self.at.__getitem__, chain.from_iterable(split)), np.int64, int(per_text.sum()))
        if new := self.at.new:
            flat, counts = self.encode_new(new)
            self.at.new = []
            starts = np.cumsum(counts) - counts + len(self.flat)
            self.flat = np.concatenate([self.flat, flat.astype(self.dtype, copy=False)])
            self.starts, self.counts = np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts])
            if self.note:
                self.notes += self.note(self.flat[len(self.flat) - len(flat) :], counts)
        return found, per_text

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        places, per_text = self.places(texts)
        return self.gathered(places, per_text)

    def gathered(self, places: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.counts[places]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(self.starts[places] - (ends - counts), counts) + np.arange(total)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return self.flat[take], np.diff(bounds)
