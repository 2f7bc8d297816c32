"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from ..storage import dropped, new_path, shared_dir, stored

__all__ = ["CHUNK_CHARS", "WORD", "dropped", "new_path", "row_groups", "shared_dir", "stored"]

#: Words of the training-data contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text characters handled together in Python, so that memory does not follow the Arrow batch.
CHUNK_CHARS = 2_000_000


def row_groups(batches: Iterator[pa.RecordBatch], text: str, chars: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``chars`` characters of ``text`` each, and these texts (null: empty)."""
    for batch in batches:
        column = batch.column(text)
        sizes = column.cast(pa.large_binary()).fill_null(b"")
        start, held = 0, 0
        lengths = pa.compute.binary_length(sizes).to_pylist()
        for i, n in enumerate(lengths):
            held += n
            if held >= chars or i + 1 == len(lengths):
                part = batch.slice(start, i + 1 - start)
                yield part, part.column(text).fill_null("").to_pylist()
                start, held = i + 1, 0
