"""Token ids in Arrow IPC files of equal-length sequences.

A file holds record batches with two fixed-size-list columns, ``ids`` (unsigned, 2 bytes where the
vocabulary allows it, else 4) and ``mask`` (bits: a real token, not the padding of the last
sequence).  All sequences of a file have the same length and buffers are not compressed, so a
memory map gives sequence ``i`` without copying or decoding.  Documents follow each other without
gaps; a second file beside it (``.index.arrow``) has the start and count of each.

Writing: documents are put into ranges of ascending id, one file a range.  A file is written under
a temporary name and moved into place whole; a task that runs again writes the same bytes.  The
manifest (Parquet, a row a file) is written by Spark when all files are there; only files that it
names count.  Rows with equal ids are ordered by the hash of their text.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, row_groups
from .units import UnitCache

#: Stretches that a GPT-2 style splitter never reaches across: cut before a single space between
#: two other characters and around a single line end between two others.
UNIT = re.compile(r"(?:\s{2,}| ?|[^\S \n])\S+(?:\s{2,}\S+|[^\S \n]\S+)*|\n(?=\S)|\s+")
PLAIN = re.compile(r" ?\S+")
SEQUENCE, BATCH_SEQUENCES = 2048, 256
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_sequences long"


class _WholeTexts:
    """For tokenizers whose added tokens reach into the text beside them: no units."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([*found, np.empty(0, np.uint32)]), np.fromiter(map(len, found), np.int64, len(found))


@lru_cache(maxsize=2)
def _encoder(path: str, special_as_text: bool = False) -> UnitCache | _WholeTexts:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    tokenizer.no_padding()
    tokenizer.no_truncation()

    # the library takes added tokens out of a text first, the longest of those that begin at a place,
    # and encodes what lies between them alone
    added = [t for t in tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
    if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added):
        return _WholeTexts(tokenizer)
    marks = {t.content for t in added}
    cut = re.compile("(" + "|".join(map(re.escape, sorted(marks, key=len, reverse=True))) + ")") if marks else None

    def split(text: str) -> list[str]:
        if cut is None or not any(m in text for m in marks):
            return UNIT.findall(text)
        parts = cut.split(text)
        return [u for i, part in enumerate(parts) for u in ([part] if i % 2 else UNIT.findall(part))]

    line_end = tokenizer.encode("\n", add_special_tokens=False).ids[0]

    def encode_new(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units without inner white space go through as lines of longer strings, the others alone."""
        plain = np.fromiter((u not in marks and PLAIN.fullmatch(u) is not None for u in units), bool, len(units))
        lines, others = [u for u, p in zip(units, plain) if p], [u for u, p in zip(units, plain) if not p]
        blocks = ["\n".join(lines[i : i + 2000]) + "\n" for i in range(0, len(lines), 2000)]
        ids = [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(blocks, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        ends = np.flatnonzero(ids == line_end)
        line_counts = np.diff(np.concatenate([[-1], ends])) - 1
        other_ids = [e.ids for e in tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        counts = np.empty(len(units), np.int64)
        counts[plain], counts[~plain] = line_counts, [len(x) for x in other_ids]
        flat = np.empty(int(counts.sum()), np.uint32)
        in_line = np.repeat(plain, counts)
        flat[in_line] = ids[ids != line_end]
        flat[~in_line] = np.array([i for x in other_ids for i in x], np.uint32)
        return flat, counts

    return UnitCache(split, encode_new, max_units=1_000_000)


def encode_texts(path: str, texts: list[str], special_as_text: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and how many each has, as the library encodes them whole.

    A special token's string in a text becomes the token, as it does in the library; with
    ``special_as_text`` it is ordinary text.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _encoder(path, special_as_text).ids(texts)


class _Writer:
    """One file and its index."""

    def __init__(self, fs, stem: str, dtype: pa.DataType, sequence: int, batch_sequences: int):
        self.fs, self.stem, self.sequence, self.rows, self.mark = fs, stem, sequence, batch_sequences, uuid.uuid4().hex[:8]
        self.schema = pa.schema([("ids", pa.list_(dtype, sequence)), ("mask", pa.list_(pa.bool_(), sequence))], {"sequence": str(sequence)})
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sink, self.index_sink = fs.open_output_stream(self._temporary(".arrow")), fs.open_output_stream(self._temporary(".index.arrow"))
        self.out, self.index = pa.ipc.new_file(self.sink, self.schema), pa.ipc.new_file(self.index_sink, self.index_schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_docs = self.n_tokens = self.n_sequences = 0

    def _temporary(self, suffix: str) -> str:
        return f"{self.stem}{suffix}.{self.mark}.tmp"

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        starts = np.cumsum(counts) - counts + self.n_tokens
        self.index.write_batch(pa.record_batch([doc_ids.cast(pa.int64()), pa.array(starts), pa.array(counts)], schema=self.index_schema))
        self.n_docs, self.n_tokens = self.n_docs + len(counts), self.n_tokens + len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        block = self.rows * self.sequence
        if self.n_held >= block:
            whole = np.concatenate(self.held)
            for i in range(len(whole) // block):
                self._put(whole[i * block : (i + 1) * block], block)
            self.held = [whole[len(whole) // block * block :].copy()]
            self.n_held = len(self.held[0])

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        kind = self.schema.field("ids").type.value_type
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(ids, kind), self.sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence)]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))
        self.n_sequences += len(ids) // self.sequence

    def close(self) -> None:
        if self.n_held:
            rest = np.concatenate(self.held)
            self._put(np.concatenate([rest, np.zeros(-len(rest) % self.sequence, rest.dtype)]), len(rest))
        for x in (self.out, self.index, self.sink, self.index_sink):
            x.close()
        for suffix in (".index.arrow", ".arrow"):
            self.fs.move(self._temporary(suffix), self.stem + suffix)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, vocabulary: int, end_id: int = 0, sequence: int = SEQUENCE, batch_sequences: int = BATCH_SEQUENCES, doc_id: str = "doc_id", text: str = "text", parts: int | None = None, special_as_text: bool = False) -> DataFrame:
    """Encode ``docs`` and write them under ``path`` (a URI that all executors reach); gives the manifest.

    Null texts are empty and get the end id alone; null ids come first.  Rows with equal ids follow
    each other by their text's hash; equal rows are written each.  Very long texts are encoded whole.
    An empty table gives an empty manifest.  Other columns, whatever their names, are not read.
    ``special_as_text``: see :func:`encode_texts`.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dtype = pa.uint16() if vocabulary <= 2**16 else pa.uint32()
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    ordered = ordered.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    pa.fs.FileSystem.from_uri(path)[0].create_dir(pa.fs.FileSystem.from_uri(path)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, folder = pa.fs.FileSystem.from_uri(path)
        writer = None
        for rows, texts in row_groups(batches, "text"):
            writer = writer or _Writer(fs, f"{folder}/part-{part:06d}", dtype, sequence, batch_sequences)
            ids, counts = encode_texts(tokenizer, texts, special_as_text)
            ends = np.cumsum(counts)
            writer.add(rows.column("doc_id"), np.insert(ids, ends, end_id), counts + 1)
        if writer:
            writer.close()
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([f"{path}/part-{part:06d}"]), *(pa.array([x], pa.int64()) for x in (writer.n_docs, writer.n_tokens, writer.n_sequences))], names=["part", "path", "n_docs", "n_tokens", "n_sequences"])

    ordered.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


class TokenFile:
    """Random access to one file: memory-mapped where the file system is local."""

    def __init__(self, stem: str):
        fs, at = pa.fs.FileSystem.from_uri(stem)
        opened = (lambda p: pa.memory_map(p)) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file
        self.data = pa.ipc.open_file(opened(at + ".arrow"))
        self.index = pa.ipc.open_file(opened(at + ".index.arrow"))
        self.sequence = int(self.data.schema.metadata[b"sequence"])
        self.rows = self.data.get_batch(0).num_rows if self.data.num_record_batches else 1
        self._at, self._ids = -1, np.empty(0)

    def _batch(self, i: int) -> np.ndarray:
        if i != self._at:
            self._at, self._ids = i, self.data.get_batch(i).column(0).flatten().to_numpy()
        return self._ids

    def sequence_at(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (no copy) and mask of sequence ``i``."""
        batch, row = self.data.get_batch(i // self.rows), i % self.rows
        return batch.column(0)[row].values.to_numpy(), batch.column(1)[row].values.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, count: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, in pieces that lie in one batch each."""
        block = self.rows * self.sequence
        while count > 0:
            ids = self._batch(start // block)
            piece = ids[start % block : start % block + count]
            yield piece
            start, count = start + len(piece), count - len(piece)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; ``start`` counts all ids before it.

    The running sum orders one row a file, not documents.
    """
    spark = manifest.sparkSession
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("offset", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").select("path", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(stem)
                for i in range(file.index.num_record_batches):
                    index = file.index.get_batch(i)
                    starts, counts = index.column(1).to_pylist(), index.column(2).to_pylist()
                    sums = []
                    for start, count in zip(starts, counts):
                        crc = 0
                        for piece in file.tokens(start, count):
                            crc = zlib.crc32(piece.astype("<u4"), crc)
                        sums.append(crc)
                    yield pa.record_batch([index.column(0), pa.array([s + offset for s in starts], pa.int64()), index.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_binary(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = write_token_files(docs, new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), vocabulary=50_257)
    return read_token_files(manifest)
