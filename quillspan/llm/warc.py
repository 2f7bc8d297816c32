"""A deterministic sharded WARC writer and its reader.

Records are put into ranges of ascending id, one task a range; a task rolls to the next file when
the compressed size passes ``roll_bytes``.  Record ids, dates, lengths and digests are made anew
from the row alone, each record is its own gzip member without a time stamp, so the same table
gives the same bytes.  Files are written under temporary names and moved into place whole, and
the manifest (Parquet, a row a file) that Spark writes at the end is what commits them.

Payloads of at least ``min_bytes`` that occur more than once are stored once: the record with the
smallest id is the response, the others are revisits that point to it and hold HTTP headers alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path

ROLL_BYTES = 256 * 2**20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "part int, file int, path string, n_records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
EMPTY_DIGEST = base64.b32encode(hashlib.sha1(b"").digest()).decode()


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits are four base32 digits."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: int | None, row: int = 0) -> str:
    """A UUID of version 8 that holds the id; rows without one get theirs from part and place."""
    high, low = (0, page_id & (2**64 - 1)) if page_id is not None else (1 + (row >> 32), row & 0xFFFFFFFF)
    bits = (high << 80) | (8 << 76) | ((low >> 60) << 64) | (2 << 62) | (low & (2**60 - 1))
    return f"<urn:uuid:{uuid.UUID(int=bits)}>"


def _member(page_id, row, url, payload, digest, refers_to, level: int) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, row)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(url.split()))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    lines.append(f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Key: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Record-Key: {page_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    out = zlib.compressobj(level, zlib.DEFLATED, 31)
    return out.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + out.flush()


def referents(pages: DataFrame, *, key: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """key, digest, first: rows whose payload has a record with a smaller key, and that key.

    Payloads stay out of this: keys and digests alone are shuffled.  A payload that a third of the
    pages share is one row after partial aggregation, and its pages are an AQE-splittable join side.
    """
    rows = pages.where(F.length(payload) >= min_bytes).select(key, sha1_base32(F.col(payload)).alias("digest"))
    firsts = rows.groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    return rows.join(firsts, "digest").where(F.col(key).isNull() | (F.col(key) != F.col("first"))).select(key, "digest", "first").distinct()


def write_warc(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, level: int = 6, parts: int | None = None) -> DataFrame:
    """Write a record per row under ``path`` (a URI that all executors reach); gives the manifest.

    Null html is an empty payload.  Null keys come first, are never pointed at, and point to the
    smallest key of an equal payload if there is one.  Rows with the response's own key are
    responses too.  An empty table gives an empty manifest; other columns are not read.
    """
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    # what a row refers to travels as a row of its own that sorts before it: payloads are shuffled once
    found = referents(rows, key="key", payload="payload", min_bytes=min_bytes)
    marks = found.select("key", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", F.col("first").alias("refers_to"), F.lit(0).alias("is_page"))
    records_ = rows.select("key", "url", "payload", sha1_base32(F.col("payload")).alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("is_page"))
    rows = marks.unionByName(records_).repartitionByRange(parts, "key", "digest").sortWithinPartitions("key", "digest", "is_page", "url")
    fs, folder = pa.fs.FileSystem.from_uri(path)
    fs.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, mark = TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        fs, folder = pa.fs.FileSystem.from_uri(path)
        sink, file, count, size, row, mark_of = None, 0, 0, 0, part << 32, (None, None, None)

        def commit():
            sink.close()
            fs.move(f"{folder}/{name}.{mark}.tmp", f"{folder}/{name}")
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([f"{path}/{name}"]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["part", "file", "path", "n_records", "bytes"])

        for batch in batches:
            columns = [batch.column(c) for c in ("key", "url", "payload", "digest", "refers_to", "is_page")]
            for i in range(batch.num_rows):
                k, u, p, d, r, page = (c[i].as_py() for c in columns)
                if not page:
                    mark_of = (k, d, r)
                    continue
                r = mark_of[2] if mark_of[:2] == (k, d) else None
                if sink is None:
                    name, count, size = f"part-{part:06d}-{file:04d}.warc.gz", 0, 0
                    sink = fs.open_output_stream(f"{folder}/{name}.{mark}.tmp", compression=None)
                data = _member(k, row, u, p, d, r, level)
                sink.write(data)
                count, size, row = count + 1, size + len(data), row + 1
                if size >= roll_bytes:
                    yield commit()
                    sink, file = None, file + 1
        if sink is not None:
            yield commit()

    rows.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member of an open file, one member in memory at a time."""
    data, opened = b"", zlib.decompressobj(31)
    parts: list[bytes] = []
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            return
        parts.append(opened.decompress(data))
        data = b""
        if opened.eof:
            data, opened = opened.unused_data, zlib.decompressobj(31)
            head, _, block = b"".join(parts).partition(b"\r\n\r\n")
            parts = []
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield headers, block[: int(headers["Content-Length"])]


def read_warc(manifest: DataFrame) -> DataFrame:
    """What the archives say of each record; digests of responses are computed anew and must agree."""
    files = manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part", "file").select("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        number = lambda text: None if text is None else int(text)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = pa.fs.FileSystem.from_uri(path)
                rows = []
                with fs.open_input_stream(at, compression=None) as stream:
                    for headers, block in records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                        length = int(http.decode().lower().partition("content-length: ")[2].split("\r\n")[0])
                        if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{path}: payload of {headers['WARC-Record-ID']} is damaged")
                        rows.append((number(headers.get("X-Record-Key")), headers.get("WARC-Target-URI"), length, digest, kind, number(headers.get("X-Refers-To-Key"))))
                        if len(rows) == 4096:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return files.mapInArrow(read, RECORDS)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_warc(write_warc(pages, new_path(spark, "warc"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (5 * i + 1)::INT, 5))::BIGINT) AS g FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g[(i // 4 + 1)::INT] >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
