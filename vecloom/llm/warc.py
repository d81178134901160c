"""WARC: archives written one gzip member per record, and read back as a chunked record table.

A payload is never put together in memory: the writer feeds slices of the Arrow buffer to the compressor, the reader
inflates a record piece by piece and emits rows of (record id, chunk number), each with the bytes so far and the
digest so far, so the last chunk's row carries the digest of the whole. Files rotate at ``file_bytes`` and are written under a
temporary name and renamed; only names returned by tasks that ended are read, so a lost executor leaves at most
an unread file.

Defined results: a null html is an empty payload; a null url gives a record without a target; control characters and spaces
of a url are percent-encoded in the header; rows that share the smallest page_id of a payload are all responses; a null
page_id is never the smallest, unless all of its payload's are null, which are then responses; extra columns are ignored; an
empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import fitting_join, remote, shared_dir, staged

CHUNK = 1 << 20
FILE_BYTES = 64 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "path string, records long"
TABLE = "record_id string, page_id long, record_type string, refers_to long, target_uri string, declared_bytes long, declared_digest string, chunk int, last boolean, bytes_so_far long, digest_so_far string"


def _record_id(page_id: int | None) -> bytes:
    return b"<urn:x-page:%s>" % (b"" if page_id is None else b"%d" % page_id)


def _page_id(record_id: str | None) -> int | None:
    tail = (record_id or "").rpartition(":")[2].rstrip(">")
    return int(tail) if tail else None


def _uri(url: str) -> bytes:
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode())


class _Out:
    """Archives of one task: opened when needed, rotated by size, renamed when whole."""

    def __init__(self, folder: str):
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.uri, self.stream, self.done = folder, None, []

    def write(self, data: bytes) -> None:
        if self.stream is None:
            self.name, self.size, self.records = uuid.uuid4().hex, 0, 0
            self.stream = self.fs.open_output_stream(f"{self.folder}/.{self.name}.part", compression=None, buffer_size=1 << 20)
        self.stream.write(data)
        self.size += len(data)

    def end_record(self) -> None:
        self.records += 1
        if self.size >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.fs.move(f"{self.folder}/.{self.name}.part", f"{self.folder}/{self.name}.warc.gz")
            self.done.append((f"{self.uri}/{self.name}.warc.gz", self.records))
            self.stream = None


def write_batches(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, sha1, first) to archive files; ``first`` is the page that a revisit refers to, or null."""
    out = _Out(folder)
    for batch in batches:
        payloads = batch.column(2).cast(pa.binary())
        ids, urls, digests, firsts = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
        for i, (page_id, url, digest, first) in enumerate(zip(ids, urls, digests, firsts)):
            payload = memoryview(payloads[i].as_buffer()) if payloads[i].is_valid else memoryview(b"")
            body = b"" if first is not None else HTTP % len(payload)
            head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if first is None else b"revisit"), b"WARC-Record-ID: " + _record_id(page_id), b"WARC-Date: " + date.encode()]
            if url is not None:
                head.append(b"WARC-Target-URI: " + _uri(url))
            if first is not None:
                head += [b"WARC-Refers-To: " + _record_id(first), b"WARC-Profile: " + PROFILE]
            head += [b"WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)), b"X-Payload-Length: %d" % len(payload)]
            head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % (len(body) + (len(payload) if first is None else 0)), b"", b""]
            packer = zlib.compressobj(1, zlib.DEFLATED, 31)
            out.write(packer.compress(b"\r\n".join(head) + body))
            if first is None:
                for at in range(0, len(payload), CHUNK):
                    out.write(packer.compress(payload[at : at + CHUNK]))
            out.write(packer.compress(b"\r\n\r\n") + packer.flush())
            out.end_record()
    out.close()
    if out.done:
        paths, records = zip(*out.done)
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(records, pa.int64())], ["path", "records"])


class _Member:
    """The inflated bytes of one gzip member at a time, in pieces of at most ``CHUNK``."""

    def __init__(self, stream):
        self.stream, self.raw = stream, b""

    def open(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(1 << 18)
        self.unpack, self.held = zlib.decompressobj(31), b""
        return bool(self.raw)

    def more(self) -> bytes:
        while not self.unpack.eof:
            if not self.raw:
                self.raw = self.stream.read(1 << 18)
                if not self.raw:
                    raise EOFError("archive ends within a record")
            data = self.unpack.decompress(self.raw, CHUNK)
            self.raw = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if data:
                return data
        return b""

    def until(self, mark: bytes) -> bytes:
        while (at := self.held.find(mark)) < 0:
            data = self.more()
            if not data:
                raise ValueError("record without an end of its head")
            self.held += data
        head, self.held = self.held[:at], self.held[at + len(mark) :]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        """Exactly n bytes, in pieces."""
        while n:
            data = self.held or self.more()
            if not data:
                raise ValueError("record shorter than declared")
            self.held = data[n:] if len(data) > n else b""
            data = data[:n]
            n -= len(data)
            yield data

    def skip(self) -> None:
        while self.more():
            pass


def _chunks(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Regroup pieces into chunks of exactly CHUNK bytes but for the last."""
    held: list[bytes] = []
    size = 0
    for piece in pieces:
        while size + len(piece) >= CHUNK:
            cut = CHUNK - size
            yield b"".join([*held, piece[:cut]])
            held, size, piece = [], 0, piece[cut:]
        if piece:
            held.append(piece)
            size += len(piece)
    if held:
        yield b"".join(held)


def read_batches(batches: Iterator[pa.RecordBatch], with_data: bool) -> Iterator[pa.RecordBatch]:
    """Archive paths to the chunked record table."""
    schema = pa.schema(
        [("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("declared_bytes", pa.int64()), ("declared_digest", pa.string())]
        + [("chunk", pa.int32()), ("last", pa.bool_()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string())] + [("data", pa.binary())] * with_data
    )
    rows: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal held
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows.clear()
        held = 0
        return out

    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, name = pyarrow.fs.FileSystem.from_uri(path)
            with fs.open_input_stream(name, compression=None) as stream:
                member = _Member(stream)
                while member.open():
                    head = dict(x.split(": ", 1) for x in member.until(b"\r\n\r\n").decode().split("\r\n")[1:])
                    record = (
                        head["WARC-Record-ID"], _page_id(head["WARC-Record-ID"]), head["WARC-Type"], _page_id(head.get("WARC-Refers-To")), head.get("WARC-Target-URI"),
                        int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].partition(":")[2],
                    )
                    left = int(head["Content-Length"])
                    digest, total, number, waiting = hashlib.sha1(), 0, 0, b""
                    if left:
                        http = member.until(b"\r\n\r\n")
                        left -= len(http) + 4
                    for chunk in _chunks(member.take(left)):
                        digest.update(chunk)
                        total += len(chunk)
                        last = total == left
                        rows.append((*record, number, last, total, base64.b32encode(digest.digest()).decode(), *([chunk] * with_data)))
                        held += len(chunk) * with_data
                        number += 1
                        if held >= 8 * CHUNK:
                            yield flush()
                    if not number:  # no payload: one row says so
                        rows.append((*record, 0, True, 0, base64.b32encode(digest.digest()).decode(), *([b""] * with_data)))
                    member.skip()
                    if len(rows) >= 2000:
                        yield flush()
    if rows:
        yield flush()


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, sha1, first): ``first`` is null for responses. Equal payloads have equal SHA-256."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha1"))
    keys = pages.select("page_id", F.sha2(payload, 256).alias("key"))
    groups = keys.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    revisits = staged(keys.join(groups, "key").where("page_id is null or page_id <> first").select("page_id", "key", "first").distinct(), "revisits")
    wide = keyed.withColumn("key", F.sha2(payload, 256))
    return fitting_join(wide, revisits.select("key", F.coalesce("page_id", F.lit(-1)).alias("_id"), (F.col("page_id").isNull()).alias("_null"), "first"), [F.coalesce("page_id", F.lit(-1)) == F.col("_id"), F.col("page_id").isNull() == F.col("_null"), wide["key"] == revisits["key"]]).select("page_id", "url", "html", "sha1", "first")


def write(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row; returns the archives that were completed (path, records)."""
    spark = pages.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return staged(with_revisits(pages).mapInArrow(remote(write_batches, folder, date), FILES), "archives")


def read(files: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in ``files``; without data, its columns of measures alone."""
    n = max(1, min(files.count(), 10_000))
    return files.select("path").repartition(n, "path").mapInArrow(remote(read_batches, with_data), TABLE + (", data binary" if with_data else ""))


def records(table: DataFrame) -> DataFrame:
    """One row per record: the last chunk's; a revisit has the declared length and digest of the payload it repeats."""
    last = table.where("last")
    full = F.col("record_type") == "response"
    return last.select(
        "page_id",
        F.when(full, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(full, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to a new folder of the shared place, read them back, and return one row per record."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    from ..runtime import _remove_at_exit

    _remove_at_exit(pages.sparkSession, folder)
    return records(read(write(pages, folder), with_data=False))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT p.page_id AS page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST(('0x' || substr(p.x, CAST(5 * (i // 4) + 1 AS BIGINT), 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = f.first THEN NULL ELSE f.first END AS refers_to
FROM p JOIN f ON p.h = f.h
"""
