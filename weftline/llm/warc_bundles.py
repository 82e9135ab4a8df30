"""WARC archives as seekable Zstandard bundles.

Each task packs its records into independent frames, writes them as one file with a footer seek table in
the seekable format (a skippable frame), and returns an index that maps record identifiers to frames and
offsets within them. Reading goes through the seek tables: a task reads runs of FRAMES_PER_READ frames.

Records with equal payloads of at least MIN_SHARED bytes share one: that with the smallest page_id is a
response, the others are revisits that name it and carry no payload. Equal payloads are found by their digests
alone. Responses are written first, where their pages were read as long as the table of shared digests is
small enough for Spark to broadcast; beyond that this join deals payloads by digest once, hot digests aside.
Revisits follow, with the identifiers that the index gives for the responses.

Identifiers hold the bundle and the place in it besides the page, so repeated rows have different ones.

Defined results: a null html has an empty payload; shorter payloads are always responses; a null page_id
is always a response and never referred to; repeated rows that hold the smallest page_id are all
responses, and revisits name one of these; an empty table gives no file; columns other than page_id, url
and html are not read.
"""

from __future__ import annotations

import hashlib
import os
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, open_fs, persisted, shared_dir

MIN_SHARED = 100
FRAME_BYTES, FRAMES_PER_READ = 1 << 18, 16
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
INDEX = "record_id string, page_id long, digest string, path string, frame int, offset long, length long"


def record_id(page_id: int | None, bundle: str, number: int) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{bundle}:{number}>"


def page_of(identifier: str | None) -> int | None:
    page = identifier.split(":")[2] if identifier else "none"
    return None if page == "none" else int(page)


def warc_record(identifier: str, url: str | None, n: int, digest: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record of a payload of n bytes; a revisit holds the HTTP header only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": identifier,
        "WARC-Date": DATE,
        "WARC-Target-URI": urllib.parse.quote(url or "", safe=":/?#[]@!$&'()*+,;=%~"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http;msgtype=response",
    }
    if refers_to is None:
        block += payload
    else:
        headers["WARC-Refers-To"] = refers_to
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], int, bytes]]:
    """(offset, length, headers, length of the full payload, payload) of each record of a frame."""
    at = 0
    while at < len(data):
        middle = data.index(b"\r\n\r\n", at)
        lines = data[at:middle].decode("utf-8").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("no WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        begin = middle + 4
        end = begin + int(headers["Content-Length"])
        body = data.index(b"\r\n\r\n", begin, end) + 4
        http = dict(x.split(": ", 1) for x in data[begin : body - 4].decode("ascii").split("\r\n")[1:])
        yield at, end + 4 - at, headers, int(http["Content-Length"]), data[body:end]
        at = end + 4


class BundleWriter:
    """Appends records; a frame ends once it holds FRAME_BYTES."""

    def __init__(self, path: str):
        import zstandard

        fs, inner = open_fs(path)
        fs.create_dir(os.path.dirname(inner), recursive=True)
        self.out, self.compress = fs.open_output_stream(inner, compression=None), zstandard.ZstdCompressor(level=LEVEL).compress
        self.records, self.size, self.frames = [], 0, []

    def add(self, record: bytes) -> tuple[int, int]:
        """The frame and the offset in it."""
        if self.size >= FRAME_BYTES:
            self.end_frame()
        place = len(self.frames), self.size
        self.records.append(record)
        self.size += len(record)
        return place

    def end_frame(self) -> None:
        if self.records:
            data = self.compress(b"".join(self.records))
            self.out.write(data)
            self.frames.append((len(data), self.size))
            self.records, self.size = [], 0

    def close(self) -> None:
        self.end_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to frames by the footer's seek table."""

    def __init__(self, path: str):
        import zstandard

        fs, inner = open_fs(path)
        self.file, self.decompress = fs.open_input_file(inner), zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.read(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        table = self.read(size - 9 - 8 * n, 8 * n)
        self.frames, at = [], 0
        for k in range(n):
            packed, full = struct.unpack_from("<II", table, 8 * k)
            self.frames.append((at, packed, full))
            at += packed

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        at, packed, _ = self.frames[k]
        return self.decompress(self.read(at, packed))

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]

    def close(self) -> None:
        self.file.close()


def write_records(rows: DataFrame, folder: str) -> DataFrame:
    """Writes one bundle per task of (page_id, url, n, digest, payload, refers_to) and gives its part of the index."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, bundle, number = None, uuid.uuid4().hex, 0
        path = f"{folder}/bundle-{bundle}.warc.zst"
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = []
                for page, url, n, digest, payload, refers in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                    writer = writer or BundleWriter(path)
                    name = record_id(page, bundle, number)
                    record = warc_record(name, url, n, digest, payload, refers)
                    found.append((name, page, digest, path, *writer.add(record), len(record)))
                    number += 1
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["record_id", "page_id", "digest", "path", "frame", "offset", "length"])
        if writer is not None:
            writer.close()

    return rows.select("page_id", "url", "n", "digest", "payload", "refers_to").mapInArrow(write, INDEX)


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Writes all pages as bundles and returns the index (INDEX), itself kept in the shared folder."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.length(payload).alias("n"), F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
    marks = persisted(rows.drop("payload"), "warc-digests")
    named = F.col("page_id").isNotNull() & (F.col("n") >= MIN_SHARED)
    shared = marks.where(named).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("*").alias("rows"))
    shared = persisted(shared.where(F.col("first") < F.col("last")).select("digest", "first", "rows"), "warc-shared")
    total = marks.count()
    again = F.coalesce(named & (F.col("page_id") > F.col("first")), F.lit(False))
    first = join_by_key(rows, shared, "digest", total, "left").where(~again).withColumn("refers_to", F.lit(None).cast("string"))
    index = persisted(write_records(first, folder), "warc-index", keep=True)
    # One record of each shared payload, by its page; repeated rows have several.
    named_by = index.select("digest", F.col("page_id").alias("page"), "record_id").join(shared, "digest").where(F.col("page") == F.col("first"))
    named_by = persisted(named_by.groupBy("digest", "first").agg(F.min("record_id").alias("refers_to"), F.max("rows").alias("rows")), "warc-responses")
    later = join_by_key(marks, named_by, "digest", total).where(again).withColumn("payload", F.lit(b""))
    return index.unionByName(persisted(write_records(later, folder), "warc-revisits", keep=True))


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the indexed bundles: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest is computed from the payload read back and checked against its header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = BundleReader(path)
                for k in range(begin, min(begin + FRAMES_PER_READ, len(reader.frames))):
                    rows = []
                    for _, _, headers, n, payload in parse_records(reader.frame(k)):
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if headers["WARC-Type"] == "response":
                            n, found = len(payload), hashlib.sha256(payload).hexdigest()
                            if found != digest:
                                raise ValueError(f"{path}: damaged payload")
                        rows.append((page_of(headers["WARC-Record-ID"]), n, digest, headers["WARC-Type"], page_of(headers.get("WARC-Refers-To"))))
                    columns, kinds = list(zip(*rows, strict=True)), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                reader.close()

    bundles = index.groupBy("path").agg(F.max("frame").alias("last"))
    runs = bundles.select("path", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(FRAMES_PER_READ))).alias("begin"))
    # A number of partitions that adaptive execution leaves alone: the rows are few, the files behind them aren't.
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(n, "path", "begin").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_table(pages: DataFrame) -> DataFrame:
    """Writes all pages as bundles and reads the bundles back."""
    return read_bundles(write_bundles(pages, shared_dir(pages.sparkSession, "warc")))


#: The same rows from the table itself.
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, CASE WHEN n >= {MIN_SHARED} THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM q
"""
