"""Token-ID output as sorted-string-table shards, with binary-search lookup.

Documents are range-partitioned and sorted by identifier; every task encodes its documents and writes
one shard file to the shared folder. A shard holds prefix-compressed, deflated blocks of (key, ids)
entries, a sparse index with the first key of each block, a Bloom filter and a footer:

    block*  index  bloom  footer(64 bytes)

Keys are 9 bytes: 0 for a null identifier, else 1 and the identifier as a big-endian integer with its
sign bit turned, so that byte order is the order of Spark's ascending sort (nulls first). Ids take two
bytes each where the vocabulary allows, else four. The manifest holds each shard's smallest and largest
identifier (null where the shard begins, or ends too, with null ones), so that a lookup opens only shards
that may hold what it seeks. A writer keeps eight bytes per document of its shard for the filter.

Defined results: a null or empty text is the end id alone; repeated rows and equal identifiers are each
kept, side by side, in the order of the text's hash; an empty table gives no shard and no row; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import bisect
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mixed, open_fs, persisted, shared_dir

MAGIC = b"WSST0001"
FOOTER = struct.Struct("<QQQQQQII8s")
END_ID = 1
BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
CACHE_WORDS = 600_000
MANIFEST = "shard int, path string, first long, last long, n_docs long, n_tokens long, n_bytes long"

_encoders: dict[str, ChunkEncoder] = {}


class ChunkEncoder:
    """The library's encoding of whole texts, with the ids of chunks between white space kept for reuse.

    The tokenizer drops white space before it merges, so the ids of a text are those of its chunks in
    turn. Texts for which this might not hold (control characters that only Python counts as white
    space, special tokens, the separator used here) are encoded whole.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.separator = "\x01"
        self.separator_ids = self.whole(self.separator)
        self.special = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> ChunkEncoder:
        """One encoder for a worker process, kept over its tasks."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def chunks(self, text: str) -> list[str] | None:
        """The chunks to look up, or None for a text to be encoded whole."""
        if any(c in text for c in (self.separator, "\x1c", "\x1d", "\x1e", "\x1f", *self.special)) or len(self.separator_ids) != 1:
            return None
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:  # lower case and composed forms are left to the library
                return text.split()
        return text.lower().split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Of each text the ids, without an end id, as bytes of self.dtype."""
        split = [self.chunks(t) if t else [] for t in texts]
        known = self.known
        missing = list(dict.fromkeys(c for chunks in split if chunks for c in chunks if c not in known))
        new = {}
        for at in range(0, len(missing), 5000):
            part = missing[at : at + 5000]
            ids = self.whole(f" {self.separator} ".join(part))
            cut = np.flatnonzero(ids == self.separator_ids[0])
            data, width = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            begins, ends = [0, *((cut + 1) * width).tolist()], [*(cut * width).tolist(), len(data)]
            new.update(zip(part, (data[b:e] for b, e in zip(begins, ends, strict=True)), strict=True))
        if len(known) + len(new) <= CACHE_WORDS:
            known.update(new)
            new = known
        elif new:
            new = ChainedIds(known, new)
        else:
            new = known
        return [self.whole(t).astype(self.dtype).tobytes() if c is None else b"".join(map(new.__getitem__, c)) for t, c in zip(texts, split, strict=True)]


class ChainedIds(dict):
    """The words of one batch that the full cache doesn't take, before those of the cache."""

    def __init__(self, known: dict[str, bytes], new: dict[str, bytes]):
        super().__init__(new)
        self.known = known

    def __missing__(self, word: str) -> bytes:
        return self.known[word]


def to_key(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def from_key(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def bloom_places(keys: np.ndarray, bits: int) -> np.ndarray:
    """BLOOM_HASHES places per key hash."""
    a = mixed(keys)
    b = mixed(a ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return (a[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


def key_number(key: bytes) -> int:
    return int.from_bytes(key, "big") & (1 << 64) - 1


class ShardWriter:
    """Entries must come in ascending key order."""

    def __init__(self, path: str, dtype: np.dtype):
        fs, inner = open_fs(path)
        fs.create_dir(os.path.dirname(inner), recursive=True)
        self.out = fs.open_output_stream(inner, compression=None)
        self.dtype, self.offset, self.n_docs, self.n_tokens = dtype, 0, 0, 0
        self.block, self.size, self.first, self.last = [], 0, b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys, self.least = array("Q"), b""

    def add(self, key: bytes, value: bytes) -> None:
        if not self.block:
            self.first, self.last = key, b""
        self.least = self.least or key
        shared = len(os.path.commonprefix([self.last, key]))
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.last = key
        self.n_docs += 1
        self.n_tokens += len(value) // self.dtype.itemsize
        self.keys.append(key_number(key))
        if self.size >= BLOCK_BYTES:
            self.end_block()

    def end_block(self) -> None:
        if self.block:
            data = zlib.compress(b"".join(self.block), 1)
            self.index.append((self.first, self.offset, len(data)))
            self.write(data)
            self.block, self.size = [], 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.offset += len(data)

    def close(self) -> None:
        self.end_block()
        index_at = self.offset
        self.write(b"".join(varint(len(k)) + k + varint(at) + varint(n) for k, at, n in self.index))
        bloom_at, bits = self.offset, max(64, BLOOM_BITS * self.n_docs)
        field = np.zeros(bits, bool)
        for i in range(0, len(self.keys), 1 << 16):
            field[bloom_places(np.array(self.keys[i : i + (1 << 16)], np.uint64), bits).ravel()] = True
        self.write(np.packbits(field).tobytes())
        self.write(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, bits, self.n_docs, self.n_tokens, self.dtype.itemsize, 0, MAGIC))
        self.out.close()


class ShardReader:
    """Reads a shard by its footer; blocks are read one at a time."""

    def __init__(self, path: str):
        fs, inner = open_fs(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        index_at, index_n, self.bloom_at, self.bits, self.n_docs, self.n_tokens, width, _, magic = FOOTER.unpack(self.at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.dtype, self.bloom = np.dtype(f"<u{width}"), None
        data, at, self.first, self.blocks = self.at(index_at, index_n), 0, [], []
        while at < len(data):
            n, at = read_varint(data, at)
            self.first.append(data[at : at + n])
            offset, at = read_varint(data, at + n)
            n, at = read_varint(data, at)
            self.blocks.append((offset, n))

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        data, at, key = zlib.decompress(self.at(*self.blocks[k])), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def entries(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def may_hold(self, key: bytes) -> bool:
        if self.bloom is None:
            self.bloom = np.frombuffer(self.at(self.bloom_at, (self.bits + 7) // 8), np.uint8)
        places = bloom_places(np.array([key_number(key)], np.uint64), self.bits)[0].astype(np.int64)
        return bool(((self.bloom[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all documents with this identifier."""
        key, found = to_key(doc_id), []
        if self.blocks and self.may_hold(key):
            for k in range(max(0, bisect.bisect_left(self.first, key) - 1), bisect.bisect_right(self.first, key)):
                found += [np.frombuffer(v, self.dtype) for x, v in self.block(k) if x == key]
        return found

    def close(self) -> None:
        self.file.close()


def write_sstables(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Writes the shards and returns their manifest (MANIFEST), itself kept in the shared folder.

    The one shuffle carries (identifier, text). The text's hash is the second sort key, so a repeated
    identifier with a large part of all rows is spread over shards too.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, writer, path = ChunkEncoder.of(tokenizer_path), None, ""
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    if writer is None:
                        path = f"{folder}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.sst"
                        writer = ShardWriter(path, encoder.dtype)
                    writer.add(to_key(key), ids + end)
        if writer is not None:
            writer.close()
            ends = {"first": pa.array([from_key(writer.least)], pa.int64()), "last": pa.array([from_key(writer.last)], pa.int64())}
            yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [path], **ends, "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens], "n_bytes": [writer.offset]})

    keyed = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = keyed.repartitionByRange(n, "k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")
    return persisted(ordered.mapInArrow(write, MANIFEST), "sst-manifest", keep=True)


def read_sstables(manifest: DataFrame) -> DataFrame:
    """One row per stored document, read back from the shards: doc_id, start, n_tokens, ids_crc32, shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                reader, rows = ShardReader(path), []
                for key, value in reader.entries():
                    ids = np.frombuffer(value, reader.dtype)
                    rows.append((from_key(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard))
                    start += len(ids)
                    if len(rows) == 4096:
                        yield as_batch(rows)
                        rows = []
                reader.close()
                if rows:
                    yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    placed = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def lookup(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the given identifiers, found by Bloom filter and binary search in the shards that may hold them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = to_key(first), to_key(last)
                wanted = [d for d in doc_ids if low <= to_key(d) <= high]
                if not wanted:
                    continue
                reader = ShardReader(path)
                found = [(d, ids.tolist()) for d in wanted for ids in reader.get(d)]
                reader.close()
                if found:
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in found], pa.int64()), "ids": pa.array([x for _, x in found], pa.list_(pa.int64()))})

    return manifest.select("path", "first", "last").mapInArrow(find, "doc_id long, ids array<long>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_table(docs: DataFrame, tokenizer_path: str | None = None, **options) -> DataFrame:
    """Writes all documents as shards, then reads the shards back as a table."""
    spark: SparkSession = docs.sparkSession
    return read_sstables(write_sstables(docs, tokenizer_path or default_tokenizer(), shared_dir(spark, "sst"), **options))
