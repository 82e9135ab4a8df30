"""Helpers shared by the corpus operators: shared folders, file access in tasks, hashed word streams."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared

#: Keys with more than this part of all rows are joined by broadcast; there are fewer of them than this.
HOT_KEYS = 1000

_scratch: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str, scratch: bool = False) -> str:
    """A new folder under spark.checkpoint.dir; scratch folders go at the end of the surrounding scratch()."""
    path = shared.new_folder(spark, purpose)
    if scratch and _scratch:
        _scratch[-1].append(path)
    return path


def persisted(df: DataFrame, purpose: str, keep: bool = False) -> DataFrame:
    """Writes a frame to the shared folder and rereads it: cuts lineage and survives lost executors.

    keep: for what belongs to an operator's output, such as the index of its files.
    """
    return shared.stored(df, shared_dir(df.sparkSession, purpose, scratch=not keep))


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that persisted() writes within; what is made from them must be written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            shared.delete_folder(spark, path)


def join_by_key(rows: DataFrame, one: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """Joins rows with a table of one row per key, which counts the rows of each key in its column `rows`.

    Rows of keys that hold more than a HOT_KEYS-th of the total stay where they are and get their key's row by
    broadcast, HOT_KEYS rows at most; all others meet in a shuffle.
    """
    is_hot = F.col("rows") * HOT_KEYS > total
    hot, cold = one.where(is_hot).drop("rows"), one.where(~is_hot).drop("rows")
    if hot.isEmpty():
        return rows.join(cold, key, how)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def text_digest(text: str) -> Column:
    """16 bytes that tell texts apart; null for a null text."""
    return F.unhex(F.md5(F.col(text).cast("string")))


def key_of(doc_id: str) -> Column:
    """The identifier, or a number in place of a null, to join on."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))


def with_texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (digest, ...) with the text of their digest, read once for each.

    Of the documents with one text those with the smallest identifier are read, so that copies meet nowhere, and
    one of them where that identifier is repeated.
    """
    rows = docs.select(text_digest("text").alias("digest"), key_of("doc_id").alias("key"), F.col("text").cast("string").alias("text"))
    counts = rows.select("digest", "key").join(pairs.select("digest").distinct(), "digest", "left_semi").groupBy("digest", "key").agg(F.count("*").alias("n"))
    first = counts.groupBy("digest").agg(F.min(F.struct("key", "n")).alias("f"))
    first = persisted(first.select("digest", F.col("f.key").alias("key"), F.col("f.n").alias("n")), "first")
    if not first.where("n > 1").isEmpty():
        rows = rows.join(first.select("digest", "key"), ["digest", "key"]).groupBy("digest", "key").agg(F.first("text").alias("text"))
    return pairs.join(first.drop("n"), "digest").join(rows, ["digest", "key"]).drop("key")


def open_fs(path: str):
    """pyarrow's file system for a URI or a plain path, and the path within it; used inside tasks."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[len("file:") :]
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def fold(doc_id: Column) -> Column:
    """crc32 of the identifier as text, modulo 5; 0 is the held-out fold. Null for a null identifier."""
    return F.crc32(doc_id.cast("string")) % 5


def held_out(doc_id: Column) -> Column:
    """True where the fold is 0; a null identifier is never held out (and never trained on)."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def seeded_sample(rows: DataFrame, most: int, seed: int, *key: str, total: int | None = None) -> DataFrame:
    """At most `most` rows: those with the smallest seeded hashes of the first key column, ties by all of them.

    The hash is first cut at three times the wanted share, so that each task hands on only its part of a
    bounded number of rows. total: about how many rows there are, if that is known.
    """
    h = F.xxhash64(F.lit(seed), F.col(key[0]))
    share = 3 * most / max(1, rows.count() if total is None else total)
    if share < 1:
        rows = rows.where(h < F.lit(int(-(1 << 63) + share * (1 << 64))))
    return rows.withColumn("__h", h).orderBy("__h", *key).limit(most).drop("__h")


MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15
WORD_BYTE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, n of each."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, and the n + 1 offsets of the texts among them.

    A word is a run of ASCII letters and digits and of non-ASCII characters. Null texts have no words.
    """
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    buffer = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=at[1:])
    edge = np.diff(WORD_BYTE[buffer].view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(buffer) + 1)
    total = np.zeros(len(buffer) + 1, np.uint64)
    values = buffer.astype(np.uint64)
    values += np.uint64(1)
    values *= up[: len(buffer)]
    np.cumsum(values, out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts]), np.searchsorted(starts, at)


def text_groups(texts: list, most: int = 1 << 20):
    """Ranges (from, to) of consecutive texts with about `most` characters together; at least one text each."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
