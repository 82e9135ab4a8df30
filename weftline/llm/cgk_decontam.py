"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts are sequences of symbols, overlapping pairs of words (hashed_words). The CGK random walk reads a
sequence symbol by symbol and, by a random bit per step and symbol, repeats or advances; its outputs are a
string whose Hamming distance stays small where the edit distance is small. A sample of BITS output places
is a key; each walk has SAMPLES samples. Walks are repeated until simulated passages with as many edits as
may be are found with a chance of RECALL (walks_for()); unedited passages always are.

Windows are item-sized: items of n words belong to the size class N, the largest power of two up to n. An item of
twice LONGEST words or more is cut into pieces of that class: of a passage with a fifth of its words edited, some
piece has a fifth of its own edited at most, so it is found at least as surely as that piece, and verified as a
whole. Walks and windows so depend on no item's length. Documents are cut into windows of each class in use at every N / 4 words, items at every word, so that
whatever a passage's place in a document some window starts at the same word as the item's.

Items of fewer than MIN_WORDS words may have one edit at most, none below five words. They are found exactly,
by the hashes of their word sequences: of the whole for no edit, and with one word left out on either side.

A fixed-size bitmap of the items' keys (2**BITMAP_BITS bits, the only thing broadcast) lets the document
side hand on little but true collisions; a join on the keys gives candidates, and Sellers' algorithm
verifies each on the whole text: the item matches if some passage is within (1 - MIN_SIMILARITY) n word
edits of it. Equal texts, of documents or items, are searched for and verified once.

Defined results: null and empty texts match nothing; an item without a word is not searched; rows with one
doc_id and different texts are reported together, with their best match; documents and items without
identifier are not reported, but clean() searches and removes by text and knows no identifiers; of equally
good passages the first is given; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, mixed, persisted, text_digest, text_groups, with_texts

MIN_WORDS, MIN_SIMILARITY = 8, 0.8
RECALL, SAMPLES, BITS, SEED = 0.98, 4, 2, 47
TRIALS = 400
BITMAP_BITS, SALTS = 26, 8
BLOCK = 1 << 14
#: The words of the largest size class; a power of two.
LONGEST = 64
A, B = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def edits_of(n: int, least: float = MIN_SIMILARITY) -> int:
    """How many edits an item of n words may have."""
    return int((1 - least) * n + 1e-9)


def size_class(n: int) -> int:
    """The largest power of two up to n, as an exponent."""
    return n.bit_length() - 1


def symbols(words: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words, and a closing 0 at which walks stay."""
    found = np.zeros(len(words) + 1, np.uint64)
    if len(words):
        following = np.zeros(len(words), np.uint64)
        following[:-1] = words[1:]
        found[:-1] = mixed(words * A + following) | np.uint64(1)
    return found


def sampled_places(size: int, walk: int) -> np.ndarray:
    """(SAMPLES, BITS) ascending output places of a walk over the windows of a class.

    A walk advances every other step, so places below 2 N (1 - 1 / 8) seldom lie beyond the window. Places of one
    sample lie apart, lest both show the same few words, which many texts hold.
    """
    rng = np.random.default_rng((SEED, size, walk))
    steps, found = (2 << size) * 7 // 8, []
    while len(found) < SAMPLES:
        places = np.sort(rng.choice(steps, BITS, replace=False))
        if (np.diff(places) >= steps // 8).all():
            found.append(places)
    return np.array(found)


def walk_keys(found: np.ndarray, starts: np.ndarray, size: int, walk: int) -> np.ndarray:
    """(SAMPLES, windows) keys of the windows at the starts; 0 where a window has ended before."""
    places = sampled_places(size, walk)
    wanted, last = set(places.ravel().tolist()), int(places.max())
    turns = []
    for part in range(last // 64 + 1):
        salt = np.uint64((SEED << 40) + (size << 32) + (walk << 16) + part)
        turn = mixed(found ^ mixed(np.array([salt]))[0])
        turn[found == 0] = 0
        turns.append(turn)
    keys = np.empty((SAMPLES, len(starts)), np.uint64)
    for b in range(0, len(starts), BLOCK):
        at, outputs = starts[b : b + BLOCK].copy(), {}
        bits = np.empty(len(at), np.uint64)
        for step in range(last + 1):
            if step in wanted:
                outputs[step] = found[at]
            np.take(turns[step // 64], at, out=bits, mode="clip")
            np.right_shift(bits, np.uint64(step % 64), out=bits)
            np.bitwise_and(bits, np.uint64(1), out=bits)
            np.add(at, bits.view(np.int64), out=at)
        for sample, (first, *others) in enumerate(places.tolist()):
            key = outputs[first] * A + np.uint64(walk * SAMPLES + sample + 1 + (size << 16))
            ended = outputs[first] == 0
            for place in others:
                key = mixed(key) + outputs[place] * B
                ended |= outputs[place] == 0
            key = mixed(key)
            key[ended] = 0
            keys[sample, b : b + BLOCK] = key
    return keys


@lru_cache(maxsize=256)
def walks_for(size: int, recall: float = RECALL, least: float = MIN_SIMILARITY) -> int:
    """The number of walks with which simulated items of a class are found with a chance of recall.

    The items have the lengths of the class and as many edits as may be, at random places of random kinds, and
    lie anywhere in other text.
    """
    rng, n_class = np.random.default_rng((SEED, size, 1)), 1 << size
    sides: tuple[list, list] = ([], [])
    for _ in range(TRIALS):
        item = rng.integers(1, 1 << 62, rng.integers(n_class, 2 * n_class)).astype(np.uint64)
        passage = item.tolist()
        for _ in range(edits_of(len(item), least)):
            kind, at = rng.integers(3), rng.integers(len(passage))
            passage[at : at + (kind < 2)] = [] if kind == 1 else [int(rng.integers(1, 1 << 62))]
        around = [rng.integers(1, 1 << 62, n_class + rng.integers(n_class)).astype(np.uint64) for _ in range(2)]
        sides[0].append(item)
        sides[1].append(np.concatenate([around[0], np.array(passage, np.uint64), around[1]]))
    prepared = []
    for k, texts in enumerate(sides):
        found = np.concatenate([symbols(t) for t in texts])
        sizes = np.array([len(t) + 1 for t in texts])
        inside = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if k:
            starts = np.flatnonzero((inside % max(1, n_class // 4) == 0) & (found != 0))
        else:
            starts = np.flatnonzero(inside < np.repeat(np.maximum(n_class // 4, sizes - n_class), sizes))
        prepared.append((found, starts, np.repeat(np.arange(len(texts)), sizes)[starts]))
    caught = np.zeros(TRIALS, bool)
    walk = 0
    while caught.mean() < recall:
        (a, owner_a), (b, owner_b) = ((walk_keys(f, s, size, walk), o) for f, s, o in prepared)
        for x, y in zip(a, b, strict=True):
            mine = np.where(x != 0, mixed(x + owner_a.astype(np.uint64) * A), 0)
            theirs = mixed(y + owner_b.astype(np.uint64) * A)
            caught[owner_b[(y != 0) & np.isin(theirs, mine)]] = True
        walk += 1
    return walk


def sequence_hashes(words: np.ndarray, n: int, left_out: int | None = None) -> np.ndarray:
    """A hash of the n words at each place of words, but the one left out; for all places with n words."""
    count = max(0, len(words) - n + 1)
    found = np.zeros(count, np.uint64)
    for k in range(n):
        if k != left_out:
            found = mixed(found * A + words[k : k + count])
    return found


def short_keys(words: np.ndarray, n: int, item: bool) -> list[np.ndarray]:
    """Keys at each place of words for items of n words, which may have one edit at most.

    An item and a passage within one edit are equal after at most one word is left out on each side.
    """
    salt = mixed(np.array([n], np.uint64))[0]
    found = [sequence_hashes(words, n)]
    if edits_of(n):
        found += [sequence_hashes(words, n, k) for k in range(n)]
        if not item:
            found += [sequence_hashes(words, n - 1), *(sequence_hashes(words, n + 1, k) for k in range(n + 1))]
    return [mixed(x ^ salt) | np.uint64(1) for x in found]


def class_of(n: int) -> int:
    """The size class of an item of n words; short lengths are classes of their own, as negative numbers."""
    return min(size_class(n), size_class(LONGEST)) if n >= MIN_WORDS else -n


def pieces_of(n: int) -> list[tuple[int, int]]:
    """The pieces of an item of n words: itself, or equal parts of LONGEST words and less than twice as many."""
    ends = [n * k // max(1, n // LONGEST) for k in range(max(1, n // LONGEST) + 1)]
    return list(zip(ends[:-1], ends[1:], strict=True))


def item_classes(items: DataFrame) -> list[int]:
    """The size classes in use: short lengths and powers of two."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.diff(hashed_words(batch.column(0).to_pylist())[1])
            yield pa.RecordBatch.from_pydict({"size": pa.array(sorted({class_of(n) for n in counts.tolist() if n}), pa.int32())})

    return sorted(r.size for r in items.select("text").mapInArrow(measure, "size int").distinct().collect())


def item_keys(items: DataFrame, walks: dict[int, int]) -> DataFrame:
    """(key, item): the keys of all windows of the items (item, text)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = hashed_words([text])[0]
                if not len(words):
                    continue
                size = class_of(len(words))
                if size < 0:
                    keys = np.concatenate(short_keys(words, len(words), True))
                else:
                    found = []
                    for b, e in pieces_of(len(words)):
                        starts = np.arange(max((1 << size) // 4, e - b - (1 << size) + 1))
                        found += [walk_keys(symbols(words[b:e]), starts, size, w).ravel() for w in range(walks[size])]
                    keys = np.concatenate(found)
                keys = np.unique(keys[keys != 0]).view(np.int64)
                yield pa.RecordBatch.from_pydict({"key": keys, "item": pa.array([item] * len(keys), pa.binary())})

    return items.select("item", "text").mapInArrow(measure, "key long, item binary")


def bitmap_of(keys: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap with the bits at the keys' lowest places set; at most 2**bits / 64 rows reach the driver."""
    place = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, int(key & 63))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("set"))
    bitmap = np.zeros(1 << bits - 6, np.int64)
    for row in words.toLocalIterator():
        bitmap[row.word] = row.set
    return bitmap.view(np.uint64)


def document_keys(docs: DataFrame, bitmap: np.ndarray, sizes: list[int], walks: dict[int, int]) -> DataFrame:
    """(key, digest) of the documents' (digest, text) windows whose key may be an item's."""
    shared, mask = docs.sparkSession.sparkContext.broadcast(bitmap), np.uint64((len(bitmap) << 6) - 1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value

        def hits(keys: np.ndarray) -> np.ndarray:
            low = keys & mask
            return np.flatnonzero((seen[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1)) & (keys != 0))

        for batch in batches:
            digests, texts = batch.column(0), batch.column(1).to_pylist()
            for b, e in text_groups(texts):
                words, at = hashed_words(texts[b:e])
                counts = np.diff(at)
                owner = np.repeat(np.arange(e - b), counts)
                rows = []
                for size in (s for s in sizes if s < 0):
                    for keys in short_keys(words, -size, False):
                        n = len(words) - len(keys) + 1
                        hit = hits(keys)
                        hit = hit[owner[hit] == owner[hit + n - 1]]
                        if len(hit):
                            rows.append(np.stack([owner[hit], keys[hit].view(np.int64)]))
                if walks:
                    # Every text is followed by a closing symbol.
                    found = np.concatenate([symbols(words[at[i] : at[i + 1]]) for i in range(e - b)])
                    owner = np.repeat(np.arange(e - b), counts + 1)
                    inside = np.arange(len(found)) - np.repeat(at[:-1] + np.arange(e - b), counts + 1)
                    for size, n_walks in walks.items():
                        starts = np.flatnonzero((inside % max(1, (1 << size) // 4) == 0) & (found != 0))
                        for walk in range(n_walks):
                            for keys in walk_keys(found, starts, size, walk):
                                hit = hits(keys)
                                if len(hit):
                                    rows.append(np.stack([owner[starts[hit]], keys[hit].view(np.int64)]))
                if rows:
                    pairs = np.unique(np.concatenate(rows, axis=1), axis=1)
                    yield pa.RecordBatch.from_pydict({"key": pairs[1], "digest": digests.take(pa.array(pairs[0] + b))})

    return docs.select("digest", "text").where(F.col("digest").isNotNull()).mapInArrow(search, "key long, digest binary")


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """The smallest number of word edits between the item and any passage of the text, and the passage's end.

    Sellers' recurrence over columns of bits: bit i of plus (minus) says that row i + 1 of the column is one
    more (less) than row i.
    """
    n = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << n - 1
    plus, minus, distance = full, 0, n
    best, end = n, 0
    for j, w in enumerate(text):
        equal = masks.get(w, 0)
        diagonal = ((equal & plus) + plus ^ plus | equal | minus) & full
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | ~(diagonal | up) & full
        minus = up & diagonal
        if distance < best:
            best, end = distance, j + 1
    return best, end


def verify(pairs: DataFrame, docs: DataFrame, items: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """(digest, item, distance, similarity, end_word) of the pairs (digest, item) that match; items: (item, wanted)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words, there = None, [], set()
        for batch in batches:
            rows, patterns = [], {}
            for doc, item, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc != last:
                    last, words = doc, hashed_words([text])[0].tolist()
                    there = set(words)
                pattern = patterns.get(item)
                if pattern is None:
                    pattern = patterns[item] = hashed_words([wanted])[0].tolist()
                most = edits_of(len(pattern), least)
                # Every word of the item that the text lacks is an edit.
                if sum(w not in there for w in pattern) > most:
                    continue
                distance, end = best_match(pattern, words)
                if distance <= most:
                    rows.append((doc, item, distance, 1 - distance / len(pattern), end))
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], ["digest", "item", "distance", "similarity", "end_word"])

    rows = with_texts(docs, pairs.join(items, "item")).select("digest", "item", "text", "wanted")
    return rows.mapInArrow(compare, "digest binary, item binary, distance int, similarity double, end_word int")


def matches(docs: DataFrame, items: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """(digest, item, distance, similarity, end_word): by the texts' digests, what documents hold what items."""
    wanted = items.select(text_digest("text").alias("item"), F.col("text").cast("string").alias("text")).where(F.col("item").isNotNull())
    wanted = persisted(wanted.groupBy("item").agg(F.first("text").alias("text")), "cgk-wanted")
    sizes = item_classes(wanted)
    walks = {size: walks_for(size, least=least) for size in sizes if size >= 0}
    keys = persisted(item_keys(wanted, walks), "cgk-items")
    texts = docs.select(text_digest("text").alias("digest"), F.col("text").cast("string").alias("text"))
    hits = document_keys(texts, bitmap_of(keys), sizes, walks).distinct()
    # A key that many documents hold is dealt over SALTS tasks; the items' side is small beside the documents'.
    hits = hits.withColumn("salt", F.pmod(F.hash("digest"), F.lit(SALTS)))
    salted = keys.select("key", "item", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = persisted(hits.join(salted, ["key", "salt"]).select("digest", "item").distinct(), "cgk-pairs")
    return persisted(verify(pairs, docs, wanted.withColumnRenamed("text", "wanted"), least), "cgk-matches")


def contamination(docs: DataFrame, items: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """doc_id, item_id, distance, similarity, end_word: the best passage of each contaminated document and item."""
    found = matches(docs, items, least)
    named = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), text_digest("text").alias("item")).distinct()
    found = found.join(named, "item").select("digest", "item_id", "distance", "similarity", "end_word")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_digest("text").alias("digest")).distinct()
    best = F.min(F.struct("distance", "end_word", "similarity")).alias("m")
    return rows.join(found, "digest").groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.distance", "m.similarity", "m.end_word")


def clean(docs: DataFrame, items: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """All columns of the documents that hold no item."""
    found = persisted(matches(docs, items, least).select(F.col("digest").alias("__digest")).distinct(), "cgk-found")
    return docs.join(found, text_digest("text") == F.col("__digest"), "left_anti").select(*docs.columns)
