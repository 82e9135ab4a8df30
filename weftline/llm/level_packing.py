"""Packing documents into windows of fixed size by the sum-of-squares rule.

A task reads its documents in turn, encodes them and places each at once. Every full window's worth of a
document is a sequence of its own; what remains goes to the fill level that makes the sum of squares of the
level array smallest, where the array counts the partly filled windows of each level (an empty window is
level 0, a filled one no longer counts). Of equally good levels the fullest is taken. Nothing is shuffled,
and a task keeps only its open windows.

Where MOST_OPEN windows are open, and at a task's end, the open windows are closed: the emptiest are taken
apart and their pieces, cut where needed, fill up the fullest. What then remains of a task is less than one
window, and is cut into sequences whose lengths are powers of two, which need no padding.

Defined results: a null or empty text is the end id alone; repeated rows and equal identifiers are each
packed, a null identifier stays null; an empty table gives no rows; other columns, whatever their names, are
not read. Which documents share a window depends on how the input is split into tasks. The pieces are stored,
so that a task that runs again can't change what others have read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persisted

WINDOW, END_ID, MOST_OPEN = 1024, 0, 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
CACHE_WORDS, CACHE_CHARS = 600_000, 40
#: A run of white space with the word after it, or white space at the end: the tokenizer never merges over their borders.
CHUNK = re.compile(r"\s*\S+|\s+")
OTHER_WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (10, 32)]
#: Letters, and the marks after them that the tokenizer takes apart from them; of both it is certain in every version of Unicode.
WORD = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")

_encoders: dict[str, ByteEncoder] = {}


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: itself where it is visible, else those from U+0100 on."""
    hidden = [b for b in range(256) if b <= 32 or 127 <= b <= 160 or b == 173]
    return [chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)]


class ByteEncoder:
    """The library's ids of whole texts, with those of words kept for reuse.

    The byte-level tokenizer cuts a text before white space that follows a word, so the ids of a text are
    those of its chunks (CHUNK) in turn. Where blanks and line breaks stand alone, or two line breaks
    together, a cut before every blank and around every line break gives the same. Words of Latin letters go
    to the library's model directly, other chunks through all of it. Texts with a special token, or with
    control characters that only Python counts as white space, are encoded whole.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model, letters = self.tokenizer.model, byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self.blank = letters[32]
        self.whole_if = ["\x1c", "\x1d", "\x1e", "\x1f", *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.known: dict[str, bytes] = {"": b"", **{m: self.whole(m) for m in ".,;:!?"}}

    @classmethod
    def of(cls, path: str) -> ByteEncoder:
        """One encoder for a worker process, kept over its tasks."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def chunks(self, text: str) -> list[str]:
        odd = text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or "\0" in text
        if odd or any(c in text for c in OTHER_WHITE):
            return CHUNK.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def chunk(self, chunk: str) -> bytes:
        """The ids of a chunk that isn't known yet."""
        if found := WORD.fullmatch(chunk):
            word, marks = found.groups()
            ids = self.known.get(word) if marks else None
            if ids is None:
                written = word.replace(" ", self.blank) if word.isascii() else word.translate(self.letters)
                ids = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
            if not marks:
                return ids
            return ids + (self.known[marks] if marks in self.known else self.whole(marks))
        return self.whole(chunk)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        if any(c in text for c in self.whole_if):
            return self.whole(text)
        chunks, known = self.chunks(text), self.known
        new = {c: self.chunk(c) for c in set(chunks).difference(known)}
        if len(known) < CACHE_WORDS:
            known.update((c, ids) for c, ids in new.items() if len(c) <= CACHE_CHARS)
            if len(known) < CACHE_WORDS and all(len(c) <= CACHE_CHARS for c in new):
                return b"".join(map(known.__getitem__, chunks))
        return b"".join([new[c] if c in new else known[c] for c in chunks])


class LevelPacker:
    """The level array and the open windows of one task; yields pieces of windows that are done.

    A piece is (document, start, ids); a done window is (number, its pieces in order).
    """

    def __init__(self, size: int = WINDOW, most_open: int = MOST_OPEN):
        self.size, self.most_open = size, most_open
        self.counts = np.zeros(size, np.int64)
        # Twice the counts as the rule weighs them: `there` of the level reached (a filled window costs nothing),
        # `here` of the level left (a new window takes none away, and a level without windows can't be left).
        self.there, self.here = np.zeros(size + 1, np.int64), np.full(size, -(1 << 60), np.int64)
        self.there[size], self.here[0] = -1, 1
        self.levels: list[list[tuple[int, list]]] = [[] for _ in range(size)]
        self.n_open = self.n_windows = 0

    def best_level(self, n: int) -> int:
        """The level from which n more tokens make the sum of squares smallest."""
        cost = self.there[n:] - self.here[: self.size - n + 1]
        return self.size - n - int(cost[::-1].argmin())

    def change(self, level: int, by: int) -> None:
        self.counts[level] += by
        self.there[level] = 2 * self.counts[level]
        self.here[level] = 2 * self.counts[level] if self.counts[level] else -(1 << 60)
        self.n_open += by

    def new(self) -> int:
        self.n_windows += 1
        return self.n_windows - 1

    def place(self, piece: tuple) -> Iterator[tuple[int, list]]:
        """Puts a piece of fewer tokens than a window where the rule says."""
        n = len(piece[2]) // 4
        level = self.best_level(n)
        if level:
            number, pieces = self.levels[level].pop()
            self.change(level, -1)
        else:
            number, pieces = self.new(), []
        pieces.append(piece)
        if level + n == self.size:
            yield number, pieces
            return
        self.levels[level + n].append((number, pieces))
        self.change(level + n, 1)
        if self.n_open >= self.most_open:
            yield from self.close()

    def add(self, document: object, ids: bytes) -> Iterator[tuple[int, list]]:
        """Places a document: full windows first, then what remains."""
        width = 4 * self.size
        full = len(ids) // width * width
        for at in range(0, full, width):
            yield self.new(), [(document, at // 4, ids[at : at + width])]
        if full < len(ids):
            yield from self.place((document, full // 4, ids[full:]))

    def close(self) -> Iterator[tuple[int, list]]:
        """Fills the fullest open windows with cut pieces of the emptiest, until one at most is open."""
        left = [(level, *w) for level in range(self.size - 1, 0, -1) for w in self.levels[level]]
        for level in range(1, self.size):
            if self.levels[level]:
                self.change(level, -len(self.levels[level]))
                self.levels[level] = []
        first, last = 0, len(left) - 1
        while first < last:
            level, number, pieces = left[first]
            while level < self.size and first < last:
                fill, donor, given = left[last]
                document, start, ids = given.pop()
                n = min(self.size - level, len(ids) // 4)
                pieces.append((document, start, ids[: 4 * n]))
                if 4 * n < len(ids):
                    given.append((document, start + n, ids[4 * n :]))
                level += n
                left[last] = (fill - n, donor, given)
                if not given:
                    last -= 1
            left[first] = (level, number, pieces)
            if level == self.size:
                yield number, pieces
                first += 1
        if first == last:
            level, number, pieces = left[first]
            if level == self.size:
                yield number, pieces
            else:
                self.levels[level].append((number, pieces))
                self.change(level, 1)

    def end(self) -> Iterator[tuple[int, list]]:
        """Closes all windows; the last one is cut into lengths that are powers of two."""
        yield from self.close()
        for level in np.flatnonzero(self.counts):
            number, pieces = self.levels[level].pop()
            self.change(int(level), -1)
            for bit in range(int(level).bit_length() - 1, -1, -1):
                need, own = (1 << bit) & int(level), []
                while need:
                    document, start, ids = pieces.pop(0)
                    n = min(need, len(ids) // 4)
                    own.append((document, start, ids[: 4 * n]))
                    if 4 * n < len(ids):
                        pieces.insert(0, (document, start + n, ids[4 * n :]))
                    need -= n
                if own:
                    yield number, own
                    number = self.new()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(docs: DataFrame, tokenizer_path: str | None = None, *, window: int = WINDOW, end_id: int = END_ID, most_open: int = MOST_OPEN, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces (PIECES, and the ids unless keep_ids is off) of all documents.

    sequence_tokens is how full the piece's sequence is: the window's size, or a power of two.
    """
    path, end = tokenizer_path or default_tokenizer(), int(end_id).to_bytes(4, "little")
    kinds = [pa.int64()] * 8 + [pa.list_(pa.int32())] * keep_ids
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * keep_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer, rows = ByteEncoder.of(path), LevelPacker(window, most_open), []
        base = TaskContext.get().partitionId() << 40

        def put(done: Iterator[tuple[int, list]]) -> None:
            for number, pieces in done:
                offset, full = 0, sum(len(ids) for _, _, ids in pieces) // 4
                for (doc_id, tokens), start, ids in pieces:
                    n = len(ids) // 4
                    rows.append((doc_id, start, n, zlib.crc32(ids), tokens, base + number, offset, full, *[np.frombuffer(ids, "<i4")] * keep_ids))
                    offset += n

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encoder.encode(text) + end
                    put(packer.add((doc_id, len(ids) // 4), ids))
                if len(rows) >= 2048:
                    yield flushed()
        put(packer.end())
        if rows:
            yield flushed()

    schema = PIECES + ", ids array<int>" * keep_ids
    return persisted(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema), "packed", keep=True)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): each sequence's ids and, in their order, its documents and how long their pieces are."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    found = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    return found.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.length").alias("lengths"))
