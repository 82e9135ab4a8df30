"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames with histograms.

`encode_gif` stores a byte payload as the palette indices of 64 pixels wide frames. `decode_gif` reads any
GIF89a/87a file: global and local palettes, interlacing, transparency, disposal methods 0 to 3, delays and
clear codes. A frame's column entry holds its time, delay, placement, disposal and the histograms of the
composed canvas's red, green and blue in 16 bins each.

Defined results: a null or empty text has a payload of 64 zero bytes; payloads of any length are stored
whole, in as many frames as needed; equal texts have equal media; bytes that are no GIF raise ValueError
in `decode_gif` and give a null frame list in `decode_media`, and so do files that are cut off, code streams
that end before their pixels, code sizes and codes that no GIF has, codes outside the palette, and screens or
frames of more than MAX_PIXELS; null media give nulls.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persisted

WIDTH, FRAME_ROWS, DELAY_MS, BINS = 64, 128, 40, 16
MAX_CODES = 4096
#: A screen or frame with more than this is refused before memory is taken for it: 64 million, 4,096 x 16,384.
MAX_PIXELS = 1 << 26
#: Grey levels: index i is the colour (i, i, i).
GREYS = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
FRAME_TYPE = "struct<frame: int, t_ms: long, delay_ms: int, x: int, y: int, w: int, h: int, disposal: int, transparent: int, red: array<int>, green: array<int>, blue: array<int>>"


@dataclass
class Frame:
    """One image of the file: its own indices and the canvas after it was drawn."""

    indices: np.ndarray
    x: int
    y: int
    delay_ms: int
    disposal: int
    transparent: int
    t_ms: int = 0
    histograms: np.ndarray | None = None  # (red, green, blue) x BINS
    canvas: np.ndarray | None = field(default=None, repr=False)


def colour_bins(colours: np.ndarray) -> np.ndarray:
    """One number for the bins of each colour's red, green and blue."""
    r, g, b = (colours[..., k].astype(np.uint16) * BINS >> 8 for k in range(3))
    return (r * BINS + g) * BINS + b


def histograms(bins: np.ndarray) -> np.ndarray:
    """(3, BINS) counts of red, green and blue of a canvas of colour_bins."""
    cube = np.bincount(bins.ravel(), minlength=BINS**3).reshape(BINS, BINS, BINS)
    plane = cube.sum(axis=2)
    return np.stack([plane.sum(axis=1), plane.sum(axis=0), cube.sum(axis=(0, 1))])


def code_widths(min_bits: int) -> np.ndarray:
    """Bits of the n-th code after a clear code, up to one code past the full table."""
    base = (1 << min_bits) + 2
    size = np.minimum(base + np.maximum(np.arange(MAX_CODES - base + 2) - 1, 0), MAX_CODES - 1)
    return np.floor(np.log2(size)).astype(np.int64) + 1


_widths: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def schedule(min_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The widths, and the bit offsets at which codes begin."""
    if min_bits not in _widths:
        w = code_widths(min_bits)
        _widths[min_bits] = w, np.concatenate([[0], np.cumsum(w)])
    return _widths[min_bits]


def lzw_codes(data: bytes, min_bits: int = 8) -> Iterator[list[int]]:
    """Lists of codes, one list for each run between clear codes."""
    first, table, codes = (1 << min_bits) + 2, {}, []
    size, rest = first, iter(data)
    prefix = next(rest, -1)
    for byte in rest:
        key = prefix << 8 | byte
        code = table.get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        prefix = byte
        if size == MAX_CODES:
            yield codes
            table, codes, size = {}, [], first
        else:
            table[key] = size
            size += 1
    if prefix >= 0:
        codes.append(prefix)
    yield codes


def pack(runs: list[list[int]], min_bits: int = 8) -> bytes:
    """The bit stream: a clear code before each run, the end code after the last."""
    clear = 1 << min_bits
    widths, _ = schedule(min_bits)
    codes, bits = [], []
    for k, run in enumerate(runs):
        own = [*run, clear + 1 if k == len(runs) - 1 else clear]
        codes.append(np.array(own, np.int64))
        bits.append(widths[: len(own)])
    codes = np.concatenate([[clear], *codes])
    bits = np.concatenate([[min_bits + 1], *bits])
    ends = np.cumsum(bits)
    at = ends - bits
    out = np.zeros(int(ends[-1] + 7) // 8 + 3, np.int64)
    shifted = codes << (at & 7)
    for k in range(3):
        np.add.at(out, (at >> 3) + k, shifted >> (8 * k) & 255)
    return out[: int(ends[-1] + 7) // 8].astype(np.uint8).tobytes()


def unlzw(stream: bytes, min_bits: int, n_pixels: int) -> bytes:
    """Decodes a code stream, at most n_pixels indices; ValueError if it ends before.

    Widths follow from the place after the last clear code, so the codes up to the next clear or end code
    are cut out of the bits together.
    """
    if not 1 <= min_bits <= 8:
        raise ValueError("a code size that no GIF has")
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    widths, offsets = schedule(min_bits)
    padded = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    words = padded[:-2] | padded[1:-1] << 8 | padded[2:] << 16
    total, at, out, size = len(stream) * 8, 0, [], 0
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    while at < total and size < n_pixels:
        n = int(np.searchsorted(offsets, total - at, "right")) - 1
        if n <= 0:
            break
        place = at + offsets[:n]
        codes = words[place >> 3] >> (place & 7).astype(np.uint32) & ((1 << widths[:n]) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else n
        table, known = roots[:], len(roots)
        append, emit = table.append, out.append
        run = codes[:stop].tolist()
        if run:
            if run[0] > clear:
                raise ValueError("code before its definition")
            emit(previous := table[run[0]])
            for code in run[1:]:
                if code < known:
                    entry = table[code]
                    if known < MAX_CODES:
                        append(previous + entry[:1])
                        known += 1
                elif code == known < MAX_CODES:
                    append(entry := previous + previous[:1])
                    known += 1
                else:
                    raise ValueError("code before its definition")
                emit(entry)
                previous = entry
            size = sum(map(len, out))
        if stop < n:
            at += int(offsets[stop + 1])
            if codes[stop] == end:
                break
        else:  # a full table without a clear code: 12-bit codes follow it until one comes
            at += int(offsets[n])
            while n == len(widths) and at + 12 <= total and size < n_pixels:
                code = int(words[at >> 3]) >> (at & 7) & (MAX_CODES - 1)
                at += 12
                if code in (clear, end):
                    at = total if code == end else at
                    break
                emit(table[code])
                size += len(table[code])
    data = b"".join(out)[:n_pixels]
    if len(data) < n_pixels:
        raise ValueError("the code stream ends before its pixels")
    return data


def sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(payload: bytes, delay_ms: int = DELAY_MS) -> bytes:
    """A looping animation whose frames hold the payload's bytes as grey indices, row by row.

    The payload's length must be a positive multiple of WIDTH.
    """
    if not payload or len(payload) % WIDTH:
        raise ValueError("the payload must be a positive multiple of the width")
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), GREYS.tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for top in range(0, rows, FRAME_ROWS):
        part = payload[top * WIDTH : (top + FRAME_ROWS) * WIDTH]
        # Disposal 2: the next frame begins on an empty canvas.
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 2 << 2, delay_ms // 10, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        out.append(sub_blocks(pack(list(lzw_codes(part)))))
    return b"".join([*out, b"\x3b"])


def deinterlaced(indices: np.ndarray) -> np.ndarray:
    h = len(indices)
    order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
    out = np.empty_like(indices)
    out[order] = indices
    return out


def decode_gif(data: bytes, canvases: bool = True) -> list[Frame]:
    """All frames, drawn in turn on the canvas with palettes, transparency and disposal.

    Without canvases only their histograms are kept, and bins are drawn instead of colours.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    try:
        return _decode(data, canvases)
    except (struct.error, IndexError, OverflowError) as e:
        raise ValueError("damaged GIF file") from e


def _decode(data: bytes, canvases: bool) -> list[Frame]:
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > MAX_PIXELS:
        raise ValueError("a screen of more than MAX_PIXELS")
    at, frames, t = 13, [], 0
    shared = GREYS
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    empty = shared[background] if flags & 0x80 and background < len(shared) else np.zeros(3, np.uint8)
    # Without canvases the drawing is of histogram bins.
    tone = (lambda colours: colours) if canvases else colour_bins
    canvas = np.empty((height, width, 3), np.uint8) if canvases else np.empty((height, width), np.uint16)
    canvas[:] = empty = tone(empty)
    delay, disposal, transparent = 0, 0, -1

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            body, at = blocks(at + 2)
            if label == 0xF9:
                bits, hundredths, index = struct.unpack_from("<BHB", body)
                delay, disposal, transparent = hundredths * 10, bits >> 2 & 7, index if bits & 1 else -1
        elif kind == 0x2C:
            x, y, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
            at, palette = at + 10, shared
            if w * h > MAX_PIXELS:
                raise ValueError("a frame of more than MAX_PIXELS")
            if bits & 0x80:
                n = 2 << (bits & 7)
                palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
                at += 3 * n
            min_bits = data[at]
            stream, at = blocks(at + 1)
            indices = np.frombuffer(unlzw(stream, min_bits, w * h), np.uint8).reshape(h, w)
            indices = deinterlaced(indices) if bits & 0x40 else indices
            before = canvas.copy() if disposal == 3 else None
            area = canvas[y : y + h, x : x + w]
            seen = indices[: area.shape[0], : area.shape[1]]
            tones = tone(palette)
            hidden = seen == transparent if transparent >= 0 else None
            if len(tones) < 256:
                outside = seen >= len(tones)
                if (outside if hidden is None else outside & ~hidden).any():
                    raise ValueError("a code outside the palette")
                seen = np.where(outside, 0, seen)
            colours = tones[seen]
            area[:] = colours if hidden is None else np.where(hidden[..., None] if canvases else hidden, area, colours)
            counts = histograms(colour_bins(canvas) if canvases else canvas)
            frames.append(Frame(indices, x, y, delay, disposal, transparent, t, counts, canvas.copy() if canvases else None))
            t += delay
            if disposal == 2:
                canvas[y : y + h, x : x + w] = empty
            elif disposal == 3:
                canvas = before
            delay, disposal, transparent = 0, 0, -1
        else:
            raise ValueError("damaged GIF file")
    return frames


def payload_of(text: bytes) -> bytes:
    """The bytes and zeros up to a positive multiple of WIDTH."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes as a GIF, written to the shared folder and reread."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [(t or "").encode("utf-8", "replace") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode_gif(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return persisted(rows.mapInArrow(encode, "doc_id long, n_bytes long, media binary"), "gif", keep=True)


def decode_media(media: DataFrame) -> DataFrame:
    """Adds what the stored bytes decode to.

    frames: FRAME_TYPE per frame; payload_bytes, payload_sha256 and tail_crc32 (of the last 64 indices)
    over the indices of all frames in turn; media_bytes and media_sha256 of the file.
    """
    names = [f.name for f in media.schema]
    if "media" not in names:
        raise ValueError("a media column is needed")
    frame = pa.struct([("frame", pa.int32()), ("t_ms", pa.int64()), ("delay_ms", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("disposal", pa.int32()), ("transparent", pa.int32()), *((c, pa.list_(pa.int32())) for c in ("red", "green", "blue"))])
    kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("frames", pa.list_(frame))]

    def row(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        own = (len(data), hashlib.sha256(data).hexdigest())
        try:
            frames = decode_gif(data, canvases=False)
        except ValueError:
            return (None, None, None, *own, None)
        payload = b"".join(f.indices.tobytes() for f in frames)
        return (
            len(payload),
            hashlib.sha256(payload).hexdigest(),
            zlib.crc32(payload[-64:]),
            *own,
            [{"frame": k, "t_ms": f.t_ms, "delay_ms": f.delay_ms, "x": f.x, "y": f.y, "w": f.indices.shape[1], "h": f.indices.shape[0], "disposal": f.disposal, "transparent": f.transparent, **dict(zip(("red", "green", "blue"), f.histograms, strict=True))} for k, f in enumerate(frames)],
        )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = names.index("media")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = list(zip(*map(row, part.column(place).to_pylist()), strict=True)) or [()] * 6
                kept = [part.column(i) for i in range(len(names)) if i != place]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, (_, t) in zip(rows, kinds, strict=True))], [*(n for n in names if n != "media"), *(n for n, _ in kinds)])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != "media"])
    return media.mapInArrow(decode, f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames array<{FRAME_TYPE}>")


def media_table(docs: DataFrame) -> DataFrame:
    """The digest of each document's media, its frames, and feature: their number, duration and summed histograms."""
    sums = [F.expr(f"transform(sequence(0, {BINS - 1}), b -> aggregate(frames, 0L, (s, f) -> s + f.{c}[b]))") for c in ("red", "green", "blue")]
    last = F.element_at("frames", -1)
    told = [F.concat(F.lit(f"{c}="), F.array_join(x.cast("array<string>"), ",")) for c, x in zip("rgb", sums, strict=True)]
    feature = F.concat_ws(";", F.concat(F.lit("frames="), F.size("frames")), F.concat(F.lit("ms="), last["t_ms"] + last["delay_ms"]), *told)
    found = decode_media(store_media(docs)).withColumn("feature", feature)
    return found.select(*(c for c in found.columns if c not in ("frames", "feature")), "feature", "frames")
