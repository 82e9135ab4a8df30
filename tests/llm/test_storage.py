"""Token shards, WARC bundles and GIF media: exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from weftline.llm import gif_media, sstable_tokens, warc_bundles
from weftline.llm.common import shared_dir

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def tokenizer():
    pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(sstable_tokens.default_tokenizer())


def test_chunks_encode_as_the_whole(tokenizer):
    encoder = sstable_tokens.ChunkEncoder(sstable_tokens.default_tokenizer())
    texts = ["", None, "Hello, World's end\n\ttwo", "a\x1cb \x01 c", "x<|endoftext|>y <|ENDOFTEXT|>", "İstanbul ΟΔΟΣ Σ é", "é ́x", " nbsp \u0085z", "don't we'll 123 a_b", "日本 語 ok ok"]
    for _ in range(2):  # from an empty and from a filled cache
        for t, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, encoder.dtype).tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_full_cache(tokenizer, monkeypatch):
    monkeypatch.setattr(sstable_tokens, "CACHE_WORDS", 3)
    encoder = sstable_tokens.ChunkEncoder(sstable_tokens.default_tokenizer())
    for t in ("one two", "two three four five", "one five six"):
        assert np.frombuffer(encoder.encode([t])[0], encoder.dtype).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert len(encoder.known) <= 3


def test_token_table(spark, tokenizer, odd_documents):
    got = sstable_tokens.token_table(odd_documents, shards=3).orderBy("start").collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd_documents.collect()), key=lambda x: x[:2])
    assert [r.doc_id for r in got] == [d if there else None for there, d, _ in rows]
    start, want, have = 0, [], []
    for r in got:
        assert r.start == start
        start += r.n_tokens
        have.append((r.doc_id, r.n_tokens, r.ids_crc32))
    for there, d, text in rows:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((d if there else None, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(have, key=str) == sorted(want, key=str)


def test_lookup(spark, tokenizer, odd_documents, no_documents):
    manifest = sstable_tokens.write_sstables(odd_documents, sstable_tokens.default_tokenizer(), shared_dir(spark, "test"), shards=4)
    found = sstable_tokens.lookup(manifest, [4, -9, 77, None]).collect()
    assert sorted(r.doc_id for r in found if r.doc_id is not None) == [-9, 4, 4] and sum(r.doc_id is None for r in found) == 2
    ends = [(r["first"], r["last"]) for r in manifest.orderBy("shard").collect()]
    assert ends[0][0] is None and ends[-1][1] == 9_000_000_000 and len(ends) > 1
    assert next(r.ids for r in found if r.doc_id == -9) == [*tokenizer.encode("!!! ??? 123", add_special_tokens=False).ids, 1]
    assert sstable_tokens.token_table(no_documents).count() == 0


def test_shard_file(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable_tokens, "BLOCK_BYTES", 64)
    path, keys = str(tmp_path / "x.sst"), [None, -5, 0, 7, 7, 1 << 40]
    writer = sstable_tokens.ShardWriter(path, np.dtype("<u2"))
    for i, k in enumerate(keys * 1 + list(range(1 << 41, (1 << 41) + 500))):
        writer.add(sstable_tokens.to_key(k), np.arange(i % 9, dtype="<u2").tobytes())
    writer.close()
    reader = sstable_tokens.ShardReader(path)
    assert reader.n_docs == 506 and len(reader.blocks) > 10
    assert [sstable_tokens.from_key(k) for k, _ in reader.entries()][:6] == keys
    assert [len(x) for x in reader.get(7)] == [3, 4] and [len(x) for x in reader.get(None)] == [0]
    assert reader.get(8) == [] and sum(reader.may_hold(sstable_tokens.to_key(k)) for k in range(10_000, 11_000)) < 50


def test_archives_equal_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(3, "http://a/é b", "x" * 100), (1, None, "x" * 100), (1, None, "x" * 100), (2, "u", "x" * 99), (4, "u", "x" * 99), (None, "n\nl", "x" * 100), (None, None, None), (5, "u", ""), (6, "u", "é\r\n\r\n" * 40), (7, "u", "é\r\n\r\n" * 40), (8, "u", "z" * 2_000_000)]
    pages = spark.createDataFrame(rows, PAGES).withColumnsRenamed({})
    got = warc_bundles.archive_table(pages.selectExpr("*", "1 AS payload", "'x' AS digest"))
    con, frame = duckdb.connect(), pages.toPandas()
    frame["page_id"] = frame["page_id"].astype("Int64")
    con.register("pages", frame)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = con.execute(warc_bundles.ORACLE_SQL).fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted(want, key=str)
    assert warc_bundles.archive_table(pages.limit(0)).count() == 0


def test_identifiers_are_unique(spark):
    rows = [(1, None, "x" * 100)] * 3 + [(2, None, "x" * 100)] * 2 + [(None, None, "x" * 100)] * 2
    index = warc_bundles.write_bundles(spark.createDataFrame(rows, PAGES), shared_dir(spark, "test")).collect()
    assert len({r.record_id for r in index}) == len(index) == 7
    named = set()
    for r in index:
        reader = warc_bundles.BundleReader(r.path)
        headers = next(warc_bundles.parse_records(reader.record(r.frame, r.offset, r.length)))[2]
        named.add(headers.get("WARC-Refers-To"))
    assert named - {None} < {r.record_id for r in index if r.page_id == 1} and len(named) == 2


def test_runs_of_frames(spark, monkeypatch):
    monkeypatch.setattr(warc_bundles, "FRAME_BYTES", 500)
    rows = [(i, "u", f"{i % 7} " * (60 + i % 5)) for i in range(300)]
    pages = spark.createDataFrame(rows, PAGES).coalesce(1)
    assert sorted(r.page_id for r in warc_bundles.archive_table(pages).collect()) == list(range(300))


def test_records_by_index(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 30_000) for i in range(9)], PAGES)
    index = warc_bundles.write_bundles(pages.coalesce(1), shared_dir(spark, "test")).collect()
    assert len({r.frame for r in index}) > 1
    for r in index:
        reader = warc_bundles.BundleReader(r.path)
        _, _, headers, n, payload = next(warc_bundles.parse_records(reader.record(r.frame, r.offset, r.length)))
        assert headers["WARC-Record-ID"] == r.record_id and payload.decode() == f"<p>{r.page_id}</p>" * 30_000 and n == len(payload)


def test_gif_round_trip():
    rng = random.Random(2)
    for n in (64, 640, 8192, 8256, 40_000 // 64 * 64):
        for data in (bytes(rng.randrange(256) for _ in range(n)), bytes([9]) * n, (b"the thing " * n)[:n]):
            frames = gif_media.decode_gif(gif_media.encode_gif(data))
            assert b"".join(f.indices.tobytes() for f in frames) == data
            assert [f.t_ms for f in frames] == [40 * k for k in range(len(frames))]
            assert gif_media.unlzw(gif_media.pack(list(gif_media.lzw_codes(data))), 8, n) == data


def plain_indices(data):
    """All frames' indices by the plainest reading: one bit string, one code at a time."""
    flags, at, frames = data[10], 13, []
    at += 3 * (2 << (flags & 7)) if flags & 0x80 else 0
    while data[at] != 0x3B:
        kind = data[at]
        at += 2 if kind == 0x21 else 10
        if kind == 0x2C:
            width, height = (int.from_bytes(data[at - 5 + k : at - 3 + k], "little") for k in (0, 2))
            assert not data[at - 1] & 0xC0
            bits_0, at = data[at], at + 1
        body = b""
        while data[at]:
            body += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        if kind != 0x2C:
            continue
        stream = "".join(format(b, "08b")[::-1] for b in body)
        out, table, place, bits, last = b"", None, 0, bits_0 + 1, None
        while True:
            code = int(stream[place : place + bits][::-1], 2)
            place += bits
            if code == 1 << bits_0:
                table, bits, last = [bytes([i]) for i in range(1 << bits_0)] + [None, None], bits_0 + 1, None
                continue
            if code == (1 << bits_0) + 1:
                break
            word = table[code] if code < len(table) else last + last[:1]
            if last is not None and len(table) < 4096:
                table.append(last + word[:1])
            if len(table) == 1 << bits and bits < 12:
                bits += 1
            out, last = out + word, word
        assert len(out) == width * height
        frames.append(out)
    return frames


def test_gif_against_a_plain_reader():
    rng = random.Random(7)
    for data in (bytes(range(256)) * 64, bytes(rng.randrange(256) for _ in range(12_800)), bytes([7]) * 640, (b"some words and more words " * 900)[:20_480]):
        frames = plain_indices(gif_media.encode_gif(data))
        assert b"".join(frames) == data and all(len(f) <= 64 * 128 for f in frames)


def graphic(disposal, transparent=None, delay=5):
    flags = disposal << 2 | (transparent is not None)
    return b"\x21\xf9\x04" + bytes([flags, delay, 0, transparent or 0]) + b"\0"


def picture(x, y, w, h, pixels, palette=None, interlaced=False):
    flags = (0x81 if palette else 0) | (0x40 if interlaced else 0)
    stream = gif_media.pack(list(gif_media.lzw_codes(bytes(pixels), 2)), 2)
    return b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, w, h)) + bytes([flags]) + (bytes(sum(palette, ())) if palette else b"") + b"\x02" + gif_media.sub_blocks(stream)


def test_palettes_transparency_and_disposal():
    black, red, green, white = (0, 0, 0), (255, 0, 0), (0, 255, 0), (255, 255, 255)
    head = b"GIF89a" + (2).to_bytes(2, "little") * 2 + bytes([0x81, 0, 0]) + bytes(black + red + green + white)
    parts = [
        graphic(1), picture(0, 0, 2, 2, [1, 1, 1, 1]),  # stays
        graphic(3, 0), picture(0, 0, 2, 2, [0, 2, 2, 0]),  # 0 is transparent; then the canvas is restored
        graphic(2, None, 7), picture(0, 0, 1, 1, [0], [white, black, (0, 0, 9), (9, 0, 0)]),  # own palette; then cleared
        graphic(0), picture(1, 1, 1, 1, [3]),
    ]
    frames = gif_media.decode_gif(head + b"".join(parts) + b"\x3b")
    seen = [[tuple(p) for p in f.canvas.reshape(-1, 3).tolist()] for f in frames]
    assert seen == [[red] * 4, [red, green, green, red], [white, red, red, red], [black, red, red, white]]
    assert [(f.t_ms, f.delay_ms) for f in frames] == [(0, 50), (50, 50), (100, 70), (170, 50)]
    for f, g in zip(frames, gif_media.decode_gif(head + b"".join(parts) + b"\x3b", canvases=False), strict=True):
        assert f.histograms.tolist() == g.histograms.tolist() and f.histograms.sum(axis=1).tolist() == [4, 4, 4]
        assert [h[15] for h in g.histograms.tolist()] == [sum(c[k] == 255 for c in f.canvas.reshape(-1, 3).tolist()) for k in range(3)]


def test_interlacing_and_damage():
    head = b"GIF89a" + (1).to_bytes(2, "little") + (10).to_bytes(2, "little") + bytes([0, 0, 0])
    rows = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    frame = gif_media.decode_gif(head + picture(0, 0, 1, 10, [r % 4 for r in rows], None, True) + b"\x3b")[0]
    assert frame.indices.ravel().tolist() == [r % 4 for r in range(10)]
    short = gif_media.pack(list(gif_media.lzw_codes(bytes(9), 2)), 2)
    early = b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (0, 0, 1, 10)) + b"\0\x02" + gif_media.sub_blocks(short)
    beyond = picture(0, 0, 1, 1, [3], [(0, 0, 0), (9, 9, 9)] * 2).replace(b"\x81" + bytes((0, 0, 0, 9, 9, 9)), b"\x80")
    for bad in (b"", b"PNG", gif_media.encode_gif(bytes(64))[:-30], head, head + early + b"\x3b", head + beyond + b"\x3b"):
        with pytest.raises(ValueError):
            gif_media.decode_gif(bad)


def test_any_changed_byte_decodes_or_is_refused():
    rng = random.Random(21)
    data = gif_media.encode_gif(gif_media.payload_of(b"some bytes, some more bytes " * 9))
    for at in range(len(data)):
        if 800 < at < len(data) - 60 and at % 3:  # the palette is long
            continue
        for value in {0, 1, 63, 255, rng.randrange(256)}:
            changed = data[:at] + bytes([value]) + data[at + 1 :]
            try:
                gif_media.decode_gif(changed, canvases=False)
            except ValueError:
                pass
    for cut in range(0, len(data), 7):
        with pytest.raises(ValueError):
            gif_media.decode_gif(data[:cut])
    huge = data[:6] + b"\xff\xff\xff\xff" + data[10:]
    with pytest.raises(ValueError):
        gif_media.decode_gif(huge)


def test_damaged_media_give_nulls(spark):
    data = gif_media.encode_gif(gif_media.payload_of(b"x"))
    code_size = data.index(b"\x2c\0\0\0\0\x40\0") + 10  # after the image's place, width 64, height and flags
    media = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(data[:6] + b"\xff" * 4 + data[10:])), (3, bytearray(data[:code_size] + b"?" + data[code_size + 1 :])), (4, None)], "doc_id long, media binary")
    got = {r.doc_id: r for r in gif_media.decode_media(media).collect()}
    assert len(got[1].frames) == 1 and all(got[i].frames is None for i in (2, 3, 4)) and got[2].media_bytes == len(data)


def test_media_table(spark, odd_documents, no_documents):
    got = gif_media.media_table(odd_documents).collect()
    want = []
    for r in odd_documents.collect():
        text = (r.text or "").encode()
        payload = text + bytes(-len(text) % 64 if text else 64)
        want.append((r.doc_id, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == sorted(want, key=str)
    of = {}
    for r in got:
        assert of.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    for r in got:
        shown = sum(64 * min(128, r.payload_bytes // 64) for _ in r.frames)
        assert [sum(sum(f[c]) for f in r.frames) for c in ("red", "green", "blue")] == [shown] * 3 and sum(f.w * f.h for f in r.frames) == r.payload_bytes
    assert gif_media.media_table(no_documents).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"no")), (2, None)], "k long, media binary")
    assert [(r.k, r.media_bytes, r.frames) for r in gif_media.decode_media(bad).orderBy("k").collect()] == [(1, 2, None), (2, None, None)]
