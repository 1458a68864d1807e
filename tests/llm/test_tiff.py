import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pelago.llm import tiff


@pytest.mark.parametrize("compression", ["none", "packbits", "lzw", "deflate"])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 16)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 4, (37, 41, 3), dtype=np.uint8), np.zeros((5, 64, 1), np.uint8), rng.integers(0, 256, (70, 9, 1), dtype=np.uint8)]
    data = tiff.write_pages(pages, compression, predictor, 8, tile, order)
    found = list(tiff.read_pages(data))
    assert [p.index for p in found] == [0, 1, 2]
    for want, page in zip(pages, found, strict=True):
        assert (page.pixels == want).all() and page.tiled == bool(tile) and page.predictor == predictor


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs_round_trip(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.unlzw(tiff.lzw(data)) == data


def test_lzw_through_all_widths_and_a_full_table():
    data = np.random.default_rng(1).integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    assert tiff.unlzw(tiff.lzw(data)) == data
    assert tiff.unlzw(tiff.lzw(b"a" * 100_000)) == b"a" * 100_000


def test_known_packbits_bytes():
    # the example of the format's description
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.unpack_bits(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def test_broken_files(spark):
    good = tiff.write_pages([np.zeros((4, 4, 1), np.uint8)])
    loop = bytearray(tiff.write_pages([np.zeros((4, 4, 1), np.uint8)]))
    (first,) = struct.unpack_from("<I", loop, 4)
    n = struct.unpack_from("<H", loop, first)[0]
    struct.pack_into("<I", loop, first + 2 + 12 * n, first)
    rows = [(1, good), (2, b"junk"), (3, None), (4, bytes(loop)), (5, good[: len(good) // 2]), (1, good)]
    found = tiff.tiff_pages(spark.createDataFrame([(a, bytearray(b) if b is not None else None, "x") for a, b in rows], "k long, m binary, page string"), "k", "m").collect()
    assert sorted((r.id, r.page, r.error is None) for r in found if r.error is None) == [(1, 0, True), (1, 0, True), (4, 0, True)]
    assert sorted(r.id for r in found if r.error) == [2, 3, 4, 5]


@pytest.mark.parametrize("tile", [None, (16, 16)])
@pytest.mark.parametrize("compression", ["none", "packbits", "lzw", "deflate"])
def test_any_field_may_be_wrong(tile, compression):
    """Every header field set to odd values: pages or a ValueError, and memory only for what the file can fill."""
    pixels = np.arange(20 * 18 * 3, dtype=np.uint8).reshape(20, 18, 3)
    good = tiff.write_pages([pixels], compression, 2, 8, tile)
    (at,) = struct.unpack_from("<I", good, 4)
    (n,) = struct.unpack_from("<H", good, at)
    bad = 0
    for i in range(n):
        place = at + 2 + 12 * i
        for offset, kind, values in ((2, "H", (0, 1, 3, 4, 99)), (4, "I", (0, 1, 2**16, 2**31, 2**32 - 1)), (8, "I", (0, 1, 7, 2**16, 2**31, 2**32 - 1))):
            for v in values:
                data = bytearray(good)
                struct.pack_into("<" + kind, data, place + offset, v)
                try:
                    for page in tiff.read_pages(bytes(data)):
                        assert page.pixels.size <= 1 << 22 and page.pixels.shape == (page.height, page.width, page.samples)
                except ValueError:
                    bad += 1
    assert bad > 5 * n


def test_bombs_are_cut_short():
    zeros = zlib.compress(bytes(50_000_000), 9)
    assert len(tiff.inflate(zeros, 1000)) == 1000
    assert len(tiff.unlzw(tiff.lzw(bytes(1_000_000)), 1000)) < 6000 and len(tiff.unpack_bits(bytes((129, 7)) * 100_000, 1000)) < 1200


def test_text_media(spark):
    texts = [None, "", "a", "a", "é" * 96, "x" * 192, "y" * 193, "long text " * 30_000]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    rows = {r.doc_id: r for r in tiff.text_media(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        media = tiff.store_payload(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert rows[2][1:] == rows[3][1:] and rows[7].n_pages == 2
    assert tiff.text_media(df.limit(0)).collect() == []
