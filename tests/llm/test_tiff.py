import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import queries, tiff


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=3000) | st.text("ab \n", max_size=3000).map(str.encode))
def test_codecs(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    if data:
        assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data


def test_lzw_beyond_one_table():
    data = np.random.default_rng(3).integers(0, 256, 30_000, np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_lzw_known_code():
    # the worked example of the format: 7 7 7 8 8 7 7 6 6
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(raw, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == raw


@pytest.mark.parametrize("rows", [1, 63, 64, 65, 130])
def test_every_layout(rows):
    rng, seen = np.random.default_rng(rows), set()
    for k in range(120):
        payload = rng.integers(97, 101, rows * tiff.ROW, np.uint8).tobytes()
        (page,) = tiff.pages(tiff.encode(payload))
        assert page[7] == payload and page[9] is None and page[1] * page[3] == tiff.ROW
        seen.add(page[4:7])
    assert len(seen) >= 10


def big_endian(pages):
    """A multi-page file in the other byte order: 16-bit planar samples with a predictor."""
    out, links = bytearray(b"MM" + struct.pack(">HI", 42, 0)), [4]
    for image in pages:
        height, width, samples = image.shape
        strips = []
        for s in range(samples):
            plane = image[:, :, s].astype(np.uint16).copy()
            plane[:, 1:] -= plane[:, :-1].copy()
            strips.append(zlib.compress(plane.astype(">u2").tobytes()))
        offsets = [len(out) + sum(map(len, strips[:k])) for k in range(samples)]
        out += b"".join(strips)
        long = len(out)
        out += struct.pack(f">{samples}I", *offsets) + struct.pack(f">{samples}I", *map(len, strips)) + struct.pack(f">{samples}H", *[16] * samples)
        struct.pack_into(">I", out, links[-1], len(out))
        fields = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, samples, long + 8 * samples), (259, 3, 1, 8 << 16), (273, 4, samples, long),
                  (277, 3, 1, samples << 16), (278, 4, 1, height), (279, 4, samples, long + 4 * samples), (284, 3, 1, 2 << 16), (317, 3, 1, 2 << 16)]
        out += struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHII", *f) for f in fields)
        links.append(len(out))
        out += struct.pack(">I", 0)
    return bytes(out), links


def test_pages_of_other_files(spark):
    rng = np.random.default_rng(5)
    images = [rng.integers(0, 65536, (5, 7, 3), np.uint16) for _ in range(3)]
    data, links = big_endian(images)
    loop = bytearray(data)
    loop[links[-1] : links[-1] + 4] = data[4:8]
    files = [(1, data), (2, bytes(loop)), (3, data[:60]), (4, b"no tiff"), (5, None), (6, b"")]
    df = tiff.tiff_pages(spark.createDataFrame([(k, m, "clash") for k, m in files], "id long, media binary, Page string"))
    got = {}
    for r in df.collect():
        got.setdefault(r.id, []).append(r)
    for k in (1, 2):
        assert [bytes(r.pixels) for r in got[k]] == [x.astype("<u2").tobytes() for x in images]
    assert all(len(got[k]) == 1 and got[k][0].error and got[k][0].pixels is None for k in (3, 4, 6)) and 5 not in got


def test_query(spark, documents, odd_texts, tmp_path):
    texts = [*odd_texts, "x" * 192, "y" * 193, "long é " * 30_000, "same", "same"]
    documents(texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op9_tiff(spark, str(tmp_path)).orderBy("doc_id").collect()
    for r, text in zip(rows, texts, strict=True):
        raw = (text or "").encode()
        payload = raw.ljust(max(-(-len(raw) // 192), 1) * 192)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_sha256 == hashlib.sha256(tiff.encode(payload)).hexdigest()
    assert rows[-1][1:] == rows[-2][1:]
