import struct
import zlib
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from gridloam.sources import blosc, zarr

COMPRESS = {
    "lz4": lambda b: pa.Codec("lz4_raw").compress(b, asbytes=True),
    "snappy": lambda b: pa.Codec("snappy").compress(b, asbytes=True),
    "zlib": zlib.compress,
    "zstd": lambda b: zstandard.ZstdCompressor().compress(b),
}


def shuffled(block, item, how):
    n = len(block) // item
    if how == "bytes":
        return b"".join(block[k : n * item : item] for k in range(item)) + block[n * item :]
    if how == "bits" and n % 8 == 0:
        out = bytearray(n * item)
        for e in range(n):
            for bit in range(8 * item):
                if block[e * item + bit // 8] >> bit % 8 & 1:
                    out[bit * (n // 8) + e // 8] |= 1 << e % 8
        return bytes(out) + block[n * item :]
    return block


def frame(data, item, codec, how, block, split):
    """A frame put together by hand, stream by stream."""
    count, body, starts = -(-len(data) // block), b"", []
    for a in range(0, len(data), block):
        piece = shuffled(data[a : a + block], item, how) if item > 1 else data[a : a + block]
        apart = split and item <= 16 and block // item >= 128 and len(piece) == block
        starts.append(16 + 4 * count + len(body))
        size = len(piece) // item if apart else len(piece)
        for s in range(0, len(piece), size):
            raw = piece[s : s + size]
            small = COMPRESS[codec](raw)
            small = small if len(small) < len(raw) else raw
            body += struct.pack("<i", len(small)) + small
    flags = {"bytes": 1, "bits": 4, "none": 0}[how] | (0 if split else 0x10) | {"lz4": 1, "snappy": 2, "zlib": 3, "zstd": 4}[codec] << 5
    return struct.pack("<BBBBIII", 2, 1, flags, item, len(data), block, 16 + 4 * count + len(body)) + struct.pack(f"<{count}i", *starts) + body


@pytest.mark.parametrize("codec", list(COMPRESS))
@pytest.mark.parametrize("how", ["bytes", "bits", "none"])
@pytest.mark.parametrize("split", [True, False])
def test_frames(codec, how, split):
    rng = np.random.default_rng(4)
    for item, n, block in ((8, 5000, 4096), (4, 1003, 1024), (2, 600, 600), (1, 999, 512), (8, 3, 4096)):
        smooth = (np.cumsum(rng.normal(size=n)) * 100).astype({8: "<f8", 4: "<i4", 2: "<i2", 1: "u1"}[item], casting="unsafe").tobytes()
        for data in (smooth, rng.bytes(n * item)):
            assert blosc.unpack(frame(data, item, codec, how, block, split)) == data


def test_plain_and_packed():
    data = bytes(range(256)) * 5
    assert blosc.unpack(struct.pack("<BBBBIII", 2, 1, 0x02 | 1 << 5, 8, len(data), len(data), 16 + len(data)) + data) == data
    for n in (0, 1, 7, 8, 1000, 300_001):
        raw = np.arange(n, dtype=np.uint32).tobytes()[:n]
        assert blosc.unpack(blosc.pack(raw, 8, 4096)) == raw


def test_broken_frames_are_errors():
    data = np.arange(5000).tobytes()
    good = frame(data, 8, "lz4", "bytes", 4096, True)
    rng = np.random.default_rng(6)
    for bad in (b"", good[:10], good[:-1], b"\x07" + good[1:], good[:2] + bytes([0x11]) + good[3:], good[:16] + b"\xff" * 40 + good[56:]):
        with pytest.raises(blosc.BadFrame):
            blosc.unpack(bad)
    for _ in range(300):  # any other damage gives an error or some bytes, never another failure
        at = int(rng.integers(16, len(good)))
        try:
            blosc.unpack(good[:at] + rng.bytes(3) + good[at + 3 :])
        except blosc.BadFrame:
            pass


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(date(2020, 2, 27) + timedelta(days=d), y / 4, -x / 2, float(d * 100 + y * 10 + x)) for d in range(0, 9) for y in range(5) for x in range(7) if (d + x + y) % 4 and d != 4]
    df = spark.createDataFrame(rows, "obs_date date, y double, x double, value double")
    zarr.write(df, f"file://{tmp_path}/s.zarr", chunks=(3, 2, 4))
    zarr.register(spark)
    return rows, f"{tmp_path}/s.zarr"


def test_store_is_read_back(spark, stored):
    rows, path = stored
    got = spark.read.format("zarr_grid").load(path).where("value is not null").collect()
    assert sorted(map(tuple, got)) == sorted(rows)
    whole = spark.read.format("zarr_grid").load(path)
    assert whole.count() == 9 * 5 * 7  # days without values too
    few = whole.where("obs_date = date'2020-03-01'")
    assert few.rdd.getNumPartitions() == 6 and few.where("value is not null").count() == sum(r[0] == date(2020, 3, 1) for r in rows)


def test_broken_chunk_is_named(spark, stored):
    path = stored[1]
    with open(f"{path}/value/1.0.1", "r+b") as f:
        f.truncate(20)
    with pytest.raises(Exception, match=r"chunk value/1\.0\.1"):
        spark.read.format("zarr_grid").load(path).collect()


def test_nothing_to_write(spark, tmp_path):
    with pytest.raises(ValueError, match="no observations"):
        zarr.write(spark.createDataFrame([], "obs_date date, y double, x double, value double"), f"{tmp_path}/e.zarr")
