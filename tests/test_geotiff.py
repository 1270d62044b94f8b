import struct
import zlib

import numpy as np
import pytest
import zstandard

from gridloam.sources import geotiff

KINDS = {"u1": 1, "u2": 1, "i2": 2, "i4": 2, "f4": 3, "f8": 3}


def packed_bits(raw):
    out = b""
    for a in range(0, len(raw), 100):
        piece = raw[a : a + 100]
        out += bytes([257 - len(piece)]) + piece[:1] if len(set(piece)) == 1 and len(piece) > 1 else bytes([len(piece) - 1]) + piece
    return out + b"\x80"


def lzw(raw):
    """A plain encoder: codes of growing width, the highest bits first."""
    table, out, bits, width, now = {}, [], "", 9, b""

    def put(code):
        out.append(format(code, f"0{width}b"))

    put(256)
    table = {bytes([i]): i for i in range(256)}
    nxt = 258
    for b in raw:
        b = bytes([b])
        if now + b in table:
            now += b
            continue
        put(table[now])
        table[now + b] = nxt
        nxt += 1
        if nxt == 4095:
            put(256)
            table, nxt, width = {bytes([i]): i for i in range(256)}, 258, 9
        else:
            width = 9 + (nxt >= 512) + (nxt >= 1024) + (nxt >= 2048)
        now = b
    if now:
        put(table[now])
        nxt += 1
        width = 9 + (nxt >= 512) + (nxt >= 1024) + (nxt >= 2048)
    put(257)
    bits = "".join(out)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


PACK = {1: lambda b: b, 5: lzw, 8: zlib.compress, 32773: packed_bits, 50000: lambda b: zstandard.ZstdCompressor().compress(b)}


def predicted(block, how, order):
    if how == 2:
        whole = np.dtype(f"u{block.dtype.itemsize}")
        b = block.view(whole)
        return np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], 1).view(block.dtype).astype(block.dtype.newbyteorder(order)).tobytes()
    if how == 3:
        out = b""
        for row in block:
            planes = np.frombuffer(row.astype(block.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(-1, block.dtype.itemsize).T.reshape(-1, block.shape[2])
            out += np.concatenate([planes[:1], planes[1:] - planes[:-1]]).tobytes()
        return out
    return block.astype(block.dtype.newbyteorder(order)).tobytes()


def hand_made(path, values, tile=None, strip=None, how=1, predictor=1, order="<", big=False, apart=False, place=None, extra=(), missing=()):
    """A file put together tag by tag; values are rows x columns x bands."""
    height, width, bands = values.shape
    h, w = tile or (strip, width)
    blocks = []
    for plane in range(bands) if apart else [slice(None)]:
        of = values[:, :, plane : plane + 1] if apart else values
        for r in range(0, height, h):
            for c in range(0, width, w):
                b = of[r : r + h, c : c + w]
                if tile:
                    full = np.zeros((h, w, b.shape[2]), values.dtype)
                    full[: b.shape[0], : b.shape[1]] = b
                    b = full
                blocks.append(b"" if len(blocks) in missing else PACK[how](predicted(np.ascontiguousarray(b), predictor, order)))
    word = "Q" if big else "I"
    tags = {256: ("I", [width]), 257: ("I", [height]), 258: ("H", [8 * values.dtype.itemsize] * bands), 259: ("H", [how]), 277: ("H", [bands]), 284: ("H", [2 if apart else 1]), 317: ("H", [predictor]), 339: ("H", [KINDS[values.dtype.str[1:]]] * bands)}
    tags |= {322: ("I", [w]), 323: ("I", [h])} if tile else {278: ("I", [h])}
    tags |= place or {33550: ("d", [0.5, 0.25, 0]), 33922: ("d", [0, 0, 0, 70.0, 30.0, 0])}
    tags |= dict(extra)
    at_tag, size_tag = (324, 325) if tile else (273, 279)
    tags |= {at_tag: (word, [0] * len(blocks)), size_tag: (word, [len(b) for b in blocks])}
    types = {"B": 1, "s": 2, "H": 3, "I": 4, "d": 12, "Q": 16}
    room, entry = (8, 20) if big else (4, 12)
    start = 16 if big else 8
    far = start + (8 if big else 2) + entry * len(tags) + room
    sizes = {t: struct.calcsize("=" + k) * len(v) for t, (k, v) in tags.items()}
    data_at = far + sum(s for s in sizes.values() if s > room)
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks])))[:-1] + data_at
    tags[at_tag] = (word, offsets.tolist())
    head, tail = b"", b""
    for t in sorted(tags):
        k, v = tags[t]
        raw = v if k == "s" else struct.pack(f"{order}{len(v)}{k}", *v)
        spot = raw.ljust(room, b"\0") if len(raw) <= room else struct.pack(order + word, far + len(tail))
        tail += b"" if len(raw) <= room else raw
        head += struct.pack(f"{order}HH{word}", t, types[k], len(v)) + spot
    mark = b"II" if order == "<" else b"MM"
    first = mark + (struct.pack(f"{order}HHHQ", 43, 8, 0, start) if big else struct.pack(f"{order}HI", 42, start))
    path.write_bytes(first + struct.pack(order + ("Q" if big else "H"), len(tags)) + head + b"\0" * room + tail + b"".join(blocks))
    return str(path)


def read(spark, path, **options):
    geotiff.register(spark)
    return spark.read.format("geotiff_grid").options(**options).load(path)


def wanted(values, none=None):
    """By hand: the first pixel's corner is at 70 E 30 N, a pixel is 0.5 x 0.25 degrees."""
    out = {}
    for r in range(values.shape[0]):
        for c in range(values.shape[1]):
            for b in range(values.shape[2]):
                v = float(values[r, c, b])
                out[b + 1, 30 - (r + 0.5) * 0.25, 70 + (c + 0.5) * 0.5] = None if v != v or v == none else v
    return out


def got(df):
    return {(r["band"], r["y"], r["x"]): r["value"] for r in df.collect()}


CASES = [
    ("f4", {"tile": (16, 32), "how": 8, "predictor": 3}),
    ("f8", {"tile": (16, 16), "how": 5, "predictor": 3, "order": ">"}),
    ("f4", {"strip": 7, "how": 32773, "apart": True}),
    ("i2", {"tile": (16, 16), "how": 5, "predictor": 2, "big": True}),
    ("u1", {"strip": 37, "how": 50000, "predictor": 2, "order": ">"}),
    ("u2", {"tile": (32, 16), "apart": True, "how": 8, "predictor": 2, "order": ">", "big": True}),
    ("i4", {"strip": 1}),
]


@pytest.mark.parametrize(("kind", "how"), CASES)
def test_hand_made_files(spark, tmp_path, kind, how):
    rng = np.random.default_rng(3)
    values = (rng.normal(size=(37, 41, 2)) * 50).astype(kind) if kind[0] == "f" else rng.integers(0, 200, (37, 41, 2)).astype(kind)
    values[2, 3:40] = 7
    if kind[0] == "f":
        values[5, 5] = np.nan
    path = hand_made(tmp_path / "a.tif", values, **how, extra=[(42113, ("s", b"7\0"))])
    assert got(read(spark, path)) == wanted(values, 7)


def test_a_box_reads_its_tiles(spark, tmp_path):
    values = np.arange(64 * 96, dtype="f4").reshape(64, 96, 1)
    path = hand_made(tmp_path / "a.tif", values, tile=(16, 16), how=8)
    df = read(spark, str(tmp_path), partition_bytes=1)
    assert df.rdd.getNumPartitions() == 24
    some = df.where("x between 78.3 and 95 and y >= 22 and y < 27.5")
    assert some.rdd.getNumPartitions() == 3 * 2
    want = {k: v for k, v in wanted(values).items() if 78.3 <= k[2] <= 95 and 22 <= k[1] < 27.5}
    assert got(some) == want and want
    assert df.where("x < 0").count() == 0 and path


def test_places(spark, tmp_path):
    """A full transform, and samples at points in place of areas."""
    values = np.arange(6, dtype="f8").reshape(2, 3, 1)
    turned = [0.0, 2.0, 0, 10.0, 3.0, 0.0, 0, 20.0] + [0.0] * 8
    path = hand_made(tmp_path / "t.tif", values, strip=2, place={34264: ("d", turned)})
    assert {(r["x"], r["y"], r["value"]) for r in read(spark, path).collect()} == {(10 + 2 * (r + 0.5), 20 + 3 * (c + 0.5), r * 3.0 + c) for r in range(2) for c in range(3)}
    path = hand_made(tmp_path / "p.tif", values, strip=2, extra=[(34735, ("H", [1, 1, 0, 1, 1025, 0, 1, 2]))])
    assert {(r["x"], r["y"]) for r in read(spark, path).collect()} == {(70 + c * 0.5, 30 - r * 0.25) for r in range(2) for c in range(3)}


def test_missing_tiles_and_errors(spark, tmp_path):
    values = np.ones((32, 32, 1), "f4")
    path = hand_made(tmp_path / "a.tif", values, tile=(16, 16), how=8, missing=(2,))
    df = read(spark, path)
    assert df.where("value is null").count() == 256 and df.where("value = 1").count() == 768
    raw = (tmp_path / "a.tif").read_bytes()
    (tmp_path / "a.tif").write_bytes(raw[:-8])
    with pytest.raises(Exception, match="a.tif, tile 3"):
        read(spark, path).collect()
    (tmp_path / "a.tif").write_bytes(b"GIF89a" + raw[6:])
    with pytest.raises(Exception, match="no TIFF file"):
        read(spark, path).collect()
    with pytest.raises(Exception, match="no place"):
        read(spark, hand_made(tmp_path / "b.tif", values, strip=8, place={305: ("s", b"x\0")})).collect()
    with pytest.raises(Exception, match="compression 7"):
        hand_made(tmp_path / "c.tif", values, strip=8, extra=[(259, ("H", [7]))])
        read(spark, str(tmp_path / "c.tif")).collect()


def test_written_tiles(spark, tmp_path):
    rows = [(float(x) / 2, float(y) / 2, None if (x + y) % 7 == 0 else x * 100.0 + y) for x in range(-20, 30) for y in range(-5, 40) if (x * y) % 11]
    geotiff.write(spark.createDataFrame(rows, "x double, y double, value double"), f"file://{tmp_path}/out", 0.5, 16)
    df = read(spark, str(tmp_path / "out"))
    back = {(r["x"], r["y"]): r["value"] for r in df.where("value is not null").collect()}
    assert back == {(x, y): v for x, y, v in rows if v is not None}
    assert df.select("file").distinct().count() == len({((int(2 * x) // 16), int(2 * y) // 16) for x, y, _ in rows})


def test_map_tiles(spark, tmp_path):
    """Tiles are read back pixel by pixel: the scale's ends, its middle, and clear where there is no value."""
    from gridloam.sources import png

    rows = [(float(x), float(y), None if (x, y) == (1, 1) else float(x)) for x in range(0, 6) for y in range(-1, 3)]
    tiles = png.write_tiles(spark.createDataFrame(rows, "x double, y double, value double"), f"file://{tmp_path}/m", 0.0, 4.0, "change", 1.0, 4, 2)
    assert sorted((r["i"], r["j"], r["cells"]) for r in tiles.collect()) == [(-1, 0, 4), (-1, 1, 2), (0, 0, 11), (0, 1, 6)]
    raw = (tmp_path / "m" / "tile_0_0.png").read_bytes()
    at = raw.index(b"IDAT")
    pixels = np.frombuffer(zlib.decompress(raw[at + 4 : at + 4 + struct.unpack(">I", raw[at - 4 : at])[0]]), np.uint8).reshape(8, 33)[:, 1:].reshape(8, 8, 4)
    assert struct.unpack(">II", raw[16:24]) == (8, 8) and (pixels[7, 0] == [140, 81, 10, 255]).all() and (pixels[6, 4] == [245, 245, 245, 255]).all()
    assert pixels[4, 2, 3] == 0 and pixels[0, 0, 3] == 0 and (pixels[2:, :, 3] > 0).sum() == 4 * 11
    assert (png.coloured(np.array([[9.0, -9.0, np.nan]]), 0, 4, "high")[0, :, 3] == [255, 255, 0]).all() and (png.coloured(np.array([[1.0]]), 1, 1, "low")[0, 0] == [254, 224, 139, 255]).all()
