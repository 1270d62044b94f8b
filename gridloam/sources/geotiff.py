"""A Python data source for GeoTIFF grids, a partition for some tiles or strips, and a sink of tiles.

`spark.read.format("geotiff_grid").load(path)` gives (file, band, y, x, value) of every pixel at its centre, by the file's
affine tags; the path is a file or a folder of .tif files. Boxes of x and y that are pushed down leave out the tiles outside.
Read are whole and floating-point samples of 8 to 64 bits, in tiles or strips, pixels together or bands apart, plain or by
PackBits, LZW, deflate or zstd, with or without a predictor, classic and big files. The file's "no data" value and NaN are
NULL; so are tiles that were left out. A tile that can't be read is an error with the file's name and the tile's number.

`write` makes a folder of files from a table of a regular grid, one for each square of cells, each by one task.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from gridloam.sources.store import listed, open_fs, read_range, write_whole

SCHEMA = "file string, band int, y double, x double, value double"
#: Bytes of pixels in a partition.
PARTITION_BYTES = 8 << 20
#: Fixed values of the format: the tags that are read, and the types of their values.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, KEYS, NO_DATA = 33550, 33922, 34264, 34735, 42113
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
RASTER_KIND, POINTS = 1025, 2


class BadTiff(ValueError):
    """A file that isn't what its tags say."""


def unpacked_bits(raw: bytes) -> bytes:
    """PackBits: runs of bytes as they are, or of one byte repeated."""
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += raw[i + 1 : i + 2] * (257 - n if n > 128 else 0)
            i += 2 if n > 128 else 1
    return bytes(out)


def unpacked_lzw(raw: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, the highest first; 256 starts anew, 257 ends."""
    out, table, width, last = bytearray(), [], 9, b""
    bits, held = 0, 0
    plain = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in raw:
        bits, held = (bits << 8 | byte) & 0xFFFFFF, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held & (1 << width) - 1
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, width, last = list(plain), 9, b""
            continue
        if not table or code > len(table) or (code == len(table) and not last):
            raise BadTiff(f"code {code} of {len(table)}")
        now = table[code] if code < len(table) else last + last[:1]
        out += now
        if last:
            table.append(last + now[:1])
        last = now
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


class Tiff:
    """The first image of a file, by its tags."""

    def __init__(self, store, path: str):
        self.store, self.path = store, path
        head = read_range(store, path, 0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        kind = struct.unpack_from(f"{self.order}H", head, 2)[0] if self.order else 0
        if kind not in (42, 43) or len(head) < 8 + 8 * (kind == 43):
            raise BadTiff(f"{path}: no TIFF file")
        big = kind == 43
        start = struct.unpack_from(self.order + ("Q" if big else "I"), head, 8 if big else 4)[0]
        n = struct.unpack(self.order + ("Q" if big else "H"), read_range(store, path, start, 8 if big else 2))[0]
        size, word = (20, "Q") if big else (12, "I")
        raw = read_range(store, path, start + (8 if big else 2), n * size)
        if len(raw) < n * size:
            raise BadTiff(f"{path}: {n} tags don't fit")
        self.tags = {}
        for a in range(0, len(raw), size):
            tag, of, count = struct.unpack_from(f"{self.order}HH{word}", raw, a)
            if of not in TYPES:
                continue
            long = struct.calcsize("=" + TYPES[of]) * count
            at = a + 4 + struct.calcsize("=" + word)
            room = struct.calcsize("=" + word)
            data = raw[at : at + long] if long <= room else read_range(store, path, struct.unpack_from(self.order + word, raw, at)[0], long)
            if len(data) < long:
                raise BadTiff(f"{path}: tag {tag} ends outside the file")
            self.tags[tag] = data if of == 2 else struct.unpack(f"{self.order}{count}{TYPES[of]}", data)
        self._layout()
        self._place()

    def one(self, tag: int, default: int | None = None) -> int:
        if tag not in self.tags and default is None:
            raise BadTiff(f"{self.path}: no tag {tag}")
        return self.tags[tag][0] if tag in self.tags else default

    def _layout(self) -> None:
        self.width, self.height, self.bands = self.one(WIDTH), self.one(HEIGHT), self.one(SAMPLES, 1)
        tiled = TILES in self.tags
        self.tile = (self.one(TILE_HEIGHT), self.one(TILE_WIDTH)) if tiled else (min(self.one(STRIP_ROWS, self.height), self.height), self.width)
        self.offsets, self.sizes = (self.tags.get(t, ()) for t in ((TILES, TILE_SIZES) if tiled else (STRIPS, STRIP_SIZES)))
        self.padded, self.apart = tiled, self.one(PLANAR, 1) == 2
        bits, kind = self.one(BITS, 1), self.one(FORMAT, 1)
        if bits not in (8, 16, 32, 64) or kind not in (1, 2, 3) or len(set(self.tags.get(BITS, (0,)))) > 1 or (kind == 3 and bits == 8):
            raise BadTiff(f"{self.path}: samples of {bits} bits and format {kind} are not supported")
        self.dtype = np.dtype(f"{self.order}{'_uif'[kind]}{bits // 8}")
        if min(*self.tile, self.width, self.height, self.bands) < 1:
            raise BadTiff(f"{self.path}: {self.width} x {self.height} pixels in tiles of {self.tile}")
        self.down, self.across = -(-self.height // self.tile[0]), -(-self.width // self.tile[1])
        n = self.down * self.across * (self.bands if self.apart else 1)
        if len(self.offsets) < n or len(self.sizes) < n:
            raise BadTiff(f"{self.path}: {len(self.offsets)} tiles in place of {n}")

    def _place(self) -> None:
        """x = a col + b row + c, y = d col + e row + f, from pixels' centres."""
        if TRANSFORM in self.tags:
            m = self.tags[TRANSFORM]
            self.affine = (m[0], m[1], m[3], m[4], m[5], m[7])
        elif PIXEL_SCALE in self.tags and TIE_POINT in self.tags:
            (sx, sy), (i, j, _, x, y) = self.tags[PIXEL_SCALE][:2], self.tags[TIE_POINT][:5]
            self.affine = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
        else:
            raise BadTiff(f"{self.path}: no place on the map")
        keys = self.tags.get(KEYS, ())
        points = any(keys[a] == RASTER_KIND and keys[a + 3] == POINTS for a in range(4, len(keys) - 3, 4))
        self.shift = 0.0 if points else 0.5
        said = self.tags.get(NO_DATA, b"").split(b"\0")[0].strip()
        self.none = float(said) if said else None

    def xy(self, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d, e, f = self.affine
        col, row = col + self.shift, row + self.shift
        return a * col + b * row + c, d * col + e * row + f

    def box(self, i: int, j: int) -> tuple[int, int, int, int]:
        """First and last row and column of a tile, without what sticks out."""
        h, w = self.tile
        return i * h, min(self.height, (i + 1) * h), j * w, min(self.width, (j + 1) * w)

    def within(self, i: int, j: int, low: dict[str, float], high: dict[str, float]) -> bool:
        """Whether a tile has centres in the box."""
        r0, r1, c0, c1 = self.box(i, j)
        x, y = self.xy(np.array([r0, r0, r1 - 1, r1 - 1]), np.array([c0, c1 - 1, c0, c1 - 1]))
        return bool(x.max() >= low["x"] and x.min() <= high["x"] and y.max() >= low["y"] and y.min() <= high["y"])

    def _bytes(self, n: int, want: int) -> bytes:
        raw = read_range(self.store, self.path, self.offsets[n], self.sizes[n])
        how = self.one(COMPRESSION, 1)
        if how in (8, 32946):
            raw = zlib.decompressobj().decompress(raw, want)
        elif how == 5:
            raw = unpacked_lzw(raw, want)
        elif how == 32773:
            raw = unpacked_bits(raw)
        elif how == 50000:
            import zstandard

            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=want)
        elif how != 1:
            raise BadTiff(f"compression {how} is not supported")
        if len(raw) < want:
            raise BadTiff(f"{len(raw)} bytes in place of {want}")
        return raw[:want]

    def pixels(self, n: int) -> np.ndarray | None:
        """Tile number n as rows, columns, samples; None if it was left out."""
        if not self.sizes[n]:
            return None
        i = n % (self.down * self.across) // self.across
        rows = self.tile[0] if self.padded else min(self.tile[0], self.height - i * self.tile[0])
        each = 1 if self.apart else self.bands
        shape = (rows, self.tile[1], each)
        try:
            raw = self._bytes(n, int(np.prod(shape)) * self.dtype.itemsize)
            how = self.one(PREDICTOR, 1)
            if how == 3:  # differences of bytes; the bytes of a row's samples apart, the highest first
                steps = np.frombuffer(raw, np.uint8).reshape(rows, -1, each)
                planes = np.cumsum(steps, axis=1, dtype=np.uint8).reshape(rows, self.dtype.itemsize, -1)
                return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(self.dtype.newbyteorder(">")).reshape(shape)
            m = np.frombuffer(raw, self.dtype).reshape(shape)
            if how == 2:
                whole = np.dtype(f"u{self.dtype.itemsize}")
                m = np.cumsum(m.astype(self.dtype.newbyteorder("=")).view(whole), axis=1, dtype=whole).view(self.dtype.newbyteorder("="))
            elif how != 1:
                raise BadTiff(f"predictor {how} is not supported")
            return m
        except Exception as e:  # each codec has errors of its own
            raise BadTiff(f"{self.path}, tile {n}: {e}") from e


class TileRange(InputPartition):
    def __init__(self, path: str, tiles: list[int]):
        self.path, self.tiles = path, tiles


class GeoTiffReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.most = options["path"], int(options.get("partition_bytes", PARTITION_BYTES))
        self.low, self.high = {"x": -np.inf, "y": -np.inf}, {"x": np.inf, "y": np.inf}

    def pushFilters(self, filters):
        for f in filters:
            axis = f.attribute[0] if len(f.attribute) == 1 else None
            if axis in self.low and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low[axis] = max(self.low[axis], float(f.value))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high[axis] = min(self.high[axis], float(f.value))
            yield f  # tiles are coarser than boxes, so Spark filters too

    def partitions(self):
        store, _ = open_fs(self.uri)
        out = []
        for path, _ in listed(self.uri, ".tif", ".tiff"):
            t = Tiff(store, path)
            wanted = [i * t.across + j for i in range(t.down) for j in range(t.across) if t.within(i, j, self.low, self.high)]
            size = t.tile[0] * t.tile[1] * t.bands * t.dtype.itemsize
            step = max(1, self.most // size)
            out += [TileRange(path, wanted[a : a + step]) for a in range(0, len(wanted), step)]
        return out or [TileRange("", [])]

    def read(self, partition):
        if not partition.path:
            return
        store, _ = open_fs(self.uri)
        t = Tiff(store, partition.path)
        name = partition.path.rsplit("/", 1)[-1]
        for n in partition.tiles:
            r0, r1, c0, c1 = t.box(n // t.across, n % t.across)
            row, col = (a.ravel() for a in np.meshgrid(np.arange(r0, r1), np.arange(c0, c1), indexing="ij"))
            x, y = t.xy(row, col)
            for band in range(t.bands):
                m = t.pixels(n + band * t.down * t.across) if t.apart else (t.pixels(n) if band == 0 else m)
                v = np.full(len(x), np.nan) if m is None else m[: r1 - r0, : c1 - c0, 0 if t.apart else band].astype(np.float64).ravel()
                lost = np.isnan(v) if t.none is None else np.isnan(v) | (v == t.none)
                size = len(v)
                yield pa.RecordBatch.from_arrays([pa.array([name] * size), pa.array(np.full(size, band + 1, np.int32)), pa.array(y), pa.array(x), pa.array(v, mask=lost)], ["file", "band", "y", "x", "value"])


class GeoTiffSource(DataSource):
    @classmethod
    def name(cls):
        return "geotiff_grid"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return GeoTiffReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiffSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def file_bytes(values: np.ndarray, x0: float, y0: float, step: float) -> bytes:
    """A file of one tile of doubles, deflated; x0 and y0 are the centre of the first pixel, rows go down."""
    raw = zlib.compress(np.ascontiguousarray(values, "<f8").tobytes())
    height, width = values.shape
    none = b"nan\0"
    whole = {WIDTH: width, HEIGHT: height, BITS: 64, COMPRESSION: 8, SAMPLES: 1, STRIP_ROWS: height, STRIP_SIZES: len(raw), FORMAT: 3}
    far = {PIXEL_SCALE: (step, step, 0.0), TIE_POINT: (0.0, 0.0, 0.0, x0 - step / 2, y0 + step / 2, 0.0)}
    n = len(whole) + len(far) + 2
    at = 8 + 2 + 12 * n + 4
    body, entries = b"", {NO_DATA: struct.pack("<HHI4s", NO_DATA, 2, 4, none)}
    for tag, v in far.items():
        entries[tag] = struct.pack("<HHII", tag, 12, len(v), at + len(body))
        body += struct.pack(f"<{len(v)}d", *v)
    entries[STRIPS] = struct.pack("<HHII", STRIPS, 4, 1, at + len(body))
    entries |= {t: struct.pack("<HHII", t, 4, 1, v) for t, v in whole.items()}
    return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", n) + b"".join(entries[t] for t in sorted(entries)) + b"\0" * 4 + body + raw


def write(grid: DataFrame, path: str, step: float = 1.0, side: int = 256) -> None:
    """Files of at most side x side pixels from (x, y, value) on multiples of step; of several values the largest is kept."""
    col, row = F.round(F.col("x") / step).cast("long"), F.round(F.col("y") / step).cast("long")
    cells = grid.select(col.alias("col"), row.alias("row"), F.col("value").cast("double").alias("value")).where("col is not null and row is not null")
    cells = cells.withColumn("i", F.floor(F.col("row") / side)).withColumn("j", F.floor(F.col("col") / side))

    def one(key, pdf):
        i, j = (int(k) for k in key)
        full = np.full((side, side), np.nan)
        pdf = pdf.sort_values("value", na_position="first")
        full[(side - 1 - (pdf["row"] - i * side)).to_numpy(), (pdf["col"] - j * side).to_numpy()] = pdf["value"].to_numpy()
        write_whole(f"{path}/tile_{i}_{j}.tif", file_bytes(full, j * side * step, (i * side + side - 1) * step, step))
        return pd.DataFrame({"n": [len(pdf)]})

    cells.groupBy("i", "j").applyInPandas(one, "n long").write.format("noop").mode("overwrite").save()
