"""A Python data source for polygon shapefiles, read by ranges of records, and a sink that writes them.

`spark.read.format("shapefile").load(path)` gives the columns of the .dbf table, then `rings` (arrays of points x, y) and
`holes` (which rings run counter-clockwise, as holes do). The path is a .shp file or a folder of them with one set of
columns. A file is cut into partitions by record numbers, which its .shx index turns into byte ranges (the option
`partition_bytes` says how large); without an index it is walked by one task. Null shapes and deleted rows are NULL and left out; what contradicts the format is an error that names the
file and the record. Points and lines are not read.

`df.write.format("shapefile").mode("append").save(folder)` writes a set of files for each partition of a table with
`rings` and columns of text, whole numbers, doubles, booleans or dates.
"""

from __future__ import annotations

import struct
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from gridloam.functions.projection import Projection
from gridloam.sources.store import listed, open_fs, read_range, write_whole

#: Bytes of polygons in a partition.
PARTITION_BYTES = 16 << 20
#: Polygons, with heights or measures, which follow the points and are passed over.
POLYGONS = (5, 15, 25)
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
SHAPE = [T.StructField("rings", T.ArrayType(T.ArrayType(POINT))), T.StructField("holes", T.ArrayType(T.BooleanType()))]


class BadShapefile(ValueError):
    """A file that isn't what its header says."""


class Table:
    """The .dbf table beside a .shp file."""

    def __init__(self, store, path: str):
        self.store, self.path = store, path
        head = read_range(store, path, 0, 32)
        if len(head) < 32:
            raise BadShapefile(f"{path}: no table header")
        self.rows, self.start, self.width = struct.unpack_from("<IHH", head, 4)
        fields = read_range(store, path, 32, self.start - 32)
        self.fields, at = [], 1
        for i in range(0, len(fields) - 31, 32):
            if fields[i] == 0x0D:
                break
            name, kind = fields[i : i + 11].split(b"\0")[0].decode("latin-1"), chr(fields[i + 11])
            self.fields.append((name, kind, at, fields[i + 16], fields[i + 17]))
            at += fields[i + 16]
        if at > self.width:
            raise BadShapefile(f"{path}: fields of {at} bytes in rows of {self.width}")
        self.encoding = "latin-1"
        try:
            said = read_range(store, path[:-4] + ".cpg").decode("ascii", "replace").strip().lower()
            self.encoding = {"65001": "utf-8", "utf8": "utf-8"}.get(said, said) or "latin-1"
        except FileNotFoundError:
            pass

    def schema(self) -> list[T.StructField]:
        kinds = {"L": T.BooleanType(), "D": T.DateType(), "F": T.DoubleType(), "O": T.DoubleType()}
        whole = {"N": T.LongType(), "I": T.LongType()}
        return [T.StructField(n, kinds.get(k) or (T.DoubleType() if k == "N" and (d or w > 18) else whole.get(k)) or T.StringType()) for n, k, _, w, d in self.fields]

    def values(self, first: int, last: int):
        """The rows of those numbers; None for a deleted one."""
        raw = read_range(self.store, self.path, self.start + first * self.width, (last - first) * self.width)
        if len(raw) < (last - first) * self.width:
            raise BadShapefile(f"{self.path}: ends before row {last}")
        kinds = [f.dataType for f in self.schema()]
        for a in range(0, len(raw), self.width):
            row = raw[a : a + self.width]
            if row[:1] == b"*":
                yield None
                continue
            yield [self._value(row[at : at + w], kind, t) for (_, kind, at, w, _), t in zip(self.fields, kinds, strict=True)]

    def _value(self, raw: bytes, kind: str, to: T.DataType):
        text = raw.decode(self.encoding, "replace").strip(" \0")
        if not text or (kind in "NF" and set(text) == {"*"}):
            return None
        if isinstance(to, T.StringType):
            return text
        if isinstance(to, T.BooleanType):
            return {"t": True, "y": True, "f": False, "n": False}.get(text.lower())
        try:
            if isinstance(to, T.DateType):
                return date(int(text[:4]), int(text[4:6]), int(text[6:8]))
            return int(text) if isinstance(to, T.LongType) else float(text)
        except ValueError as e:
            raise BadShapefile(f"{self.path}: {text!r} is no {to.simpleString()}") from e


def shape_rings(raw: bytes, name: str) -> tuple[list | None, list | None]:
    """(rings, holes) of a record's content."""
    kind = struct.unpack_from("<i", raw)[0] if len(raw) >= 4 else -1
    if kind == 0:
        return None, None
    if kind not in POLYGONS or len(raw) < 44:
        raise BadShapefile(f"{name}: shape of type {kind} is no polygon")
    parts, points = struct.unpack_from("<ii", raw, 36)
    if parts < 0 or points < 0 or 44 + 4 * parts + 16 * points > len(raw):
        raise BadShapefile(f"{name}: {parts} parts and {points} points don't fit into {len(raw)} bytes")
    cut = [*struct.unpack_from(f"<{parts}i", raw, 44), points]
    flat = struct.unpack_from(f"<{2 * points}d", raw, 44 + 4 * parts)
    rings, holes = [], []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if not 0 <= a <= b:
            raise BadShapefile(f"{name}: part from {a} to {b}")
        ring = list(zip(flat[2 * a : 2 * b : 2], flat[2 * a + 1 : 2 * b : 2], strict=True))
        if ring and ring[0] == ring[-1]:
            ring.pop()
        # twice the area, from the first point for accuracy: positive where the ring runs counter-clockwise
        x0, y0 = ring[0] if ring else (0.0, 0.0)
        turned = zip(ring, ring[1:] + ring[:1], strict=True)
        rings.append(ring)
        holes.append(sum((x - x0) * (v - y0) - (u - x0) * (y - y0) for (x, y), (u, v) in turned) > 0)
    return rings, holes


class RecordRange(InputPartition):
    def __init__(self, path: str, first: int, last: int | None):
        self.path, self.first, self.last = path, first, last


class ShapefileReader(DataSourceReader):
    def __init__(self, uri: str, partition_bytes: int = PARTITION_BYTES):
        self.uri, self.partition_bytes = uri, partition_bytes

    def partitions(self):
        store, _ = open_fs(self.uri)
        out = []
        for path, size in listed(self.uri, ".shp"):
            index = store.get_file_info(path[:-4] + ".shx")
            n = max(0, ((index.size or 0) - 100) // 8)
            if not index.is_file:
                out.append(RecordRange(path, 0, None))
                continue
            step = max(1, -(-n // max(1, -(-size // self.partition_bytes))))
            out += [RecordRange(path, a, min(n, a + step)) for a in range(0, n, step)]
        return out or [RecordRange("", 0, 0)]

    def _spans(self, store, p: RecordRange):
        """(offset, length) of the contents of the records."""
        if p.last is not None:
            raw = read_range(store, p.path[:-4] + ".shx", 100 + 8 * p.first, 8 * (p.last - p.first))
            return [(2 * a + 8, 2 * n) for a, n in struct.iter_unpack(">ii", raw)]
        spans, at, size = [], 100, store.get_file_info(p.path).size
        while at + 8 <= size:
            _, n = struct.unpack(">ii", read_range(store, p.path, at, 8))
            spans.append((at + 8, 2 * n))
            at += 8 + 2 * max(n, 0)
        return spans

    def read(self, partition):
        if not partition.path:
            return
        store, _ = open_fs(self.uri)
        head = read_range(store, partition.path, 0, 100)
        if len(head) < 100 or struct.unpack_from(">i", head)[0] != 9994:
            raise BadShapefile(f"{partition.path}: no shapefile")
        spans = self._spans(store, partition)
        if not spans:
            return
        first = partition.first
        rows = Table(store, partition.path[:-4] + ".dbf").values(first, first + len(spans))
        low, high = min(a for a, _ in spans), max(a + n for a, n in spans)
        if low < 108 or min(n for _, n in spans) < 4:
            raise BadShapefile(f"{partition.path}: records {first} to {first + len(spans)} lie outside")
        raw = read_range(store, partition.path, low, high - low)
        for i, ((a, n), row) in enumerate(zip(spans, rows, strict=True), first):
            name = f"{partition.path}, record {i}"
            if a - low + n > len(raw):
                raise BadShapefile(f"{name}: the file ends within it")
            if row is not None:
                yield (*row, *shape_rings(raw[a - low : a - low + n], name))


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class ShapefileWriter(DataSourceWriter):
    def __init__(self, uri: str, schema: T.StructType):
        self.uri, self.schema = uri.rstrip("/"), schema

    def write(self, iterator):
        columns = [f for f in self.schema if f.name not in ("rings", "holes")]
        sizes = {T.LongType: ("N", 18, 0), T.IntegerType: ("N", 11, 0), T.DoubleType: ("F", 24, 16), T.BooleanType: ("L", 1, 0), T.DateType: ("D", 8, 0), T.StringType: ("C", 254, 0)}
        kinds = [sizes[type(f.dataType)] for f in columns]
        shapes, index, rows = [], [], []
        at = 50
        for n, row in enumerate(iterator, 1):
            body = shape_bytes(row["rings"])
            index.append(struct.pack(">ii", at, len(body) // 2))
            shapes.append(struct.pack(">ii", n, len(body) // 2) + body)
            at += 4 + len(body) // 2
            rows.append(b" " + b"".join(self._cell(row[f.name], k, w, f.name) for f, (k, w, _) in zip(columns, kinds, strict=True)))
        if not rows:
            return Written([])
        name = f"{self.uri}/part-{uuid.uuid4().hex}"
        fields = b"".join(struct.pack("<11scIBB14x", f.name.encode()[:10], k.encode(), 0, w, d) for f, (k, w, d) in zip(columns, kinds, strict=True))
        width = 1 + sum(w for _, w, _ in kinds)
        table = struct.pack("<BBBBIHH20x", 3, 95, 7, 26, len(rows), 33 + len(fields), width) + fields + b"\r" + b"".join(rows) + b"\x1a"
        # the .shp last: it is what a reader looks for
        made = {".dbf": table, ".cpg": b"UTF-8", ".shx": _head(50 + 4 * len(index)) + b"".join(index), ".shp": _head(at) + b"".join(shapes)}
        for ending, data in made.items():
            write_whole(name + ending, data)
        return Written([name + e for e in made])

    @staticmethod
    def _cell(value, kind: str, width: int, name: str) -> bytes:
        if value is None:
            return b" " * width
        text = {"L": lambda: "T" if value else "F", "D": lambda: value.strftime("%Y%m%d"), "F": lambda: f"{value:.16e}", "N": lambda: str(value)}.get(kind, lambda: str(value))()
        raw = text.encode()
        if len(raw) > width:
            raise ValueError(f"{name}: {text!r} is longer than {width} bytes")
        return raw.rjust(width) if kind in "NF" else raw.ljust(width)

    def abort(self, messages):
        store, _ = open_fs(self.uri)
        for m in messages:
            for name in m.names if m else []:
                store.delete_file(open_fs(name)[1])


def _head(words: int) -> bytes:
    return struct.pack(">i20xi", 9994, words) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8)


def shape_bytes(rings) -> bytes:
    """A polygon's record; rings are closed, none is a null shape."""
    if rings is None:
        return struct.pack("<i", 0)
    closed = [[(p["x"], p["y"]) for p in [*ring, ring[0]]] for ring in rings if ring]
    flat = [v for ring in closed for p in ring for v in p]
    box = (min(flat[::2]), min(flat[1::2]), max(flat[::2]), max(flat[1::2])) if flat else (0.0,) * 4
    starts = [sum(map(len, closed[:i])) for i in range(len(closed))]
    return struct.pack(f"<i4dii{len(closed)}i{len(flat)}d", 5, *box, len(closed), len(flat) // 2, *starts, *flat)


class ShapefileSource(DataSource):
    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        found = listed(self.options["path"], ".shp")
        if not found:
            raise FileNotFoundError(f"no .shp file in {self.options['path']}")
        store, _ = open_fs(self.options["path"])
        return T.StructType(Table(store, found[0][0][:-4] + ".dbf").schema() + SHAPE)

    def reader(self, schema):
        return ShapefileReader(self.options["path"], int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("shapefiles are appended; give a new folder")
        return ShapefileWriter(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapefileSource)


def projection_of(path: str) -> Projection:
    """By the .prj file beside the first .shp file; degrees if there is none."""
    store, _ = open_fs(path)
    for name, _ in listed(path, ".shp")[:1]:
        try:
            return Projection.of_wkt(read_range(store, name[:-4] + ".prj").decode("utf-8", "replace"))
        except FileNotFoundError:
            break
    return Projection()


def shapefile_regions(spark: SparkSession, path: str, name: str = "STATE") -> DataFrame:
    """(region, rings) of a shapefile's polygons in degrees, as `operators.regions.bridge` takes them."""
    register(spark)
    shapes = spark.read.format("shapefile").load(path).where(F.col("rings").isNotNull())
    return shapes.select(F.col(name).cast("string").alias("region"), projection_of(path).rings(F.col("rings")).alias("rings"))
