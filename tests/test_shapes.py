import math
import struct
from datetime import date

import pytest
from pyspark.sql import functions as F

from gridloam.functions.projection import Projection
from gridloam.operators import regions
from gridloam.sources import shapefile

SPHEROIDS = {"clarke": "6378206.4,294.9786982", "airy": "6377563.396,299.3249646", "wgs": "6378137,298.257223563"}


def wkt(projection, spheroid, unit=1.0, **parameters):
    said = "".join(f',PARAMETER["{k}",{v}]' for k, v in parameters.items())
    return f'PROJCS["p",GEOGCS["g",DATUM["d",SPHEROID["s",{SPHEROIDS[spheroid]}]],PRIMEM["G",0],UNIT["Degree",0.0174532925199433]],PROJECTION["{projection}"]{said},UNIT["u",{unit}]]'


#: Worked examples of the public guidance notes on coordinate conversions, and of Snyder's manual.
POINTS = [
    (wkt("Transverse_Mercator", "airy", False_Easting=400000, False_Northing=-100000, Central_Meridian=-2, Scale_Factor=0.9996012717, Latitude_Of_Origin=49), 577274.99, 69740.50, 0.5, 50.5),
    (wkt("Lambert_Conformal_Conic", "clarke", 0.304800609601219, False_Easting=2000000, False_Northing=0, Central_Meridian=-99, Standard_Parallel_1=28.383333333333333, Standard_Parallel_2=30.283333333333333, Latitude_Of_Origin=27.833333333333333), 2963503.91, 254759.80, -96.0, 28.5),
    (wkt("Lambert_Conformal_Conic_1SP", "clarke", False_Easting=250000, False_Northing=150000, Central_Meridian=-77, Scale_Factor=1, Latitude_Of_Origin=18), 255966.58, 142493.51, -(76 + 56 / 60 + 37.26 / 3600), 17 + 55 / 60 + 55.80 / 3600),
    (wkt("Mercator_Auxiliary_Sphere", "wgs"), 20037508.342789244 / 2, 6378137 * math.log(math.tan(math.radians(45 + 15))), 90.0, 30.0),
    ('GEOGCS["g",DATUM["d",SPHEROID["s",6378137,298.257223563]]]', 77.5, 12.25, 77.5, 12.25),
]


@pytest.mark.parametrize(("text", "x", "y", "lon", "lat"), POINTS)
def test_control_points(spark, text, x, y, lon, lat):
    """The points are printed to a hundredth of a unit, about 1e-7 degrees."""
    got = Projection.of_wkt(text).degrees(F.lit(x), F.lit(y))
    a, b = spark.range(1).select(*got).first()
    assert abs(a - lon) < 1.2e-7 and abs(b - lat) < 1.2e-7


def test_transverse_mercator_of_the_manual(spark):
    p = Projection("tm", 6378206.4, 294.9786982, 1.0, {"central_meridian": -75.0, "scale_factor": 0.9996})
    a, b = spark.range(1).select(*p.degrees(F.lit(127106.5), F.lit(4484124.4))).first()
    assert abs(a + 73.5) < 1e-6 and abs(b - 40.5) < 1e-6


def test_unknown_projection():
    with pytest.raises(ValueError, match="Krovak"):
        Projection.of_wkt(wkt("Krovak", "wgs"))


def box(x0, y0, x1, y1, hole=False):
    ring = [(x0, y0), (x0, y1), (x1, y1), (x1, y0)]  # clockwise, as outer rings are
    return ring[::-1] if hole else ring


def hand_made(folder, shapes, encoding=None, index=True, kind=5, name="a", deleted=()):
    """A shapefile put together byte by byte: names, numbers and polygons."""
    at, body, offsets, rows = 50, b"", b"", b""
    for n, (label, number, rings) in enumerate(shapes, 1):
        if rings is None:
            content = struct.pack("<i", 0)
        else:
            closed = [[*r, r[0]] for r in rings]
            flat = [v for r in closed for p in r for v in p]
            starts = [sum(map(len, closed[:i])) for i in range(len(closed))]
            content = struct.pack("<i4dii", kind, 0, 0, 0, 0, len(closed), len(flat) // 2) + struct.pack(f"<{len(starts)}i", *starts) + struct.pack(f"<{len(flat)}d", *flat)
            content += b"" if kind == 5 else struct.pack("<2d", 0, 0) + struct.pack(f"<{len(flat) // 2}d", *[7.0] * (len(flat) // 2))
        offsets += struct.pack(">ii", at, len(content) // 2)
        body += struct.pack(">ii", n, len(content) // 2) + content
        at += 4 + len(content) // 2
        rows += (b"*" if n - 1 in deleted else b" ") + label.encode(encoding or "latin-1").ljust(12) + (b" " * 8 if number is None else f"{number:8.3f}".encode()) + b"20200229T"
    head = lambda words: struct.pack(">i20xi", 9994, words) + struct.pack("<ii8d", 1000, kind, *[0] * 8)
    fields = b"".join(struct.pack("<11sc4xBB14x", n, k, w, d) for n, k, w, d in ((b"STATE", b"C", 12, 0), (b"AREA", b"N", 8, 3), (b"DAY", b"D", 8, 0), (b"OK", b"L", 1, 0)))
    (folder / f"{name}.shp").write_bytes(head(at) + body)
    if index:
        (folder / f"{name}.shx").write_bytes(head(50 + len(offsets) // 2) + offsets)
    (folder / f"{name}.dbf").write_bytes(struct.pack("<BBBBIHH20x", 3, 0, 0, 0, len(shapes), 33 + len(fields), 30) + fields + b"\r" + rows)
    if encoding:
        (folder / f"{name}.cpg").write_text(encoding)
    return str(folder)


SHAPES = [
    ("Holed ", 12.5, [box(0, 0, 4, 4), box(1, 1, 3, 3, True)]),
    ("Nowhere", None, None),
    ("Two parts", -1.25, [box(4, 0, 6, 4), box(7, 0, 8, 4)]),
    ("Örtlich", 0.0, [box(0, 4, 8, 9)]),
]


def read(spark, path, **options):
    shapefile.register(spark)
    return spark.read.format("shapefile").options(**options).load(path)


@pytest.mark.parametrize(("encoding", "index", "kind"), [(None, True, 5), ("UTF-8", True, 15), ("UTF-8", False, 25)])
def test_rows_of_hand_made_files(spark, tmp_path, encoding, index, kind):
    df = read(spark, hand_made(tmp_path, SHAPES, encoding, index, kind), partition_bytes=200)
    assert df.rdd.getNumPartitions() == (4 if index else 1)
    got = {r["STATE"]: r for r in df.collect()}
    assert {k: (r["AREA"], r["DAY"], r["OK"], r["holes"]) for k, r in got.items()} == {
        "Holed": (12.5, date(2020, 2, 29), True, [False, True]),
        "Nowhere": (None, date(2020, 2, 29), True, None),
        "Two parts": (-1.25, date(2020, 2, 29), True, [False, False]),
        "Örtlich": (0.0, date(2020, 2, 29), True, [False]),
    }
    assert [[tuple(p) for p in ring] for ring in got["Holed"]["rings"]] == SHAPES[0][2]


def test_deleted_rows_and_several_files(spark, tmp_path):
    hand_made(tmp_path, SHAPES, name="a", deleted=(0, 3))
    hand_made(tmp_path, SHAPES[:1], name="b")
    assert sorted(r["STATE"] for r in read(spark, str(tmp_path)).collect()) == ["Holed", "Nowhere", "Two parts"]


def test_cells_of_a_shapefile(spark, tmp_path):
    """The bridge of a shapefile's regions is that of the same rings given as rows."""
    cells = spark.createDataFrame([(i, i % 10 + 0.5, i // 10 + 0.5) for i in range(100)], "cell_id long, x double, y double")
    hand_made(tmp_path, SHAPES, "UTF-8")
    rows = [(n, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for n, _, rings in SHAPES if rings]
    plain = spark.createDataFrame(rows, "region string, rings array<array<struct<x:double,y:double>>>")
    want = sorted(map(tuple, regions.bridge(cells, plain, 3.0).collect()))
    assert sorted(map(tuple, regions.bridge(cells, shapefile.shapefile_regions(spark, str(tmp_path)), 3.0).collect())) == want
    # 12 around the hole, 12 of the two parts, 40 above
    assert [sum(r == n for _, r in want) for n in ("holed", "two parts", "örtlich")] == [12, 12, 40]


def test_regions_are_moved_to_degrees(spark, tmp_path):
    text, x, y, lon, lat = POINTS[0]
    hand_made(tmp_path, [("one", 1.0, [[(x, y), (x, y + 1000), (x + 1000, y)]])])
    (tmp_path / "a.prj").write_text(text)
    first = shapefile.shapefile_regions(spark, str(tmp_path)).first()["rings"][0][0]
    assert abs(first["x"] - lon) < 1.2e-7 and abs(first["y"] - lat) < 1.2e-7


@pytest.mark.parametrize(
    ("change", "said"),
    [
        (lambda b: b"\0" * 4 + b[4:], "no shapefile"),
        (lambda b: b[:-20], "ends within it"),
        (lambda b: b[:108] + struct.pack("<i", 3) + b[112:], "type 3"),
        (lambda b: b[:144] + struct.pack("<i", 1 << 20) + b[148:], "don't fit"),
    ],
)
def test_broken_files_are_errors(spark, tmp_path, change, said):
    hand_made(tmp_path, SHAPES)
    (tmp_path / "a.shp").write_bytes(change((tmp_path / "a.shp").read_bytes()))
    with pytest.raises(Exception, match=said):
        read(spark, str(tmp_path)).collect()


def test_no_file(spark, tmp_path):
    with pytest.raises(Exception, match="no .shp file"):
        read(spark, str(tmp_path)).collect()


def test_written_and_read_back(spark, tmp_path):
    rows = [(f"región {i}", i, i / 7, i % 2 == 0, date(2020, 1, 1 + i), [[{"x": float(i), "y": 0.1}, {"x": 0.0, "y": 5.5}, {"x": 2.0, "y": float(i)}]] if i else None) for i in range(9)]
    df = spark.createDataFrame(rows, "name string, n long, v double, even boolean, day date, rings array<array<struct<x:double,y:double>>>")
    shapefile.register(spark)
    df.repartition(3).write.format("shapefile").mode("append").save(str(tmp_path / "out"))
    back = read(spark, str(tmp_path / "out")).drop("holes")
    key = lambda r: r["n"]
    assert sorted(back.collect(), key=key) == sorted(df.collect(), key=key)
