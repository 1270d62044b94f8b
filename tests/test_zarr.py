import json
import zlib
from datetime import date

import numpy as np
import pytest

from gridloam.sources import zarr


def build(root, compressor, fill):
    """A store of 5 days x 3 x 4 cells in chunks of 2 x 2 x 3, one chunk missing."""
    rng = np.random.default_rng(0)
    values = rng.random((5, 3, 4)).round(3)
    values[1, 0, 0] = np.nan if fill == "NaN" else fill
    coords = {"time": np.arange(5) * 24, "lat": np.array([30.0, 29.5, 29.0]), "lon": np.array([70.0, 70.5, 71.0, 71.5])}
    pack = (lambda b: zlib.compress(b)) if compressor else (lambda b: b)
    spec = lambda a, chunks, f: {"shape": list(a.shape), "chunks": chunks, "dtype": a.dtype.str, "compressor": compressor, "fill_value": f, "order": "C", "filters": None, "zarr_format": 2}
    meta = {}
    for name, a in coords.items():
        (root / name).mkdir(parents=True)
        (root / name / "0").write_bytes(pack(a.tobytes()))
        meta[f"{name}/.zarray"], meta[f"{name}/.zattrs"] = spec(a, [len(a)], None), {"units": "hours since 2020-02-27"} if name == "time" else {}
    (root / "sm").mkdir()
    meta["sm/.zarray"], meta["sm/.zattrs"] = spec(values, [2, 2, 3], fill), {"_ARRAY_DIMENSIONS": ["time", "lat", "lon"]}
    full = np.zeros((6, 4, 6))
    full[:5, :3, :4] = values
    for t in range(3):
        for i in range(2):
            for j in range(2):
                if (t, i, j) != (2, 1, 1):
                    (root / "sm" / f"{t}.{i}.{j}").write_bytes(pack(np.ascontiguousarray(full[2 * t : 2 * t + 2, 2 * i : 2 * i + 2, 3 * j : 3 * j + 3]).tobytes()))
    (root / ".zmetadata").write_text(json.dumps({"metadata": meta}))
    return values, coords


@pytest.mark.parametrize("compressor,fill", [(None, "NaN"), ({"id": "zlib", "level": 1}, -9999.0)])
def test_read(spark, tmp_path, compressor, fill):
    values, coords = build(tmp_path / "2020_v2.zarr", compressor, fill)
    zarr.register(spark)
    df = spark.read.format("zarr_grid").load(str(tmp_path / "2020_v2.zarr"))
    got = {(r["obs_date"], r["y"], r["x"]): r["value"] for r in df.collect()}
    assert len(got) == 60
    for t in range(5):
        for i, y in enumerate(coords["lat"]):
            for j, x in enumerate(coords["lon"]):
                lost = (t, i, j) == (1, 0, 0) or (t, i, j) == (4, 2, 3)
                assert got[(date.fromordinal(date(2020, 2, 27).toordinal() + t), y, x)] == (None if lost else values[t, i, j])
    assert df.where("obs_date between date'2020-02-29' and date'2020-03-01'").count() == 24
    assert df.where("obs_date > date'2021-01-01'").count() == 0
    assert zarr.years("/data", ["2020_v2.zarr", "x.txt", "2019_v2.zarr"]) == {2019: "/data/2019_v2.zarr", 2020: "/data/2020_v2.zarr"}
