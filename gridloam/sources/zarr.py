"""A Python data source for Zarr (version 2) stores of daily grids, one partition for each chunk.

`spark.read.format("zarr_grid").option("variable", ...).load(path)` gives (obs_date, y, x, value) of a variable with
dimensions time, latitude and longitude; without the option it is the store's first variable. Chunks without a
compressor or with Blosc, zlib, gzip or zstd are read; others need the library that wrote them and are an error, as is a
chunk that can't be read, with its name. Missing chunks, fill values and NaN are NULL. Pushed-down days leave out the chunks
before and after.

`write` makes such a store of observations, a task for each chunk, with Blosc frames.
"""

from __future__ import annotations

import gzip
import json
import os
import shutil
import tempfile
import zipfile
import zlib
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from gridloam.sources import blosc
from gridloam.sources.store import write_whole

SCHEMA = "obs_date date, y double, x double, value double"


class BadChunk(ValueError):
    """A chunk that isn't what its array's metadata says."""


def _zstd(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(raw)


_EXPAND = {"blosc": blosc.unpack, "zlib": zlib.decompress, "gzip": gzip.decompress, "zstd": _zstd}


class Store:
    """Arrays of a store, by their metadata."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
        raw = self.get(".zmetadata")
        if raw is not None:
            meta = json.loads(raw)["metadata"]
        else:
            names = [x.base_name for x in self.fs.get_file_info(fs.FileSelector(self.root)) if x.type == fs.FileType.Directory]
            meta = {f"{n}/{k}": json.loads(r) for n in sorted(names) for k in (".zarray", ".zattrs") if (r := self.get(f"{n}/{k}")) is not None}
        self.arrays = {k.removesuffix("/.zarray"): (v, meta.get(k.removesuffix("/.zarray") + "/.zattrs", {})) for k, v in meta.items() if k.endswith("/.zarray")}

    def get(self, name: str) -> bytes | None:
        try:
            with self.fs.open_input_stream(f"{self.root}/{name}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def chunk(self, name: str, index: tuple[int, ...]) -> np.ndarray:
        spec = self.arrays[name][0]
        kind, shape = np.dtype(spec["dtype"]), spec["chunks"]
        raw = self.get(f"{name}/" + spec.get("dimension_separator", ".").join(map(str, index)))
        if raw is None:
            fill = spec.get("fill_value")
            return np.full(shape, np.nan if fill in (None, "NaN") else fill, np.float64)
        how = (spec.get("compressor") or {}).get("id")
        if how not in (None, *_EXPAND):
            raise ValueError(f"{name}: compressor {how} is not supported")
        try:
            raw = _EXPAND[how](raw) if how else raw
            return np.frombuffer(raw, kind).reshape(shape, order=spec.get("order", "C"))
        except Exception as e:  # each library has errors of its own
            raise BadChunk(f"chunk {name}/{'.'.join(map(str, index))}: {e}") from e

    def whole(self, name: str) -> np.ndarray:
        """A coordinate, which has one dimension."""
        spec = self.arrays[name][0]
        n, step = spec["shape"][0], spec["chunks"][0]
        return np.concatenate([self.chunk(name, (i,)) for i in range(-(-n // step))])[:n]

    def days(self, name: str) -> np.ndarray:
        """A time coordinate as days since 1970, by its `units`."""
        unit, _, since = self.arrays[name][1].get("units", "days since 1970-01-01").partition(" since ")
        first = (date.fromisoformat(since.strip()[:10]) - date(1970, 1, 1)).days
        return first + np.floor(self.whole(name).astype(np.float64) / {"days": 1, "hours": 24, "minutes": 1440, "seconds": 86400}[unit.strip()]).astype(np.int64)


class ChunkPartition(InputPartition):
    def __init__(self, index: tuple[int, int, int]):
        self.index = index


class ZarrReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.variable = options["path"], options.get("variable")
        self.first, self.last = -(1 << 40), 1 << 40

    def pushFilters(self, filters):
        for f in filters:
            if f.attribute == ("obs_date",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                d = (f.value - date(1970, 1, 1)).days
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.first = max(self.first, d)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.last = min(self.last, d)
            yield f  # chunks are coarser than days, so Spark filters too

    def _names(self, store: Store) -> tuple[str, list[str]]:
        name = self.variable or next(k for k, (v, _) in store.arrays.items() if len(v["shape"]) == 3)
        return name, store.arrays[name][1].get("_ARRAY_DIMENSIONS", ["time", "lat", "lon"])

    def partitions(self):
        store = Store(self.path)
        name, dims = self._names(store)
        spec, days = store.arrays[name][0], store.days(dims[0])
        n = [-(-s // c) for s, c in zip(spec["shape"], spec["chunks"], strict=True)]
        step = spec["chunks"][0]
        wanted = [t for t in range(n[0]) if ((d := days[t * step : (t + 1) * step]) >= self.first).any() and (d <= self.last).any()]
        return [ChunkPartition((t, i, j)) for t in wanted for i in range(n[1]) for j in range(n[2])] or [ChunkPartition((-1, 0, 0))]

    def read(self, partition):
        if partition.index[0] < 0:
            return
        store = Store(self.path)
        name, dims = self._names(store)
        spec = store.arrays[name][0]
        cut = [slice(k * c, (k + 1) * c) for k, c in zip(partition.index, spec["chunks"], strict=True)]
        t, y, x = store.days(dims[0])[cut[0]], store.whole(dims[1])[cut[1]].astype(float), store.whole(dims[2])[cut[2]].astype(float)
        values = store.chunk(name, partition.index)[: len(t), : len(y), : len(x)].astype(np.float64)
        fill = spec.get("fill_value")
        lost = np.isnan(values) if fill in (None, "NaN") else np.isnan(values) | (values == fill)
        for k in range(len(t)):
            v = values[k].ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(v.size, t[k], np.int32)).cast(pa.date32()), pa.array(np.repeat(y, len(x))), pa.array(np.tile(x, len(y))), pa.array(v, mask=lost[k].ravel())], ["obs_date", "y", "x", "value"])


class ZarrDataSource(DataSource):
    @classmethod
    def name(cls):
        return "zarr_grid"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ZarrReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZarrDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(obs: DataFrame, path: str, name: str = "value", chunks: tuple[int, int, int] = (365, 64, 64)) -> None:
    """A store of (obs_date, y, x, value), one variable over all days from the first to the last and the axes' own values.

    The axes come to the driver, as they are the store's coordinates; the values don't: each chunk that has any is one
    file, made by one task. Of several values of a cell and day the largest is kept.
    """
    obs = obs.select("obs_date", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.col("value").cast("double").alias("value"))
    first, last = obs.agg(F.min("obs_date"), F.max("obs_date")).first()
    if first is None:
        raise ValueError("no observations to write")
    axes = {c: np.array(sorted(r[0] for r in obs.select(c).where(F.col(c).isNotNull()).distinct().collect())) for c in ("y", "x")}
    start = (first - date(1970, 1, 1)).days
    axes = {"time": np.arange(start, start + (last - first).days + 1, dtype="<i8"), **axes}
    step = [min(c, len(a)) for c, a in zip(chunks, axes.values(), strict=True)]

    def array(shape, chunk, kind, fill):
        how = {"id": "blosc", "cname": "lz4", "clevel": 5, "shuffle": 1, "blocksize": 0}
        return {"zarr_format": 2, "shape": shape, "chunks": chunk, "dtype": kind, "compressor": how, "fill_value": fill, "order": "C", "filters": None}

    meta: dict[str, dict] = {".zgroup": {"zarr_format": 2}, ".zattrs": {}}
    for c, a in axes.items():
        write_whole(f"{path}/{c}/0", blosc.pack(a.astype("<i8" if c == "time" else "<f8").tobytes(), 8))
        meta[f"{c}/.zarray"] = array([len(a)], [len(a)], "<i8" if c == "time" else "<f8", None)
        meta[f"{c}/.zattrs"] = {"_ARRAY_DIMENSIONS": [c]} | ({"units": "days since 1970-01-01"} if c == "time" else {})
    meta[f"{name}/.zarray"] = array([len(a) for a in axes.values()], step, "<f8", "NaN")
    meta[f"{name}/.zattrs"] = {"_ARRAY_DIMENSIONS": list(axes)}

    # where each row lies: days by arithmetic, the axes by their sorted values
    def place(batches):
        for pdf in batches:
            t = (pd.to_datetime(pdf["obs_date"]).to_numpy("datetime64[D]").astype(np.int64) - start).astype(np.int64)
            at = [t, *(np.searchsorted(axes[c], pdf[c].to_numpy()) for c in ("y", "x"))]
            yield pd.DataFrame({n: v for n, v in zip("tij", at, strict=True)} | {f"{n}c": v // s for n, v, s in zip("tij", at, step, strict=True)} | {"value": pdf["value"].to_numpy()})

    def chunk(key, pdf):
        full = np.full(step, np.nan)
        pdf = pdf.sort_values("value")
        full[tuple(pdf[n].to_numpy() - k * s for n, k, s in zip("tij", key, step, strict=True))] = pdf["value"].to_numpy()
        write_whole(f"{path}/{name}/{'.'.join(str(int(k)) for k in key)}", blosc.pack(full.tobytes(), 8))
        return pd.DataFrame({"n": [len(pdf)]})

    kind = "t long, i long, j long, tc long, ic long, jc long, value double"
    placed = obs.where("value is not null and y is not null and x is not null").mapInPandas(place, kind)
    placed.groupBy("tc", "ic", "jc").applyInPandas(chunk, "n long").write.format("noop").mode("overwrite").save()
    for k, v in meta.items():
        write_whole(f"{path}/{k}", json.dumps(v).encode())
    write_whole(f"{path}/.zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": meta}).encode())


def years(folder: str, names: list[str]) -> dict[int, str]:
    """The stores of a folder by year, from names like 2020_v2.zarr; a folder goes before a .zarr.zip of its year."""
    found: dict[int, str] = {}
    for n in sorted(names, key=lambda n: (n.endswith(".zip"), n)):
        if n[:4].isdigit() and n.endswith((".zarr", ".zarr.zip")):
            found.setdefault(int(n[:4]), f"{folder}/{n}")
    return found


def year_store(folder: str, year: int) -> str:
    """The store of a year in a local folder; one that is only there as .zarr.zip is unpacked beside it first."""
    names = os.listdir(folder)
    path = years(folder, names).get(year)
    if path is None:
        raise FileNotFoundError(f"no store of {year} in {folder}")
    if not path.endswith(".zip"):
        return path
    part = tempfile.mkdtemp(dir=folder, prefix=".part-")
    with zipfile.ZipFile(path) as z:
        z.extractall(part)
    inner = [n for n in os.listdir(part) if n.endswith(".zarr")]
    whole = path.removesuffix(".zip")
    os.rename(os.path.join(part, inner[0]) if len(inner) == 1 and len(os.listdir(part)) == 1 else part, whole)
    shutil.rmtree(part, ignore_errors=True)
    return whole
