"""Reading documents and grids from files, and writing results."""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloam.functions.text import base_name
from gridloam.sources import pdf
from gridloam.sources.tables import clean

EXTENSIONS = ("pdf", "docx", "txt", "md")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decoded(raw: bytes) -> str:
    """UTF-8 with or without a mark, else Latin-1."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def docx_text(raw: bytes) -> str:
    """The paragraphs of a .docx that aren't blank."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in body.iter(f"{_WORD}p"))
    return "\n".join(x for x in lines if x.strip())


def file_text(name: str, raw: bytes) -> str:
    kind = name.rsplit(".", 1)[-1].lower()
    try:
        return {"docx": docx_text, "pdf": pdf.text}.get(kind, decoded)(raw)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""


def read_documents(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """(source, text) of the files with a known extension that aren't loaded yet and have text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            yield pd.DataFrame({"source": files["source"], "text": [file_text(n, c) for n, c in zip(files["source"], files["content"], strict=True)]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.withColumn("source", base_name(F.col("path"))).where(F.lower("source").rlike(r"\.(" + "|".join(EXTENSIONS) + ")$"))
    if known is not None:
        files = files.join(known.select("source").distinct(), "source", "left_anti")
    return files.select("source", "content").mapInPandas(run, "source string, text string").where(F.length(F.trim("text")) > 0)


def grid_rows(values: np.ndarray, x0: float, dx: float, y0: float, dy: float) -> pd.DataFrame:
    """(x, y, value) of a raster at its pixels' centres."""
    j, i = np.meshgrid(np.arange(values.shape[1]), np.arange(values.shape[0]))
    return pd.DataFrame({"x": (x0 + (j + 0.5) * dx).ravel(), "y": (y0 + (i + 0.5) * dy).ravel(), "value": values.ravel()})


def long_grid(df: DataFrame, time: str, lat: str, lon: str, value: str) -> DataFrame:
    """Observations from any table with those columns; NaN becomes NULL."""
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    return df.select(F.to_date(time).alias("obs_date"), F.xxhash64(x, y).alias("cell_id"), x.alias("x"), y.alias("y"), clean(F.col(value)).alias("value"))


def coordinate_names(columns: list[str]) -> dict[str, str]:
    """Which columns are latitude and longitude, by their names."""
    return {"lat": next(c for c in columns if "lat" in c.lower()), "lon": next(c for c in columns if "lon" in c.lower())}


def write_observations(obs: DataFrame, path: str) -> None:
    """By year, so that a span of years reads those alone; cells lie together within a file."""
    obs.withColumn("year", F.year("obs_date")).repartition("year", F.pmod(F.hash("cell_id"), F.lit(16))).sortWithinPartitions("cell_id", "obs_date").write.mode("overwrite").partitionBy("year").parquet(path)


def read_years(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Observations of those years; a year that is missing is an error."""
    obs = spark.read.parquet(path).where(F.col("year").between(first, last))
    have = {r["year"] for r in obs.select("year").distinct().collect()}
    if gone := sorted(set(range(first, last + 1)) - have):
        raise FileNotFoundError(f"no observations of {', '.join(map(str, gone))}")
    return obs


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


IMAGES = ("png", "jpg", "jpeg", "gif", "bmp", "webp")


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path, length) of the images in a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = files.select(base_name(F.col("path")).alias("name"), "path", "length")
    return named.where(F.lower("name").rlike(r"\.(" + "|".join(IMAGES) + ")$"))


def unique_name(ending: str, *about: object) -> str:
    """A file name that no other call gives, with the letters and digits of what it is about."""
    words = re.findall(r"\w+", " ".join(str(a) for a in about if a is not None))
    return "-".join([*words, uuid.uuid4().hex]) + f".{ending}"


def geojson_regions(spark: SparkSession, path: str, name: str = "STATE", to_degrees: Callable[[float, float], tuple[float, float]] | None = None) -> DataFrame:
    """(region, rings) of a GeoJSON file's polygons, multipolygons too; `to_degrees` reprojects each point.

    Polygon layers are small; a file is read by one task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for raw in files["content"]:
                rows = []
                for f in json.loads(decoded(raw))["features"]:
                    g = f.get("geometry") or {}
                    polygons = {"Polygon": [g.get("coordinates")], "MultiPolygon": g.get("coordinates")}.get(g.get("type"), [])
                    move = to_degrees or (lambda x, y: (x, y))
                    rings = [[dict(zip("xy", map(float, move(*p[:2])), strict=True)) for p in ring] for poly in polygons for ring in poly]
                    if rings:
                        rows.append((f.get("properties", {}).get(name), rings))
                yield pd.DataFrame(rows, columns=["region", "rings"])

    kind = "region string, rings array<array<struct<x:double,y:double>>>"
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, kind)
