"""Maps as PNG tiles: each square of cells is one image, coloured by a shared scale and written by one task."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloam.sources.store import write_whole

#: Colours at even steps from the scale's lower to its upper end.
PALETTES = {
    "wet": [(255, 255, 229), (173, 221, 142), (49, 163, 84), (0, 69, 41)],
    "low": [(165, 0, 38), (254, 224, 139), (0, 104, 55)],
    "high": [(247, 251, 255), (107, 174, 214), (8, 48, 107)],
    "change": [(140, 81, 10), (245, 245, 245), (1, 102, 94)],
}


def coloured(values: np.ndarray, vmin: float, vmax: float, palette: str) -> np.ndarray:
    """RGBA of each value; beyond the scale its ends' colours, clear where there is no value."""
    stops = np.array(PALETTES[palette], float)
    share = np.clip((values - vmin) / (vmax - vmin) if vmax > vmin else np.full(values.shape, 0.5), 0, 1)
    share = np.where(np.isnan(values), 0, share)
    rgb = np.stack([np.interp(share, np.linspace(0, 1, len(stops)), stops[:, c]) for c in range(3)], -1)
    return np.concatenate([np.rint(rgb), np.where(np.isnan(values), 0, 255)[..., None]], -1).astype(np.uint8)


def png_bytes(pixels: np.ndarray) -> bytes:
    """An image of rows x columns x 4 bytes."""
    height, width = pixels.shape[:2]
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def write_tiles(grid: DataFrame, path: str, vmin: float, vmax: float, palette: str = "wet", step: float = 1.0, side: int = 256, zoom: int = 1) -> DataFrame:
    """(i, j, name, cells): the tiles written of (x, y, value) on multiples of step, north up, a cell `zoom` pixels wide.

    The scale is the caller's (`operators.grid.colour_scale`), so that the panels of a comparison share it. Of several
    values of a cell the largest is drawn. Nothing is written before the rows are read.
    """
    col, row = F.round(F.col("x") / step).cast("long"), F.round(F.col("y") / step).cast("long")
    cells = grid.select(col.alias("col"), row.alias("row"), F.col("value").cast("double").alias("value")).where("col is not null and row is not null")
    cells = cells.withColumn("i", F.floor(F.col("row") / side)).withColumn("j", F.floor(F.col("col") / side))

    def one(key, pdf):
        i, j = (int(k) for k in key)
        full = np.full((side, side), np.nan)
        pdf = pdf.sort_values("value", na_position="first")
        full[(side - 1 - (pdf["row"] - i * side)).to_numpy(), (pdf["col"] - j * side).to_numpy()] = pdf["value"].to_numpy()
        name = f"tile_{i}_{j}.png"
        write_whole(f"{path}/{name}", png_bytes(coloured(full, vmin, vmax, palette).repeat(zoom, 0).repeat(zoom, 1)))
        return pd.DataFrame({"i": [i], "j": [j], "name": [name], "cells": [int(np.isfinite(full).sum())]})

    return cells.groupBy("i", "j").applyInPandas(one, "i long, j long, name string, cells long")
