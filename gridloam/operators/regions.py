"""Cells in polygons: the bridge between the grid and its regions, made once at ingest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of the square tiles in which cells and polygons meet.
TILE = 1.0


def inside(x: np.ndarray, y: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Which points lie in a polygon of rings (holes too), by counting edges to the right.

    Edges are half-open, so that a point on the border of two polygons lies in at most one of them.
    """
    odd = np.zeros(len(x), bool)
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            if y0 != y1:
                crosses = (y >= min(y0, y1)) & (y < max(y0, y1))
                odd ^= crosses & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
    return odd


def bridge(cells: DataFrame, regions: DataFrame, tile: float = TILE) -> DataFrame:
    """(cell_id, region) of cells (cell_id, x, y) whose centre lies in a region (region, rings), which may have several rows.

    A polygon is sent to the tiles that its bounding box touches, and meets their cells there: once for each tile. A tile's
    cells and polygons are one task's group, so `tile` goes with the grid's resolution.
    """
    points = F.flatten("rings")
    low = lambda axis: F.floor(F.array_min(F.transform(points, lambda p: p[axis])) / tile)
    high = lambda axis: F.floor(F.array_max(F.transform(points, lambda p: p[axis])) / tile)
    across, down = F.sequence(low("x"), high("x")), F.sequence(low("y"), high("y"))
    # points as plain numbers, and where each ring ends
    flat = F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))
    ends = F.transform(F.sequence(F.lit(1), F.size("rings")), lambda n: F.aggregate(F.slice("rings", 1, n), F.lit(0), lambda s, r: s + F.size(r)))
    named = regions.where(F.size(points) > 0).select(F.lower(F.trim("region")).alias("region"), flat.alias("flat"), ends.alias("ends"), F.explode(across).alias("tx"), down.alias("tys"))
    spread = named.select("region", "flat", "ends", "tx", F.explode("tys").alias("ty"))
    at = cells.select("cell_id", "x", "y", F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty"))

    def keep(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x, y = left["x"].to_numpy(float), left["y"].to_numpy(float)
        found: tuple[list, list] = [], []
        for region, flat, ends in zip(right["region"], right["flat"], right["ends"], strict=True):
            rings = np.split(np.asarray(flat, float).reshape(-1, 2), np.asarray(ends, int)[:-1])
            hit = left["cell_id"][inside(x, y, rings)].tolist()
            found[0].extend(hit), found[1].extend([region] * len(hit))
        return pd.DataFrame({"cell_id": np.array(found[0], np.int64), "region": np.array(found[1], object)})

    met = at.groupBy("tx", "ty").cogroup(spread.groupBy("tx", "ty")).applyInPandas(keep, "cell_id long, region string")
    return met.distinct()


def catalogue(regions: DataFrame) -> DataFrame:
    return regions.select(F.lower(F.trim("region")).alias("region")).distinct()


def borders(regions: DataFrame) -> DataFrame:
    """(region, ring, no, x0, y0, x1, y1): the edges of every ring, the closing one too, to be drawn over a map."""
    ring = regions.select(F.lower(F.trim("region")).alias("region"), F.posexplode("rings").alias("ring", "points")).where("size(points) > 1")
    n = F.size("points")
    at = ring.select("region", "ring", "points", F.posexplode("points").alias("no", "a"), F.element_at("points", 1).alias("first"), n.alias("n"))
    b = F.coalesce(F.get("points", F.col("no") + 1), F.col("first"))
    out = at.select("region", "ring", "no", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"))
    return out.where("x0 <> x1 or y0 <> y1")  # rings may be closed already
