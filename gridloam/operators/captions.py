"""Captions of figures and tables by where they stand on a page.

Boxes are (source, page, box, x0, y0, x1, y1), text blocks (source, page, block, x0, y0, x1, y1, text) with y growing downwards;
a page's blocks are numbered in reading order. Boxes and captions meet in bands of a page, as their different places only: a band's
places are sorted, and each box finds the earliest block of a range of them, so that no pairs are made. Ties go to the
earlier block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, in points: how far under and over a figure its caption begins and ends, how far one is taken at all, and how far
#: under a table; what a caption begins with.
BELOW, ABOVE, FARTHEST, UNDER_TABLE = (-10, 120), (-60, 10), 200, (0, 60)
FIGURE, TABLE = r"(?i)^(?:figure|fig\.?)\s*(\d+)", r"(?i)^table\s*\d*"
MOST_CHARS = 200
_BOX, _PAGE = ("source", "page", "box"), ("source", "page")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _band(edge: Column) -> Column:
    return F.floor(edge / FARTHEST)


def _captions(blocks: DataFrame, boxes: DataFrame, begins: str) -> DataFrame:
    """(source, page, block, y0, y1, text) of the blocks that are captions."""
    page = [F.col(c).cast(boxes.schema[c].dataType).alias(c) for c in _PAGE]
    out = blocks.select(*page, F.col("block").cast("long").alias("block"), *[F.col(c).cast("double").alias(c) for c in ("y0", "y1")], _stripped(F.col("text")).alias("text"))
    return out.where(F.col("text").rlike(begins))


def _earliest(at: np.ndarray, block: np.ndarray, q: np.ndarray, low, high) -> np.ndarray:
    """The least block of those places `at` (ascending) with low <= at - q <= high, for each q; the largest whole number if none."""
    n, none = len(at), np.iinfo(np.int64).max
    i, j = np.searchsorted(at, q + low, "left"), np.searchsorted(at, q + high, "right")
    # sums and differences round differently: the difference decides
    for bound, inside in ((i, lambda d: d >= low), (j, lambda d: d > high)):
        while (back := (bound > 0) & inside(at[np.maximum(bound - 1, 0)] - q)).any():
            bound -= back
        while (on := (bound < n) & ~inside(at[np.minimum(bound, n - 1)] - q)).any():
            bound += on
    out, wide, least = np.full(len(q), none), 1, block
    while wide <= n:  # `least` holds the least of each `wide` places in a row
        mine = (j - i >= wide) & (j - i < 2 * wide)
        out[mine] = np.minimum(least[i[mine]], least[j[mine] - wide])
        least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
    return out


def _met(boxes: DataFrame, captions: DataFrame, edges: list[tuple[str, str, tuple[int, int]]], farthest: int = 0) -> DataFrame:
    """(source, page, box, text): the caption of each box that has one; an earlier edge goes before a later one.

    An edge is (column of the box, column of the caption, range): a caption is within the range of the box there. If none is at
    any edge, the nearest under `farthest` at one of them is taken.
    """
    kinds = [f"{c} {boxes.schema[c].dataType.simpleString()}" for c in _PAGE]
    key, ranges = [*_PAGE, "edge", "band"], [r for *_, r in edges]
    place = lambda c, e: F.struct(F.lit(e).alias("edge"), F.col(c).cast("double").alias("at"))
    there = captions.select(*_PAGE, "block", F.inline(F.array(*[place(c, e) for e, (_, c, _) in enumerate(edges)]))).where(~F.isnan("at"))
    there = there.groupBy(*_PAGE, "edge", "at").agg(F.min("block").alias("block"))
    there = there.select("*", F.explode(F.array(*[_band(F.col("at")) + d for d in (-1, 0, 1)])).alias("band"))
    asked = boxes.select(*_PAGE, F.inline(F.array(*[place(b, e) for e, (b, _, _) in enumerate(edges)]))).where(~F.isnan("at")).distinct().withColumn("band", _band(F.col("at")))

    def meet(key, near: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        near, none = near.sort_values("at"), np.iinfo(np.int64).max
        at, block, q, edge = near["at"].to_numpy(), near["block"].to_numpy(), mine["at"].to_numpy(), int(mine["edge"].iloc[0]) if len(mine) else 0
        if not len(at):
            q = q[:0]
        best = _earliest(at, block, q, *ranges[edge]) if len(q) else q.astype(np.int64)
        rank, far = np.full(len(q), edge), np.zeros(len(q))
        if farthest and len(q):
            i = np.searchsorted(at, q)
            d = np.minimum(np.abs(at[np.maximum(i - 1, 0)] - q), np.abs(at[np.minimum(i, len(at) - 1)] - q))
            other = (best == none) & (d < farthest)
            best[other], rank[other], far[other] = _earliest(at, block, q[other], -d[other], d[other]), len(ranges), d[other]
        out = pd.DataFrame({"edge": edge, "at": q, "rank": rank, "far": far, "block": best})
        return out.assign(**dict(zip(_PAGE, key, strict=False)))[[*_PAGE, *out.columns]][best != none]

    found = there.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(meet, f"{', '.join(kinds)}, edge int, at double, rank int, far double, block long")
    out, bests = boxes.select(*_BOX, *[F.col(b).cast("double").alias(b) for b, *_ in edges]), []
    for e, (b, *_) in enumerate(edges):
        bests.append(f"best{e}")
        one = found.where(F.col("edge") == e).select(*_PAGE, F.col("at").alias(b), F.struct("rank", "far", "block").alias(bests[-1]))
        out = out.join(one, [*_PAGE, b], "left")
    best = F.least(*bests) if len(bests) > 1 else F.col(bests[0])
    said = captions.groupBy(*_PAGE, "block").agg(F.min("text").alias("text"))
    return out.select(*_BOX, best["block"].alias("block")).where("block is not null").join(said, [*_PAGE, "block"]).select(*_BOX, "text")


def figure_captions(boxes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(source, page, box, caption, number) of every figure; NULL where no caption is near.

    A caption under the figure goes before one over it, and that before the nearest one on the page, within 200 points.
    """
    # a caption's upper edge is near the figure's lower one, or its lower edge near the upper one
    best = _met(boxes, _captions(blocks, boxes, FIGURE), [("y1", "y0", BELOW), ("y0", "y1", ABOVE)], FARTHEST)
    named = best.select(*_BOX, F.replace("text", F.lit("\n"), F.lit(" ")).alias("caption"), F.regexp_extract("text", FIGURE, 1).cast("long").alias("number"))
    return boxes.select(*_BOX).join(named, list(_BOX), "left")


def table_captions(boxes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(source, page, box, caption) of every table: the first caption that begins within 60 points under it, or its page."""
    best = _met(boxes, _captions(blocks, boxes, TABLE), [("y1", "y0", UNDER_TABLE)])
    best = best.select(*_BOX, F.left("text", F.lit(MOST_CHARS)).alias("caption"))
    out = boxes.select(*_BOX).join(best, list(_BOX), "left")
    return out.withColumn("caption", F.coalesce("caption", F.concat(F.lit("Table on page "), F.col("page").cast("string"))))
