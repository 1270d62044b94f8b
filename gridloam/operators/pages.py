"""Figures and tables of pages, from the places of their images, rules and words (`sources.pdf`), as assets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloam.functions.text import table_text
from gridloam.operators import captions
from gridloam.operators.assets import LEAST_SIDE

#: Points by which rules may miss one another, rows that a table has at least.
NEAR, LEAST_ROWS = 3.0, 2


def _page_text(items: DataFrame) -> DataFrame:
    blocks = items.where("kind = 'block'").groupBy("source", "page").agg(F.array_sort(F.collect_list(F.struct("no", "text"))).alias("b"))  # one page
    return blocks.select("source", "page", F.array_join(F.transform("b", lambda b: b["text"]), "\n").alias("page_text"))


def _blocks(items: DataFrame) -> DataFrame:
    return items.where("kind = 'block'").select("source", "page", F.col("no").alias("block"), "x0", "y0", "x1", "y1", "text")


def figures(items: DataFrame, least: int = LEAST_SIDE) -> DataFrame:
    """(source, type, page, idx, caption, page_text, content, width, height) of images of `least` pixels and more each way.

    The number is the caption's; images without one are numbered on within their document.
    """
    images = items.where((F.col("kind") == "image") & (F.col("width") >= least) & (F.col("height") >= least)).withColumnRenamed("no", "box")
    said = captions.figure_captions(images.select("source", "page", "box", "x0", "y0", "x1", "y1"), _blocks(items))
    out = images.select("source", "page", "box", "content", "width", "height").join(said, ["source", "page", "box"])
    # those without a number come after the numbers of their document
    whole, order = Window.partitionBy("source"), Window.partitionBy("source", F.col("number").isNull()).orderBy("page", "box")
    idx = F.coalesce("number", F.coalesce(F.max("number").over(whole), F.lit(0)) + F.row_number().over(order)).cast("int")
    out = out.withColumn("idx", idx).join(_page_text(items), ["source", "page"], "left")
    return out.select("source", F.lit("figure").alias("type"), "page", "idx", "caption", "page_text", "content", "width", "height")


def _cells(page: pd.DataFrame) -> list[tuple[tuple[float, float, float, float], list[list[str]]]]:
    """(box, rows of cells) of a page's ruled tables: rules that touch are one table, words go to the cells they stand in."""
    rules = page[page["kind"] == "rule"][["x0", "y0", "x1", "y1"]].to_numpy(float)
    words = page[page["kind"] == "word"]
    out = []
    left = list(range(len(rules)))
    while left:
        group, more = [left.pop()], True
        while more:
            box = np.array([rules[group, 0].min(), rules[group, 1].min(), rules[group, 2].max(), rules[group, 3].max()])
            near = [i for i in left if rules[i, 0] <= box[2] + NEAR and rules[i, 2] >= box[0] - NEAR and rules[i, 1] <= box[3] + NEAR and rules[i, 3] >= box[1] - NEAR]
            group, left, more = group + near, [i for i in left if i not in set(near)], bool(near)
        mine = rules[group]
        across = mine[:, 2] - mine[:, 0] >= mine[:, 3] - mine[:, 1]
        ys, xs = _merged(mine[across, 1]), _merged(mine[~across, 0])
        if len(ys) < LEAST_ROWS + 1 or len(xs) < 2:
            continue
        x, y = ((words[a] + words[b]) / 2 for a, b in (("x0", "x1"), ("y0", "y1")))
        inner = (x > xs[0]) & (x < xs[-1]) & (y > ys[0]) & (y < ys[-1])
        within = words[inner].assign(r=np.searchsorted(ys, y[inner]) - 1, c=np.searchsorted(xs, x[inner]) - 1)
        rows = [["" for _ in xs[1:]] for _ in ys[1:]]
        for w in within.sort_values(["y0", "x0"]).itertuples():
            rows[w.r][w.c] = f"{rows[w.r][w.c]} {w.text}".strip()
        rows = [r for r in rows if any(r)]
        if len(rows) >= LEAST_ROWS:
            out.append(((xs[0], ys[0], xs[-1], ys[-1]), rows))
    return sorted(out, key=lambda t: (t[0][1], t[0][0]))


def _merged(values: np.ndarray) -> list[float]:
    """Sorted values, those within `NEAR` of the one before as one."""
    out: list[float] = []
    for v in np.sort(values).tolist():
        if not out or v - out[-1] > NEAR:
            out.append(v)
    return out


def tables(items: DataFrame, most: int | None = None) -> DataFrame:
    """(source, type, page, idx, caption, page_text, text, text_rows) of ruled tables of two rows or more.

    They are numbered through their document; the first `most` of each, or all. A page is looked at by one task.
    """

    def run(key, pdf):
        found = _cells(pdf)
        return pd.DataFrame([(key[0], int(key[1]), i, *box, rows) for i, (box, rows) in enumerate(found, 1)], columns=["source", "page", "box", "x0", "y0", "x1", "y1", "text_rows"])

    kind = "source string, page int, box int, x0 double, y0 double, x1 double, y1 double, text_rows array<array<string>>"
    found = items.where("kind in ('rule', 'word')").select("source", "page", "kind", "x0", "y0", "x1", "y1", "text").groupBy("source", "page").applyInPandas(run, kind)
    said = captions.table_captions(found, _blocks(items))
    out = found.select("source", "page", "box", "text_rows").join(said, ["source", "page", "box"])
    out = out.withColumn("idx", F.row_number().over(Window.partitionBy("source").orderBy("page", "box")))
    out = out if most is None else out.where(F.col("idx") <= most)
    out = out.join(_page_text(items), ["source", "page"], "left").withColumn("text", table_text(F.col("text_rows")))
    return out.select("source", F.lit("table").alias("type"), "page", "idx", "caption", "page_text", "text", "text_rows")
