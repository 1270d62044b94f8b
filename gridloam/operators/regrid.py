"""Bringing one grid onto another's cells: grids of one step, and grids whose axes have steps of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linear(source: DataFrame, target: DataFrame, step: float = 1.0) -> DataFrame:
    """Bilinear values of `source` (x, y, value on multiples of step) at the cells (x, y) of `target`.

    Each target cell is sent to the up to four source cells around it by their indices, an equi-join. A missing
    corner that counts, or a place outside, makes the value NULL.
    """
    fx, fy = F.col("x") / step, F.col("y") / step
    i, j = F.floor(fx), F.floor(fy)
    u, v = fx - i, fy - j
    corner = F.explode(F.array(*[F.struct((i + a).cast("long").alias("i"), (j + b).cast("long").alias("j"), ((u if a else 1 - u) * (v if b else 1 - v)).alias("w")) for a in (0, 1) for b in (0, 1)]))
    asked = target.select("x", "y", corner.alias("c")).where("c.w > 0").select("x", "y", "c.i", "c.j", "c.w")
    at = source.where("value is not null").select(F.round(F.col("x") / step).cast("long").alias("i"), F.round(F.col("y") / step).cast("long").alias("j"), "value")
    got = asked.join(at, ["i", "j"], "left").groupBy("x", "y").agg(F.sum(F.col("w") * F.col("value")).alias("s"), F.count_if(F.col("value").isNull()).alias("lost"))
    return got.select("x", "y", F.when(F.col("lost") == 0, F.col("s")).alias("value"))


def nearest(source: DataFrame, target: DataFrame, step: float = 1.0) -> DataFrame:
    """The value of the source cell that is nearest to each target cell; halves go up."""
    index = lambda c: F.floor(F.col(c) / step + 0.5).cast("long")
    at = source.select(index("x").alias("i"), index("y").alias("j"), "value")
    return target.select("x", "y", index("x").alias("i"), index("y").alias("j")).join(at, ["i", "j"], "left").select("x", "y", "value")


def _beside(source: DataFrame, target: DataFrame, axis: str) -> DataFrame:
    """(target's value, low, high): the values of the source's axis at or under each of the target's, and at or over it.

    Both axes' values are put in one order, and the last and the next of the source's carried over. There is a row for each
    value of the axes, however many cells the grids have.
    """
    own = source.select(F.col(axis).alias("v"), F.col(axis).alias("s")).distinct()
    asked = target.select(F.col(axis).alias("v"), F.lit(None).cast("double").alias("s")).distinct()
    line = Window.partitionBy(F.lit(0)).orderBy("v")
    both = own.unionByName(asked).where("v is not null").groupBy("v").agg(F.max("s").alias("s"))
    low = F.last("s", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("s", ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    return both.select(F.col("v").alias(axis), low.alias(f"{axis}_low"), high.alias(f"{axis}_high"))


def _doubles(grid: DataFrame, *values: str) -> DataFrame:
    return grid.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *values)


def linear_between(source: DataFrame, target: DataFrame) -> DataFrame:
    """Bilinear values of `source` (x, y, value on any axes) at the cells (x, y) of `target`.

    The four cells around a target are those of the axes' neighbouring values. A missing corner that counts, or a place
    outside the axes, makes the value NULL.
    """
    source, target = _doubles(source, "value"), _doubles(target)
    placed = target.join(_beside(source, target, "x"), "x", "left").join(_beside(source, target, "y"), "y", "left")

    def sides(axis: str) -> tuple[Column, Column]:
        low, high = F.col(f"{axis}_low"), F.col(f"{axis}_high")
        up = F.when(high > low, (F.col(axis) - low) / (high - low)).when(high == low, 0.0)
        return up, 1 - up

    (u, u0), (v, v0) = sides("x"), sides("y")
    corners = [F.struct(F.col(f"x_{a}").alias("cx"), F.col(f"y_{b}").alias("cy"), (wa * wb).alias("w")) for a, wa in (("low", u0), ("high", u)) for b, wb in (("low", v0), ("high", v))]
    asked = placed.select("x", "y", F.explode(F.array(*corners)).alias("c")).where("c.w > 0 or c.w is null").select("x", "y", "c.cx", "c.cy", "c.w")
    at = source.where("value is not null").select(F.col("x").alias("cx"), F.col("y").alias("cy"), "value")
    got = asked.join(at, ["cx", "cy"], "left").groupBy("x", "y").agg(F.sum(F.col("w") * F.col("value")).alias("s"), F.count_if(F.col("value").isNull()).alias("lost"))
    return got.select("x", "y", F.when(F.col("lost") == 0, F.col("s")).alias("value"))


def nearest_between(source: DataFrame, target: DataFrame, outside: bool = False) -> DataFrame:
    """The value of the source cell whose axes' values are nearest to each target's; of two as near, the larger.

    Targets outside the axes are NULL, or with `outside` get the outermost cell's value.
    """
    source, target = _doubles(source, "value"), _doubles(target)
    placed = target.join(_beside(source, target, "x"), "x", "left").join(_beside(source, target, "y"), "y", "left")

    def side(axis: str) -> Column:
        low, high = F.col(f"{axis}_low"), F.col(f"{axis}_high")
        inner = F.when(F.col(axis) - low < high - F.col(axis), low).when(low.isNotNull() & high.isNotNull(), high)
        return F.coalesce(inner, low, high) if outside else inner

    at = source.select(F.col("x").alias("cx"), F.col("y").alias("cy"), "value")
    return placed.select("x", "y", side("x").alias("cx"), side("y").alias("cy")).join(at, ["cx", "cy"], "left").select("x", "y", "value")
