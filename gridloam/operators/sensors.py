"""A second sensor beside the grid: quality mask, region series, period grids, agreement."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloam.functions.stats import p_value_udf
from gridloam.operators.grid import between, in_box
from gridloam.operators.regrid import nearest
from gridloam.plans.vocabulary import BANDS, BOXES

#: Days between first and last that a question to the sensor may span.
MAX_DAYS = 3650


def guard(region: str, band: str, start: str, end: str) -> str | None:
    """What is wrong with a question to the sensor: an unknown region or band, days that are none, or too many."""
    if region not in BOXES:
        return f"unknown region {region!r}"
    if band not in BANDS:
        return f"unknown band {band!r}"
    try:
        a, b = date.fromisoformat(start), date.fromisoformat(end)
    except ValueError:
        return "not a date"
    if a > b:
        return "the first day is after the last"
    return "more than ten years" if (b - a).days > MAX_DAYS else None


def guarded(obs: DataFrame, region: str, band: str, start: str, end: str) -> DataFrame:
    """Observations of a region's box and a span, once `guard` has nothing to say."""
    if problem := guard(region, band, start, end):
        raise ValueError(problem)
    return between(in_box(obs, *BOXES[region]), start, end).select("obs_date", "x", "y", band)


def cell_edges(grid: DataFrame, axis: str = "x") -> DataFrame:
    """(centre, low, high): cells' edges half way between neighbouring centres; the outer ones as far as the inner."""
    w = Window.partitionBy(F.lit(0)).orderBy(axis)  # a row for each column or row of the grid
    c = grid.select(axis).distinct().withColumn("_to", F.lead(axis).over(w) - F.col(axis)).withColumn("_from", F.col(axis) - F.lag(axis).over(w))
    down, up = F.coalesce("_from", "_to") / 2, F.coalesce("_to", "_from") / 2
    return c.select(F.col(axis).alias("centre"), (F.col(axis) - down).alias("low"), (F.col(axis) + up).alias("high"))


def valid(v: Column) -> Column:
    """Values of 0 or less, or over 1000, are no measurement."""
    return F.when((v > 0) & (v <= 1000), v)


def band_series(obs: DataFrame, *bands: str, places: int | None = 6) -> DataFrame:
    """Each day's mean of each band, to six places, in order; one band or several."""
    # from twelve places, so that the last bits of a sum don't decide
    mean = lambda b: F.avg(b) if places is None else F.round(F.avg(b).cast("decimal(38,12)"), places).cast("double")
    return obs.groupBy("obs_date").agg(*[mean(b).alias(b) for b in bands]).where(F.coalesce(*[F.col(b) for b in bands]).isNotNull()).orderBy("obs_date")


def period_grid(obs: DataFrame, band: str) -> DataFrame:
    """Each cell's mean over the period, masked."""
    return obs.groupBy("x", "y").agg(F.avg(band).alias("value")).withColumn("value", valid(F.col("value")))


def grid_summary(obs: DataFrame, band: str) -> DataFrame:
    """One row: days with an image, and mean, minimum and maximum of the period grid."""
    grid = period_grid(obs, band).agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n_cells"))
    return grid.join(obs.where(F.col(band).isNotNull()).agg(F.countDistinct("obs_date").alias("n_images")))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y, a, b) of cells that either grid has."""
    return a.select("x", "y", F.col("value").alias("a")).join(b.select("x", "y", F.col("value").alias("b")), ["x", "y"], "full")


def bias_grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y, value): a - b where both have a value, else NULL."""
    return paired(a, b).select("x", "y", (F.col("a") - F.col("b")).alias("value"))


def agreement(pairs: DataFrame, *by: str, least: int = 3, with_p: bool = False) -> DataFrame:
    """How well b follows a, over rows that have both: n, bias, rmse, unbiased rmse, mae, largest error, r and r2, and p if asked.

    Under `least` rows all but n are NULL, as is r where either side is constant.
    """
    d = F.col("a") - F.col("b")
    both = pairs.where("a is not null and b is not null")
    out = both.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(d).alias("bias"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.sqrt(F.greatest(F.var_pop(d), F.lit(0.0))).alias("ubrmse"),
        F.avg(F.abs(d)).alias("mae"),
        F.max(F.abs(d)).alias("max_abs"),
        F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")).alias("r"),
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
    )
    enough = F.col("n") >= least
    places = {"r": 4}
    return out.withColumn("r2", F.col("r") * F.col("r")).select(*by, "n", *[F.when(enough, F.round(c, places.get(c, 6))).alias(c) for c in ("bias", "rmse", "ubrmse", "mae", "max_abs", "r", "mean_a", "mean_b")], F.when(enough, F.round("r2", 4)).alias("r2"), *([F.when(enough & F.col("r").isNotNull(), F.round(p_value_udf()("r", "n"), 6)).alias("p_value")] if with_p else []))


def percentile(grid: DataFrame, q: float, of: Column | None = None, accuracy: int | None = None) -> DataFrame:
    """The percentile, interpolated, of the grid's values: exact, or with `accuracy` by a bounded sketch."""
    value = F.col("value") if of is None else of
    return grid.agg((F.percentile(value, F.lit(q)) if accuracy is None else F.percentile_approx(value, q, accuracy)).alias("value"))


def map_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """How well map b follows map a (x, y, value): each of a's cells against b's nearest, over the window both share."""
    return agreement(paired(a, nearest(b, a.select("x", "y"))))
