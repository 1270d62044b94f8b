"""Linear trends of regions and of cells, both per step.

A region's trend is fitted to its daily means with missing days dropped and the rest numbered on; a cell's to its
own values numbered by their place among all days of the slice, gaps kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloam.functions.stats import p_value_udf
from gridloam.operators.grid import series


def fit(y: str = "value", x: str = "idx") -> list[Column]:
    """n, slope, intercept and r2 of y over x; r2 is 0 for a constant y, where the built-in says 1."""
    return [
        F.count(y).alias("n"),
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.when(F.min(y) == F.max(y), 0.0).otherwise(F.regr_r2(F.col(y), F.col(x))).alias("r2"),
        F.avg(y).alias("mean"),
    ]


def numbered(days: DataFrame, *by: str) -> DataFrame:
    """A daily series without missing days, numbered from 0. There are only as many rows as days."""
    w = Window.partitionBy(*by).orderBy("obs_date") if by else Window.partitionBy(F.lit(0)).orderBy("obs_date")
    return days.where("value is not null").withColumn("idx", F.row_number().over(w) - 1)


def region_trend(obs: DataFrame, *by: str, min_n: int = 2) -> DataFrame:
    """Slope per step, intercept, r2 and p of the daily means; under min_n days the slope is 0, r2 0 and p 1."""
    out = numbered(series(obs, *by), *by).groupBy(*by).agg(*fit(), F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day"))
    few = F.col("n") < min_n
    out = out.select(*by, "n", "first_day", "last_day", F.when(few, 0.0).otherwise(F.col("slope")).alias("slope"), F.when(few, F.col("mean")).otherwise(F.col("intercept")).alias("intercept"), F.when(few, 0.0).otherwise(F.col("r2")).alias("r2"))
    return out


def with_p_value(trends: DataFrame) -> DataFrame:
    return trends.withColumn("p_value", p_value_udf()(F.when(F.col("slope") < 0, -F.sqrt("r2")).otherwise(F.sqrt("r2")), "n"))


def labelled(trends: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """Adds the change over the calendar days from start to end (days, or columns of them), and the direction."""
    first, last = (F.lit(d).cast("date") if isinstance(d, str) else d for d in (start, end))
    days = F.datediff(last, first) + 1
    return trends.withColumn("total_change", F.col("slope") * days).withColumn("direction", F.when(F.col("slope") > 0, "increasing").otherwise("decreasing"))


def trend_line(obs: DataFrame, *by: str) -> DataFrame:
    """Each day's mean and the fitted value."""
    days = numbered(series(obs, *by), *by)
    fits = days.groupBy(*by).agg(*fit()).select(*by, "slope", "intercept")
    # one row without groups; with them both sides are already dealt by the groups
    line = days.join(fits, list(by)) if by else days.join(F.broadcast(fits))
    return line.select(*by, "obs_date", "idx", "value", (F.col("intercept") + F.col("slope") * F.col("idx")).alias("fitted"))


def cell_trend(obs: DataFrame, *by: str, min_n: int = 3) -> DataFrame:
    """Each cell's slope per step of the slice; cells with fewer than min_n values have none."""
    days = obs.select(*by, "obs_date").distinct()
    w = Window.partitionBy(*by).orderBy("obs_date") if by else Window.partitionBy(F.lit(0)).orderBy("obs_date")
    days = days.withColumn("idx", F.row_number().over(w) - 1)
    # a row for each day, some thousands in decades; with groups the planner knows better
    at = obs.join(days, [*by, "obs_date"]) if by else obs.join(F.broadcast(days), "obs_date")
    n = F.count("value")
    return at.groupBy(*by, "cell_id", "x", "y").agg(F.when(n >= min_n, F.regr_slope(F.col("value"), F.col("idx"))).alias("value"), n.alias("n"))
