"""Calendar buckets: resampled series, and year by month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = {"day": "interval 1 day", "week": "interval 7 day", "month": "interval 1 month", "quarter": "interval 3 month", "year": "interval 1 year"}


def bucket_start(day: Column, grain: str) -> Column:
    """First day of the bucket; weeks begin on Monday."""
    return day if grain == "day" else F.to_date(F.date_trunc(grain, day))


def bucket_label(first: Column, grain: str) -> Column:
    """Last day of the bucket: Sunday, or the end of the month, quarter or year."""
    if grain == "day":
        return first
    if grain == "week":
        return F.date_add(first, 6)
    return F.last_day(F.add_months(first, {"month": 0, "quarter": 2, "year": 11}[grain]))


def resample(days: DataFrame, grain: str, by: str = "region") -> DataFrame:
    """The mean of each series' daily values in each bucket from its first to its last; empty buckets are NULL."""
    got = days.groupBy(by, bucket_start(F.col("obs_date"), grain).alias("first")).agg(F.avg("value").alias("value"))
    spine = got.groupBy(by).agg(F.min("first").alias("a"), F.max("first").alias("b")).select(by, F.explode(F.sequence("a", "b", F.expr(STEPS[grain]))).alias("first"))
    return spine.join(got, [by, "first"], "left").select(by, bucket_label(F.col("first"), grain).alias("bucket"), "value")


def year_month(days: DataFrame, metric: str = "mean") -> DataFrame:
    """(year, month, value) of the daily means: mean, min or max."""
    f = {"mean": F.avg, "min": F.min, "max": F.max}[metric]
    return days.groupBy(F.year("obs_date").alias("year"), F.month("obs_date").alias("month")).agg(f("value").alias("value"))


def heatmap(days: DataFrame, metric: str = "mean") -> DataFrame:
    """A row for each year and a column for each month, m1 to m12."""
    out = year_month(days, metric).groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("value"))
    return out.select("year", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])
