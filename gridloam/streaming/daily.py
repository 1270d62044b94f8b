"""The daily aggregate over a stream of readings, with late data up to two days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_means(readings: DataFrame, key: str = "cell_id", late: str = "2 days") -> DataFrame:
    """(day, key, value, n) of readings (ts, key, value); a day is final once the watermark has passed it."""
    day = readings.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), key)
    return day.agg(F.avg("value").alias("value"), F.count("value").alias("n")).select(F.to_date("window.start").alias("day"), key, "value", "n")
