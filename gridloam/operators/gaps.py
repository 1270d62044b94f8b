"""Which days of a span have no data, and in what runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def missing_days(spark: SparkSession, obs: DataFrame, start: str, end: str) -> DataFrame:
    """(missing_day) of the calendar from start to end."""
    calendar = spark.sql(f"select explode(sequence(date'{start}', date'{end}', interval 1 day)) as missing_day")
    return calendar.join(obs.where("value is not null").select(F.col("obs_date").alias("missing_day")).distinct(), "missing_day", "left_anti")


def runs(days: DataFrame) -> DataFrame:
    """(run_start, run_end, n_days) of consecutive days; there is a row for each calendar day at most."""
    w = Window.partitionBy(F.lit(0)).orderBy("missing_day")
    island = days.withColumn("island", F.date_sub("missing_day", F.row_number().over(w)))
    return island.groupBy("island").agg(F.min("missing_day").alias("run_start"), F.max("missing_day").alias("run_end"), F.count("*").alias("n_days")).drop("island")


def described(gone: DataFrame, most: int = 5) -> DataFrame:
    """One row: the first runs of missing days as text, and how many more there are."""
    one = F.when(F.col("run_start") == F.col("run_end"), F.col("run_start").cast("string")).otherwise(F.concat_ws(" to ", F.col("run_start").cast("string"), F.col("run_end").cast("string")))
    all_ = F.array_sort(F.collect_list(F.struct("run_start", one.alias("t"))))  # a run for every two days at most
    text = F.array_join(F.transform(F.slice(all_, 1, most), lambda r: r["t"]), ", ")
    return gone.agg(F.when(F.count("*") > most, F.concat(text, F.lit(" + "), (F.count("*") - most).cast("string"), F.lit(" more"))).otherwise(text).alias("periods"))


def report(spark: SparkSession, obs: DataFrame, start: str, end: str) -> DataFrame:
    """One row: days expected, missing and available, percent missing, the first ten missing, and the extent of the data."""
    days = missing_days(spark, obs, start, end)
    expected = F.lit((spark.sql(f"select datediff(date'{end}', date'{start}') + 1").first()[0])).cast("long")
    lost = days.agg(F.count("*").alias("total_missing"), F.array_join(F.slice(F.array_sort(F.collect_list(F.date_format("missing_day", "yyyy-MM-dd"))), 1, 10), ",").alias("first_missing"))
    have = obs.where("value is not null").agg(F.countDistinct("obs_date").alias("total_available"), F.min("obs_date").alias("first_available"), F.max("obs_date").alias("last_available"))
    return lost.join(have).select(expected.alias("total_expected"), "total_missing", "total_available", F.round(F.col("total_missing") / expected * 100, 6).alias("missing_pct"), "first_missing", "first_available", "last_available", (F.col("total_missing") / expected > 0.25).alias("flagged"))
