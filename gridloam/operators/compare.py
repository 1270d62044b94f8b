"""Comparing periods and regions by mean, min, max or slope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloam.operators import rollup
from gridloam.operators.grid import NATIONAL, reduce, series
from gridloam.operators.trend import labelled, numbered, region_trend, trend_line, with_p_value


def periods(spark: SparkSession, spans: list[tuple[str, str]]) -> DataFrame:
    """(period_idx, period_start, period_end) of a query's periods, which may overlap."""
    rows = [(i, a, b) for i, (a, b) in enumerate(spans)]
    return spark.createDataFrame(rows, "period_idx int, a string, b string").select("period_idx", F.to_date("a").alias("period_start"), F.to_date("b").alias("period_end"))


def hull(spans: list[tuple[str, str]]) -> tuple[str, str]:
    """The least span that holds all: slicing by it first lets the scan leave out the rest."""
    return min(a for a, _ in spans), max(b for _, b in spans)


def by_period(obs: DataFrame, spans: DataFrame) -> DataFrame:
    """Observations with the periods that they fall in; the periods are a query's own few rows."""
    return obs.join(F.broadcast(spans), F.col("obs_date").between(F.col("period_start"), F.col("period_end")))


def metric_of(obs: DataFrame, metric: str, *by: str) -> DataFrame:
    """(by, value, n): slope is that of the daily means, from three days on."""
    if metric == "slope":
        days = numbered(series(obs, *by), *by)
        return days.groupBy(*by).agg(F.when(F.count("value") >= 3, F.regr_slope(F.col("value"), F.col("idx"))).alias("value"), F.count("value").alias("n"))
    return obs.groupBy(*by).agg(reduce(metric).alias("value"), F.count("value").alias("n"))


def with_winner(values: DataFrame, metric: str, order: str, *by: str) -> DataFrame:
    """Flags the winner: the least for min, the greatest for mean and max, the steepest for slope; the first of equals."""
    key = {"min": -F.col("value"), "slope": F.abs("value")}.get(metric, F.col("value"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return values.withColumn("winner", (F.row_number().over(w.orderBy(key.desc_nulls_last(), order)) == 1) & F.col("value").isNotNull())


def compare_periods(obs: DataFrame, spans: DataFrame, metric: str) -> DataFrame:
    """A row for each period, with or without data, and which one wins."""
    got = metric_of(by_period(obs, spans), metric, "period_idx")
    every = spans.join(got, "period_idx", "left").select("period_idx", "period_start", "period_end", "value", F.coalesce("n", F.lit(0)).alias("n"))
    return with_winner(every, metric, "period_idx")


def complete(compared: DataFrame) -> DataFrame:
    """No row if any period is empty, as the strict form of the comparison has it."""
    return compared.withColumn("_least", F.min("n").over(Window.partitionBy(F.lit(0)))).where("_least > 0").drop("_least")


def places(bridge: DataFrame, regions: list[str]) -> DataFrame:
    """(cell_id, region) of the regions asked for; the nation is every cell, once."""
    named = bridge.where(F.col("region").isin([r for r in regions if r != NATIONAL])).select("cell_id", "region")
    if NATIONAL in regions:
        named = named.unionByName(bridge.select("cell_id").distinct().withColumn("region", F.lit(NATIONAL)))
    return named


def asked_for(bridge: DataFrame, regions: list[str]) -> DataFrame:
    """(region_idx, region) of a query's own few regions, in the order they are given."""
    rows = [(i, r) for i, r in enumerate(dict.fromkeys(regions))]
    return bridge.sparkSession.createDataFrame(rows, "region_idx int, region string")


def compare_regions(obs: DataFrame, bridge: DataFrame, regions: list[str], metric: str) -> DataFrame:
    """A row for each of the regions, with or without data, of one scan, in the order they are given, and which wins."""
    got = metric_of(obs.join(places(bridge, regions), "cell_id"), metric, "region")
    every = asked_for(bridge, regions).join(got, "region", "left").select("region", "value", F.coalesce("n", F.lit(0)).alias("n"), "region_idx")
    return with_winner(every, metric, "region_idx")


def trends_by_period(obs: DataFrame, bridge: DataFrame, regions: list[str], spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fits, lines) of each region and period, of one scan.

    Fits have a row for each, with or without data: slope, intercept, r2, p, change over the period's calendar days, direction.
    Lines have each day's mean and its fitted value.
    """
    by = ("region", "period_idx")
    within = by_period(obs.join(places(bridge, regions), "cell_id"), spans)
    every = asked_for(bridge, regions).join(F.broadcast(spans))  # a query's own few rows on both sides
    got = with_p_value(region_trend(within, *by))
    out = labelled(every.join(got, list(by), "left"), F.col("period_start"), F.col("period_end"))
    none = F.col("slope").isNull()
    out = out.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("status", F.when(none, "no data").otherwise("ok"))
    return out.withColumn("direction", F.when(~none, F.col("direction"))), trend_line(within, *by)


def regions_by_period(obs: DataFrame, bridge: DataFrame, regions: list[str], spans: DataFrame, metric: str, days: DataFrame | None = None) -> DataFrame:
    """A row for each region and period, with or without data, of one scan: of the observations, or of daily sums if given.

    `status` says whether there is a value. `winner` is the best region of each period, or the best period if there is
    one region.
    """
    if days is None:
        got = metric_of(by_period(obs.join(places(bridge, regions), "cell_id"), spans), metric, "region", "period_idx")
    else:
        got = rollup.metric_of(by_period(days.where(F.col("region").isin(regions)), spans), metric, "region", "period_idx")
    every = asked_for(bridge, regions).join(F.broadcast(spans))  # a query's own few rows on both sides
    out = every.join(got, ["region", "period_idx"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.withColumn("status", F.when(F.col("value").isNull(), "no data").otherwise("ok"))
    won = with_winner(out, metric, "region_idx", "period_idx") if len(set(regions)) > 1 else with_winner(out, metric, "period_idx")
    return won.select("region_idx", "region", "period_idx", "period_start", "period_end", "value", "n", "status", "winner")
