"""Slicing and reducing the daily grid: by time, region and cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NATIONAL = "india"
METRICS = ("mean", "min", "max", "slope")


def between(obs: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Both ends count. Where the table is partitioned by year, whole years are pruned too."""
    if start is None or end is None:
        return obs
    out = obs.where(F.col("obs_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return out.where(F.col("year").between(int(start[:4]), int(end[:4]))) if "year" in obs.columns else out


def in_region(obs: DataFrame, bridge: DataFrame, region: str) -> DataFrame:
    """Observations of the region's cells; a cell on two regions' border counts once for the nation."""
    cells = bridge.select("cell_id").distinct() if region == NATIONAL else bridge.where(F.col("region") == region.lower()).select("cell_id")
    return obs.join(cells, "cell_id", "left_semi")


def in_box(obs: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    return obs.where(F.col("x").between(west, east) & F.col("y").between(south, north))


def reduce(metric: str, value: str = "value") -> Column:
    """mean, min or max of a column."""
    return {"mean": F.avg, "min": F.min, "max": F.max}[metric](value)


def summary(obs: DataFrame, *by: str) -> DataFrame:
    """Flat mean, minimum and maximum over all cells and days, and how many there are."""
    # by day first, with the cells as a set: one distinct count would otherwise copy every row for the other
    days = obs.groupBy(*by, "obs_date").agg(F.sum("value").alias("s"), F.min("value").alias("a"), F.max("value").alias("b"), F.count("value").alias("v"), F.count("*").alias("r"))
    whole = days.groupBy(*by).agg((F.sum("s") / F.sum("v")).alias("mean"), F.min("a").alias("min"), F.max("b").alias("max"), F.sum("v").alias("n_valid"), F.sum("r").alias("n_rows"), F.count("obs_date").alias("n_days"))
    cells = obs.groupBy(*by).agg(F.countDistinct("cell_id").alias("n_cells"))
    return whole.join(cells, list(by)) if by else whole.join(cells)


def missing_share(obs: DataFrame, bridge_cells: DataFrame, start: str, end: str, universe: DataFrame | None = None) -> DataFrame:
    """Share of the expected values that are missing, in percent.

    `missing_pct_region` expects each of the region's cells on each calendar day; `missing_pct_window` also those
    cells of `universe` that lie in the region's bounding window.
    """
    days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    box = bridge_cells.agg(F.count("*").alias("region_cells"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    window = (universe if universe is not None else bridge_cells).join(F.broadcast(box)).where("x between x0 and x1 and y between y0 and y1").agg(F.count("*").alias("window_cells"))  # one row each
    seen = obs.agg(F.count("value").alias("n_valid"))
    pct = lambda c: F.round((1 - F.col("n_valid") / (F.col(c) * days)) * 100, 6)
    return seen.join(box.select("region_cells")).join(window).select("n_valid", days.cast("long").alias("expected_days"), "region_cells", "window_cells", pct("region_cells").alias("missing_pct_region"), pct("window_cells").alias("missing_pct_window"))


def series(obs: DataFrame, *by: str) -> DataFrame:
    """The spatial mean of each day."""
    return obs.groupBy(*by, "obs_date").agg(F.avg("value").alias("value"))


def cell_map(obs: DataFrame, metric: str, *by: str) -> DataFrame:
    """Each cell's mean, minimum or maximum over time."""
    return obs.groupBy(*by, "cell_id", "x", "y").agg(reduce(metric).alias("value"))


def colour_scale(maps: DataFrame, diverging: bool = False) -> DataFrame:
    """Limits that all panels (of several maps in one table, too) share: the extremes, or plus and minus the largest size."""
    low, high = F.min("value"), F.max("value")
    size = F.greatest(F.abs(low), F.abs(high))
    return maps.agg((-size if diverging else low).alias("vmin"), (size if diverging else high).alias("vmax"))


def bounds(obs: DataFrame) -> DataFrame:
    return obs.agg(F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day"))


def coverage(obs: DataFrame, bridge: DataFrame) -> DataFrame:
    """Span, days with data, mean over everything, and the number of regions."""
    whole = obs.agg(F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day"), F.countDistinct("obs_date").alias("n_days"), F.round(F.avg("value"), 6).alias("mean"))
    return whole.join(bridge.agg(F.countDistinct("region").alias("n_regions"))).withColumn("span_days", (F.datediff("last_day", "first_day") + 1).cast("long"))


def all_regions(obs: DataFrame, bridge: DataFrame, metric: str = "mean") -> DataFrame:
    """The metric of every region in one job, smallest first; regions without data are left out."""
    out = obs.join(bridge, "cell_id").groupBy("region").agg(F.round(reduce(metric), 5).alias("value"))
    return out.where("value is not null").orderBy("value", "region")


def ranking(obs: DataFrame, bridge: DataFrame, n: int = 3, *by: str) -> DataFrame:
    """The n driest and the n wettest regions by their mean, of each group; ties go to the earlier name."""
    means = obs.join(bridge, "cell_id").groupBy(*by, "region").agg(F.avg("value").alias("mean")).where("mean is not null")
    if not by:
        low = means.orderBy("mean", "region").limit(n).withColumn("side", F.lit("driest"))
        high = means.orderBy(F.desc("mean"), "region").limit(n).withColumn("side", F.lit("wettest"))
        return low.unionByName(high)
    w = Window.partitionBy(*by)  # a group has a row for each region
    placed = means.withColumn("_low", F.row_number().over(w.orderBy("mean", "region"))).withColumn("_high", F.row_number().over(w.orderBy(F.desc("mean"), "region")))
    sides = F.array_compact(F.array(F.when(F.col("_low") <= n, F.lit("driest")), F.when(F.col("_high") <= n, F.lit("wettest"))))
    return placed.select(*by, "region", "mean", F.explode(sides).alias("side"))


def series_missing(days: DataFrame) -> DataFrame:
    """Days that are present and how many of them have no value, in percent; days that are absent don't count."""
    n = F.count("*")
    lost = F.count_if(F.col("value").isNull())
    return days.agg(n.alias("n_days"), lost.alias("n_missing"), F.round(F.when(n > 0, lost / n * 100), 6).alias("missing_pct"))


def best_year(obs: DataFrame, wettest: bool = True) -> DataFrame:
    """The year with the highest (or lowest) mean, and that mean; ties go to the earlier year."""
    years = obs.groupBy(F.year("obs_date").alias("year")).agg(F.avg("value").alias("mean")).where("mean is not null")
    return years.orderBy(F.desc("mean") if wettest else F.asc("mean"), "year").limit(1)
