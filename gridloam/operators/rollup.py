"""Daily sums of regions, stored: what questions about regions and days are answered from without the cells.

A row is (region, obs_date, s, n, a, b, r): the sum and number of values of the region's cells on a day, the smallest and the
largest, and the rows there were. The nation is a region of its own, with every cell once. Sums of days add up, so means of
any span, series, trends, rankings and comparisons follow; maps don't. Rows lie in partitions by year. A year is made
anew when its observations have changed, which a fingerprint of them tells.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloam.operators.grid import NATIONAL

DAYS = "region string, obs_date date, s double, n long, a double, b double, r long, year int"
PRINTS = "year int, n long, print decimal(38,0), made string"


def daily(obs: DataFrame, bridge: DataFrame) -> DataFrame:
    """(region, obs_date, s, n, a, b, r) of every region and of the nation, by one pass over the observations."""
    # a cell's regions side by side, and the nation once: cells are shuffled once, and summed before the days are
    places = bridge.groupBy("cell_id").agg(F.collect_set("region").alias("regions"))
    at = obs.join(places, "cell_id").withColumn("region", F.explode(F.array_append("regions", F.lit(NATIONAL))))
    value = F.col("value")
    return at.groupBy("region", "obs_date").agg(F.sum(value).alias("s"), F.count(value).alias("n"), F.min(value).alias("a"), F.max(value).alias("b"), F.count("*").alias("r"))


def fingerprints(obs: DataFrame) -> DataFrame:
    """(year, n, print): a number that another set of observations of the year hardly has; their order doesn't matter."""
    one = F.xxhash64("obs_date", "cell_id", "value").cast("decimal(38,0)")
    return obs.groupBy(F.year("obs_date").alias("year")).agg(F.count("*").alias("n"), F.sum(one).alias("print"))


class Rollup:
    """Stored daily sums; readers see a year's last whole state."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/prints/_SUCCESS")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _prints(self) -> DataFrame:
        """(year, n, print, made): the last state of each year; `made` sorts by time."""
        if not self._exists():
            return self.spark.createDataFrame([], PRINTS)
        every = self.spark.read.schema(PRINTS).parquet(f"{self.path}/prints")
        return every.groupBy("year").agg(F.max_by(F.struct("n", "print", "made"), "made").alias("l")).select("year", "l.*")

    def refresh(self, obs: DataFrame, bridge: DataFrame) -> list[int]:
        """Makes the years whose observations have changed; which they were. A year without observations any more is emptied."""
        now = fingerprints(obs)
        before = self._prints().select("year", F.col("n").alias("n0"), F.col("print").alias("p0"))
        both = now.join(before, "year", "full").where("n is null or n0 is null or n <> n0 or print <> p0")
        changed = [tuple(r) for r in both.select("year", F.coalesce("n", F.lit(0)), F.coalesce("print", F.lit(0)).cast("decimal(38,0)")).collect() if r[0] is not None]  # a row for each year
        changed = [c for c in changed if c[1] or self._exists()]
        if not changed:
            return []
        stamp = self.spark.range(1).select(F.format_string("%020d-%s", F.unix_micros(F.current_timestamp()), F.lit(uuid.uuid4().hex))).first()[0]
        years = [c[0] for c in changed]
        mine = obs.where(F.year("obs_date").isin(years))
        if "year" in obs.columns:
            mine = mine.where(F.col("year").isin(years))
        made = daily(mine.select("obs_date", "cell_id", "value"), bridge).withColumn("year", F.year("obs_date")).withColumn("made", F.lit(stamp))
        made.repartition("year", F.pmod(F.xxhash64("region"), F.lit(8))).sortWithinPartitions("region", "obs_date").write.mode("append").partitionBy("year", "made").parquet(f"{self.path}/days")
        self.spark.createDataFrame([(*c, stamp) for c in changed], PRINTS).coalesce(1).write.mode("append").parquet(f"{self.path}/prints")
        return sorted(years)

    def days(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """The daily sums of a span; other years' partitions aren't read."""
        if not self._exists():
            return self.spark.createDataFrame([], DAYS)
        states = F.broadcast(self._prints().where("n > 0").select("year", "made"))  # a row for each year
        out = self.spark.read.schema(f"{DAYS}, made string").parquet(f"{self.path}/days")
        if start is not None and end is not None:
            out = out.where(F.col("year").between(int(start[:4]), int(end[:4])) & F.col("obs_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        return out.join(states, ["year", "made"], "left_semi").drop("made")


def metric_of(days: DataFrame, metric: str, *by: str) -> DataFrame:
    """(by, value, n) of daily sums: as `compare.metric_of` gives of the observations."""
    if metric == "slope":
        from gridloam.operators.trend import numbered

        series = days.where("n > 0").select(*by, "obs_date", (F.col("s") / F.col("n")).alias("value"))
        return numbered(series, *by).groupBy(*by).agg(F.when(F.count("value") >= 3, F.regr_slope(F.col("value"), F.col("idx"))).alias("value"), F.count("value").alias("n"))
    value = {"mean": F.try_divide(F.sum("s"), F.sum("n")), "min": F.min("a"), "max": F.max("b")}[metric]
    return days.groupBy(*by).agg(value.alias("value"), F.sum("n").alias("n"))


def best_year(days: DataFrame, wettest: bool = True) -> DataFrame:
    """The nation's year with the highest (or lowest) mean; ties go to the earlier year."""
    years = metric_of(days.where(F.col("region") == NATIONAL).withColumn("year", F.year("obs_date")), "mean", "year").where("value is not null")
    return years.orderBy(F.desc("value") if wettest else F.asc("value"), "year").limit(1).select("year", F.col("value").alias("mean"))


def ranking(days: DataFrame, n: int = 3) -> DataFrame:
    """The n driest and the n wettest regions by their mean; ties go to the earlier name."""
    means = metric_of(days.where(F.col("region") != NATIONAL), "mean", "region").where("value is not null").select("region", F.col("value").alias("mean"))
    low = means.orderBy("mean", "region").limit(n).withColumn("side", F.lit("driest"))
    return low.unionByName(means.orderBy(F.desc("mean"), "region").limit(n).withColumn("side", F.lit("wettest")))


def coverage(days: DataFrame) -> DataFrame:
    """Span, days with data, mean over the nation's cells, and the number of regions."""
    nation = days.where(F.col("region") == NATIONAL)
    whole = nation.agg(F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day"), F.count("*").alias("n_days"), F.round(F.try_divide(F.sum("s"), F.sum("n")), 6).alias("mean"))
    regions = days.where(F.col("region") != NATIONAL).agg(F.countDistinct("region").alias("n_regions"))
    return whole.join(regions).withColumn("span_days", (F.datediff("last_day", "first_day") + 1).cast("long"))
