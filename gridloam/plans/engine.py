"""Plans as DataFrames. Nothing runs until a result is read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloam.operators import compare, grid, rollup, trend
from gridloam.plans.query import Plan, UnknownRegion, month_bounds, parse, resolve_region, valid_operation
from gridloam.plans.vocabulary import AS_METRIC


@dataclass(frozen=True)
class Result:
    """What a plan gives: figures, a map, a daily series; those that it doesn't have are None."""

    plan: Plan
    scalars: DataFrame | None = None
    cells: DataFrame | None = None
    days: DataFrame | None = None


class Engine:
    """Answers questions about observations (obs_date, cell_id, x, y, value) and a bridge (cell_id, region).

    With stored daily sums (`sums`, refreshed by the caller) figures of regions and days come from these, and only maps and
    the trends' lines from the observations.
    """

    def __init__(self, spark: SparkSession, observations: DataFrame, bridge: DataFrame, regions: list[str] | None = None, sums: rollup.Rollup | None = None):
        self.spark, self.observations, self.bridge, self.sums = spark, observations, bridge, sums
        # names alone, a row for each region
        self.regions = regions or [r["region"] for r in bridge.select("region").distinct().orderBy("region").collect()]
        self._span: tuple[str, str] | None = None

    def span(self) -> tuple[str, str]:
        """First and last day with data; asked once."""
        if self._span is None:
            a, b = grid.bounds(self.sums.days() if self.sums else self.observations).first()
            self._span = (str(a), str(b))
        return self._span

    def ask(self, question: str) -> Result:
        return self.execute(parse(question))

    def batch(self, region: str, ranges: list[tuple[str, str]], operation: str) -> DataFrame:
        """One operation over many spans, a row for each in order; `status` says which have a value, and why not."""
        if not valid_operation(operation) or operation == "comparison":
            raise ValueError(f"no operation {operation!r} over spans")
        ranges = [tuple(sorted((month_bounds(a, True), month_bounds(b, False)))) for a, b in ranges]
        spans = compare.periods(self.spark, ranges)
        metric = AS_METRIC.get(operation, operation)
        try:
            names = [resolve_region(region, self.regions)]
        except UnknownRegion as e:
            none = spans.select(F.lit(region).alias("region"), "*", F.lit(None).cast("double").alias("value"), F.lit(0).cast("long").alias("n"))
            return none.withColumn("status", F.lit(str(e)))
        sliced = grid.between(self.observations, *compare.hull(ranges)) if ranges else self.observations.where("false")
        return compare.regions_by_period(sliced, self.bridge, names, spans, metric).drop("region_idx", "winner")

    def execute(self, plan: Plan, strict: bool = False, whole_if_outside: bool = False) -> Result:
        """A plan's result. `strict` gives no figures if any region or period that is compared has no data."""
        if plan.problem:
            return Result(plan)
        if plan.operation == "coverage":
            return Result(plan, rollup.coverage(self.sums.days()) if self.sums else grid.coverage(self.observations, self.bridge))
        if plan.operation == "best_year":
            wettest = plan.metric == "max"
            return Result(plan, rollup.best_year(self.sums.days(), wettest) if self.sums else grid.best_year(self.observations, wettest))
        plan = plan.bind(*self.span(), whole_if_outside)
        if not plan.spans:
            return Result(plan)
        hull = compare.hull(list(plan.spans))
        spans = compare.periods(self.spark, list(plan.spans))
        if plan.operation in ("driest_region", "wettest_region"):
            within = compare.by_period(grid.between(self.observations, *hull), spans)
            ranked = grid.ranking(within, self.bridge, 3, "period_idx", "period_start", "period_end")
            return Result(plan, ranked.where(F.col("side") == plan.operation.split("_")[0]))
        names = list(dict.fromkeys(resolve_region(r, self.regions) for r in plan.regions))
        if plan.operation == "comparison" or len(names) > 1 or len(plan.spans) > 1:
            metric = plan.metric if plan.operation == "comparison" else AS_METRIC.get(plan.operation, plan.operation)
            sliced = grid.between(self.observations, *hull)
            if plan.operation == "slope":
                fits, lines = compare.trends_by_period(sliced, self.bridge, names, spans)
                if strict:
                    fits = compare.complete(fits)
                within = compare.by_period(sliced.join(compare.places(self.bridge, names), "cell_id"), spans)
                return Result(plan, fits, trend.cell_trend(within, "region", "period_idx") if plan.output != "scalar" else None, lines)
            days = self.sums.days(*hull) if self.sums else None
            scalars = compare.regions_by_period(sliced, self.bridge, names, spans, metric, days)
            if strict:
                scalars = compare.complete(scalars)
            within = compare.by_period(sliced.join(compare.places(self.bridge, names), "cell_id"), spans)
            by = ("region", "period_idx")
            cells = trend.cell_trend(within, *by) if metric == "slope" else grid.cell_map(within, metric, *by)
            return Result(plan, scalars, cells if plan.output != "scalar" else None)
        mine = grid.in_region(self.observations, self.bridge, names[0])
        sliced = grid.between(mine, *plan.spans[0])
        want_map = plan.output != "scalar"
        if plan.operation == "slope":
            fit = trend.with_p_value(trend.labelled(trend.region_trend(sliced), *plan.spans[0]))
            return Result(plan, fit, trend.cell_trend(sliced) if want_map else None, trend.trend_line(sliced))
        metric = AS_METRIC.get(plan.operation, "mean")
        if self.sums:
            days = self.sums.days(*plan.spans[0]).where(F.col("region") == names[0])
            value = {"mean": F.try_divide(F.sum("s"), F.sum("n")), "min": F.min("a"), "max": F.max("b")}[metric]
            scalars = days.agg(value.alias("value"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_valid"), F.count("*").alias("n_days"))
        else:
            scalars = sliced.agg(grid.reduce(metric).alias("value"), F.count("value").alias("n_valid"), F.countDistinct("obs_date").alias("n_days"))
        scalars = scalars.withColumn("status", F.when(F.col("n_valid") == 0, "no data").otherwise("ok"))
        return Result(plan, scalars, grid.cell_map(sliced, metric) if want_map else None)


