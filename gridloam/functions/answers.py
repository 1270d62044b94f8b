"""Answers as text: labels, units, badges and boxes, as column expressions on the engine's figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNIFICANT = 0.05
#: Units of a metric, and what its winner is called.
UNITS = {"mean": "m³/m³", "min": "m³/m³", "max": "m³/m³", "slope": "m³/m³/day"}
BADGES = {"min": "DRIEST", "max": "HIGHEST PEAK", "slope": "STRONGER TREND", "mean": "HIGHEST MEAN"}


def unit(metric: str) -> str:
    return UNITS.get(metric, UNITS["mean"])


def direction(slope: Column) -> Column:
    return F.when(slope > 0, "INCREASING (Wetter)").otherwise("DECREASING (Drier)")


def significance(p: Column) -> Column:
    return F.when(p < SIGNIFICANT, "SIGNIFICANT").otherwise("NOT SIGNIFICANT")


def boxed(title: str, *lines: Column) -> Column:
    """A title and lines, one below the other, between rules."""
    rule = F.lit("-" * 60)
    return F.concat_ws("\n", rule, F.lit(title), rule, *lines, rule)


def trend_answer(region: Column, start: str, end: str) -> Column:
    """The answer to a question about a trend, from slope, total_change, r2, p_value and n."""
    c = F.col
    return boxed(
        "TREND",
        F.concat(F.lit("Region: "), region),
        F.lit(f"Period: {start} to {end}"),
        F.concat(F.lit("Direction: "), direction(c("slope"))),
        F.concat(F.lit("Slope: "), F.format_string("%+.8f", c("slope")), F.lit(f" {UNITS['slope']}")),
        F.concat(F.lit("Total change: "), F.format_string("%+.6f", c("total_change"))),
        F.concat(F.lit("R2: "), F.format_string("%.4f", c("r2")), F.lit(", p: "), F.format_string("%.4f", c("p_value")), F.lit(" - "), significance(c("p_value"))),
        F.concat(F.lit("Days: "), c("n").cast("string")),
    )


def value_answer(title: str, metric: str, label: Column, value: Column, n: Column) -> Column:
    """The answer to a question about one figure; without data it says so."""
    said = F.when(value.isNull(), F.lit("no data")).otherwise(F.concat(F.format_string("%.6f", value), F.lit(f" {unit(metric)}")))
    return boxed(title, label, F.concat(F.lit(f"{metric}: "), said), F.concat(F.lit("values: "), n.cast("string")))


def badge(metric: str, winner: Column) -> Column:
    return F.when(winner, BADGES.get(metric, BADGES["mean"])).otherwise("")


def summary(metric: str, label: Column, value: Column) -> Column:
    """One sentence on the winner of a comparison."""
    plain = F.format_string("%.6f", value)
    said = {
        "min": F.concat(label, F.lit(" is DRIEST (lowest minimum: "), plain, F.lit(f" {unit('min')})")),
        "max": F.concat(label, F.lit(" has the WETTEST PEAK (max: "), plain, F.lit(f" {unit('max')})")),
        "slope": F.concat(label, F.lit(" has STRONGER TREND (slope: "), F.format_string("%+.8f", value), F.when(value > 0, ", getting WETTER)").otherwise(", getting DRIER)")),
    }
    return said.get(metric, F.concat(label, F.lit(" is WETTEST ON AVERAGE (mean: "), plain, F.lit(f" {unit('mean')})")))


def comparison_answer(compared: DataFrame, metric: str, label: Column) -> DataFrame:
    """One row: a line for each thing compared, in order, and the sentence on the winner. As many rows as were asked for."""
    value = F.when(F.col("value").isNull(), F.lit("no data")).otherwise(F.concat(F.format_string("%+.8f" if metric == "slope" else "%.6f", F.col("value")), F.lit(f" {unit(metric)}")))
    line = F.concat_ws(" ", F.concat(label, F.lit(":")), value, F.when(F.col("winner"), badge(metric, F.col("winner"))))
    order = [c for c in ("region_idx", "period_idx") if c in compared.columns]
    got = compared.agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("ls"), F.max(F.when(F.col("winner"), summary(metric, label, F.col("value")))).alias("best"))
    return got.select(F.concat_ws("\n", F.array_join(F.transform("ls", lambda r: r["line"]), "\n"), "best").alias("answer"))
