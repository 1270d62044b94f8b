"""Verdicts on computed against expected values, and their roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("bias", "rmse", "ubrmse", "mae", "r")
PASS_LIMIT, WARN_R, WARN_MAX = 1e-5, 0.9999, 1e-4


def verdict(metrics: DataFrame) -> DataFrame:
    """PASS if bias, rmse, ubrmse and mae are all small; else WARN if r is nearly 1 and no error is large; else FAIL; SKIP without data."""
    c = F.col
    small = (F.abs("bias") < PASS_LIMIT) & (c("rmse") < PASS_LIMIT) & (c("ubrmse") < PASS_LIMIT) & (c("mae") < PASS_LIMIT)
    near = (c("r") > WARN_R) & (c("max_abs") < WARN_MAX)
    return metrics.withColumn("result", F.when(c("n").isNull() | (c("n") == 0), "SKIP").when(small, "PASS").when(F.coalesce(near, F.lit(False)), "WARN").otherwise("FAIL"))


def roll_up(results: DataFrame, by: str = "op") -> DataFrame:
    """Cases and verdicts for each operation and, with a NULL operation, for all; with each metric's mean, spread and limits.

    A metric that a case lacks (r of a single value, say) is left out of its statistics.
    """
    n = lambda v: F.count_if(F.col("result") == v).alias(v.lower())
    spread = [f(F.col(m)).alias(f"{m}_{name}") for m in METRICS for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max), ("min", F.min))]
    return results.rollup(by).agg(F.count("*").alias("cases"), n("PASS"), n("WARN"), n("FAIL"), n("SKIP"), *spread)


def accuracy(intents: DataFrame) -> DataFrame:
    """(expected, cases, accuracy) of routed questions."""
    return intents.groupBy("expected").agg(F.count("*").alias("cases"), F.avg((F.col("expected") == F.col("got")).cast("double")).alias("accuracy"))


def assessment(rolled: DataFrame) -> DataFrame:
    """Rolled-up results with a word for how well the computed values match: EXCELLENT, GOOD or POOR, NULL without r."""
    r, rmse = F.col("r_mean"), F.col("rmse_mean")
    word = F.when((r > WARN_R) & (rmse < WARN_MAX), "EXCELLENT").when(r > 0.95, "GOOD").when(r.isNotNull() & rmse.isNotNull(), "POOR")
    return rolled.withColumn("assessment", word)
