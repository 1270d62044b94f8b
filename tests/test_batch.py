import time

from pyspark.sql import functions as F

from gridloam.plans import batch
from gridloam.plans.query import parse


def test_different_questions_are_parsed_once(spark):
    """One task's file of 300,000 rows with three texts; parsing each row takes minutes."""
    said = ["mean moisture in rajsthan in 2020", "compare kerala and goa in 2021", None]
    asked = spark.range(0, 300_000, 1, 1).select("id", F.element_at(F.array(*[F.lit(q) for q in said]), (F.col("id") % 3).cast("int") + 1).alias("text"))
    start = time.monotonic()
    got = batch.plans(asked).groupBy(F.col("id") % 3, "operation", "regions", "spans", "problem").count().collect()
    assert time.monotonic() - start < 45
    assert {r[0]: tuple(r)[1:] for r in got} == {i: (p.operation, ",".join(p.regions), ";".join(f"{a}..{b}" for a, b in p.spans), p.problem, 100_000) for i, p in enumerate(parse(q or "") for q in said)}
