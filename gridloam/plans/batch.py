"""Questions of a table: plans, routes and names of regions, without a loop on the driver."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloam.plans import intent
from gridloam.plans import vocabulary as V
from gridloam.plans.query import parse

#: Tasks for each core that different texts are dealt to.
TASKS_A_CORE = 4


def _different(questions: DataFrame, text: str) -> DataFrame:
    """(text): each different text once, dealt evenly over all cores; a small file is read by one task."""
    cores = questions.sparkSession.sparkContext.defaultParallelism
    return questions.select(F.coalesce(F.col(text), F.lit("")).alias(text)).distinct().repartition(cores * TASKS_A_CORE, text)


def plans(questions: DataFrame, key: str = "id", text: str = "text", evaluation: bool = False) -> DataFrame:
    """(key, operation, compare_by, metric, output, regions, spans, problem) of each question; a null text is too short.

    Different texts are parsed once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [parse(q, evaluation) for q in pdf[text]]
            rows = [(p.operation, p.compare_by, p.metric, p.output, ",".join(p.regions), ";".join(f"{a}..{b}" for a, b in p.spans), p.problem) for p in got]
            out = pd.DataFrame(rows, columns=["operation", "compare_by", "metric", "output", "regions", "spans", "problem"])
            yield out.assign(**{text: pdf[text].to_numpy()})[[text, *out.columns]]

    parsed = _different(questions, text).mapInPandas(run, f"`{text}` string, operation string, compare_by string, metric string, output string, regions string, spans string, problem string")
    asked = questions.select(key, F.coalesce(F.col(text), F.lit("")).alias(text))
    return asked.join(parsed, text).select(key, *[c for c in parsed.columns if c != text])


def routes(questions: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, text, route, off_topic, sensor) of each question; the route is NULL where words alone don't settle it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = [q or "" for q in pdf[text]]
            yield pd.DataFrame({key: pdf[key].to_numpy(), text: said, "route": [intent.fast(q) for q in said], "off_topic": [intent.off_topic(q) for q in said], "sensor": [intent.about_sensor(q) for q in said]})

    kind = questions.schema[key].dataType.simpleString()
    return questions.select(key, text).mapInPandas(run, f"`{key}` {kind}, `{text}` string, route string, off_topic boolean, sensor boolean")


def _letters(name: Column) -> Column:
    """The letters of a name, each with how many of it came so far, so that no two are alike."""
    letters = F.split(name, "")
    return F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i + 1), lambda d: d == c)).cast("string")))


def resolved(names: DataFrame, known: list[str], key: str = "id", name: str = "name", cutoff: float = 0.6) -> DataFrame:
    """(key, name, region): the known region that each name means, by alias or likeness, or NULL; equal to `resolve_region`.

    Different names are looked up once. A name meets the regions that have letters of its own by a join on the letters, and
    the letters that they share, which no likeness can go beyond, say which pairs are compared in order.
    """
    spark = names.sparkSession
    aliases = spark.createDataFrame(sorted(V.ALIASES.items()), "said string, alias string")
    regions = spark.createDataFrame([(r,) for r in dict.fromkeys(known) if r], "region string")
    said = F.lower(F.trim(F.col(name)))
    asked = names.select(said.alias("said")).where("said <> ''").distinct()
    meant = asked.join(F.broadcast(aliases), "said", "left").select("said", F.coalesce("alias", "said").alias("meant"))
    letters = meant.select("said", "meant", F.explode(_letters(F.col("meant"))).alias("letter"))
    index = regions.select("region", F.explode(_letters(F.col("region"))).alias("letter"))
    shared = letters.join(index, "letter").groupBy("said", "meant", "region").agg(F.count("*").alias("n"))
    near = shared.where(2 * F.col("n") >= cutoff * (F.length("meant") + F.length("region"))).select("said", "meant", "region")

    def like(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ratio = [difflib.SequenceMatcher(None, r, m).ratio() for r, m in zip(pdf["region"], pdf["meant"], strict=True)]
            out = pdf.assign(ratio=ratio)
            yield out[out["ratio"] >= cutoff][["said", "region", "ratio"]]

    scored = near.mapInPandas(like, "said string, region string, ratio double")
    best = scored.groupBy("said").agg(F.max(F.struct("ratio", "region"))["region"].alias("region"))
    found = meant.join(best, "said", "left").select("said", F.when(F.col("meant") == V.NATIONAL, F.lit(V.NATIONAL)).otherwise(F.col("region")).alias("region"))
    return names.withColumn("said", said).join(found, "said", "left").select(key, name, "region")
