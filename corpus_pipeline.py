"""The corpus pipeline: quality, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns the columns of documents; the
last returns the packed pieces. Documents without an id are treated like any other; a repeated row counts as a copy of
itself, so one stays. Empty and null texts are rejected as of no language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloam.llm import langid, neardup, packing
from gridloam.llm import quality as quality_model
from gridloam.llm.common import fold, stored

LEAST_QUALITY = 0.7
#: Ids that are sent to every executor at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.7; the model learns from three quarters of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = quality_model.scorer(spark, quality_model.train(docs, labels, fold("doc_id", 4) != 2))
    name = _spare(docs, "score")
    return docs.withColumn(name, score(F.col("text"))).where(F.col(name) >= LEAST_QUALITY).drop(name)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that three quarters of the documents' tags teach."""
    found = langid.predictor(spark, langid.train(docs.where(fold("doc_id", 4) != 2), "doc_id", "text", "lang"))
    name = _spare(docs, "found")
    return docs.withColumn(name, found(F.col("text").cast("string"))).where(F.col(name)["lang_pred"] != langid.UNKNOWN).drop(name)


def _spare(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest id; rows without an id come after the others."""
    # stored, so that a row keeps its key; an id may be missing or have two texts
    row = _spare(docs, "row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    classes = stored(neardup.classes(rows, row), "classes").join(rows.select(row, "doc_id"), row)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("first")))
    best = classes.groupBy("class_id").agg(first["first"].alias("first"), F.count("*").alias("n")).where("n > 1")
    best = stored(best.select("class_id", "first"), "firsts")
    gone = stored(classes.join(best, "class_id").where(F.col(row) != F.col("first")).select(row), "gone")
    rows = rows.join(_few(gone), row, "left_anti")
    kept = rows.drop(row)
    twice = rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    few = _few(twice)
    return kept.join(few, "doc_id", "left_anti").unionByName(kept.join(few, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 4096 tokens."""
    return packing.pack_digests(docs, "doc_id").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("language", language), ("dedup", dedup), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
