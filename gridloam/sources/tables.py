"""The engine's inputs, made from business tables: observations, regions, a second sensor, documents.

An observation is (obs_date, cell_id, x, y, value), one for each cell and day, missing values as NULL. `cell_region`
says in which regions a cell's centre lies. Both are ordinary tables; a deployment keeps observations as Parquet,
partitioned by year, and the bridge beside it (`operators.regions` makes it from polygons).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int, int]:
    """(files, bytes, latest change) of a table: another value where the table is another."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = store.listStatus(path)
    return len(files), sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a scan has fewer partitions than that: one small file, say."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch(spark: SparkSession) -> str:
    """Folder for stored intermediates: `spark.checkpoint.dir`, or one of this machine for a local session."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/gridloam"


def clean(value: Column) -> Column:
    """NaN as NULL: aggregates then skip it."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily grid: a supplier is a cell, the mean quantity shipped on a day its value."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell_id"), F.to_date("l_shipdate").alias("obs_date"), clean(F.col("l_quantity")).alias("q"))
    cells = rows.groupBy("cell_id", "obs_date").agg(F.avg("q").alias("value"))
    return cells.select("obs_date", "cell_id", (F.col("cell_id") % 10).alias("x"), F.floor(F.col("cell_id") / 10).alias("y"), "value")


def cell_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which region (a nation) each cell lies in."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.lower(F.trim("n_name")).alias("region"))
    cells = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id"), "s_nationkey")
    return cells.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("cell_id", "region")


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second sensor with two bands, morning and evening, over 150 cells of a 10-wide grid."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("cell_id"), F.to_date("ts").alias("obs_date"), F.when(F.hour("ts") < 12, "am").otherwise("pm").alias("band"), clean(F.col("value")).alias("v"))
    day = rows.groupBy("cell_id", "obs_date").agg(F.avg(F.when(F.col("band") == "am", F.col("v"))).alias("am"), F.avg(F.when(F.col("band") == "pm", F.col("v"))).alias("pm"))
    return day.select("obs_date", "cell_id", (F.col("cell_id") % 10).cast("double").alias("x"), F.floor(F.col("cell_id") / 10).cast("double").alias("y"), "am", "pm")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id"), "source", F.coalesce("text", F.lit("")).alias("text")))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))
