"""Lloyd's algorithm over distinct integer vectors that count as often as they come.

Rows with equal vectors become one row with a multiplicity, so a vector that a third of the table repeats is held
against the centroids once a round. A round is one pass over the distinct vectors: each task adds up multiplicity times
vector for each cluster in whole numbers, the tasks' sums are added up in two steps, and the driver gets one row for
each cluster. At last the clusters are joined to the rows by their vectors.

Vectors that are null, hold a null or non-finite component or haven't `dim` components take no part. Rows without an
id are clustered like others, but start a centroid only where rows with an id are too few; of rows with one id, the
vector with the smaller bytes comes first. Fewer vectors than clusters give as many centroids as there are vectors. An
empty table gives no rows. All numbers are exact at any size of the components; a distance or an inertia that no long
holds is given as the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloam.llm.common import spread_join, stored, tidy
from gridloam.llm.vectors import EXACT, UNIT, integer_vectors, integers, matrix

DIM, CLUSTERS, ROUNDS = 64, 40, 5
_MOST = 2**63 - 1
#: Groups in which the tasks' sums are added up first.
FAN_IN = 64

Centroids = list[list[int]]


class Nearest:
    """The nearest of some centroids; made once a task."""

    def __init__(self, centroids: Centroids):
        self.exact = centroids
        self.dim = len(centroids[0])
        self.most = max(abs(v) for c in centroids for v in c)
        if self.most < EXACT:
            self.c = np.array(centroids, np.float64)
            self.c2 = (self.c**2).sum(1)

    def of(self, raws: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """(number of the nearest centroid, squared distance) of each vector; ties go to the smaller number."""
        m, small = matrix(raws, self.dim)
        m *= UNIT
        reach = np.abs(m).max(1, initial=0.0) + self.most
        plain = small & (4 * self.dim * reach**2 < EXACT)
        number, distance = np.zeros(len(raws), np.int32), [0] * len(raws)
        at = np.flatnonzero(plain)
        if len(at):
            x = m[at]
            d = (x**2).sum(1)[:, None] - 2 * (x @ self.c.T) + self.c2
            number[at] = d.argmin(1)
            for i, v in zip(at.tolist(), d.min(1).astype(np.int64).tolist(), strict=True):
                distance[i] = v
        for i in np.flatnonzero(~plain).tolist():
            x = integers(raws[i], self.dim)
            d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in self.exact]
            distance[i] = min(d)
            number[i] = d.index(distance[i])
        return number, distance


def _written(numbers: list[int]) -> str:
    return ",".join(map(str, numbers))


def _sums(distinct: DataFrame, centroids: Centroids) -> dict[int, tuple[int, list[int]]]:
    """By cluster: (rows, sum of their vectors). A row for each cluster comes to the driver."""
    dim = len(centroids[0])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, total = Nearest(centroids), {}
        for b in batches:
            raws, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            number, _ = nearest.of(raws)
            m, small = matrix(raws, dim)
            m *= UNIT
            safe = small & (np.abs(m).max(1, initial=0.0) * float(n.sum()) < EXACT)
            for c in np.unique(number).tolist():
                count, held = total.get(c, (0, [0] * dim))
                at = np.flatnonzero((number == c) & safe)
                add = (m[at] * n[at, None]).sum(0).astype(np.int64).tolist()
                held = [a + b for a, b in zip(held, add, strict=True)]
                for i in np.flatnonzero((number == c) & ~safe).tolist():
                    held = [a + int(n[i]) * v for a, v in zip(held, integers(raws[i], dim), strict=True)]
                total[c] = count + int(n[number == c].sum()), held
        rows = list(total.items())
        yield pa.RecordBatch.from_pydict({"cluster": pa.array([c for c, _ in rows], pa.int32()), "n": pa.array([n for _, (n, _) in rows], pa.int64()), "sums": pa.array([_written(s) for _, (_, s) in rows], pa.string())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [0] * dim
        for s in pdf["sums"]:
            held = [a + int(b) for a, b in zip(held, s.split(","), strict=True)]
        return pd.DataFrame({"cluster": pdf["cluster"].iloc[:1], "n": [pdf["n"].sum()], "sums": [_written(held)]})

    kind = "cluster int, n long, sums string"
    parts = distinct.select("x", "n").mapInArrow(tidy(part), kind).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
    few = parts.groupBy("cluster", "part").applyInPandas(add, kind)
    rows = few.groupBy("cluster").applyInPandas(add, kind).collect()
    return {r["cluster"]: (r["n"], [int(v) for v in r["sums"].split(",")]) for r in rows}


def first_centroids(rows: DataFrame, clusters: int, seed: str) -> Centroids:
    """The vectors of the rows whose `seed` and id have the smallest sha256, in its order."""
    order = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    got = rows.select(order.alias("h"), "x", "dim").orderBy(F.asc_nulls_last("h"), "x").limit(clusters).collect()
    return [integers(bytes(r["x"]), r["dim"]) for r in got]


def lloyd(distinct: DataFrame, centroids: Centroids, rounds: int) -> Centroids:
    """The centroids after some rounds over (x, n); a cluster without vectors keeps its centroid."""
    for _ in range(rounds):
        for c, (n, s) in _sums(distinct, centroids).items():
            centroids[c] = [v // n for v in s]
    return centroids


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = DIM, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "2:") -> DataFrame:
    """(<key>, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    rows = stored(integer_vectors(df.select(F.col(key).alias("id"), F.col(vector).alias("vector")), "vector", ["id"], dim), "vectors")
    distinct = stored(rows.groupBy("x").agg(F.count("*").alias("n")), "distinct")
    start = first_centroids(rows, clusters, seed)
    if not start:
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = lloyd(distinct, start, rounds)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids)
        for b in batches:
            number, distance = nearest.of(b.column(0).to_pylist())
            distance = [min(d, _MOST) for d in distance]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number), pa.array(distance, pa.int64())], ["x", "n", "cluster", "distance"])

    placed = stored(distinct.select("x", "n").mapInArrow(tidy(assign), "x binary, n long, cluster int, distance long"), "assigned")

    def held(total):
        return F.least(total, F.lit(_MOST).cast("decimal(38,0)")).cast("long")

    # one row for each cluster
    inertia = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)") * F.col("n").cast("decimal(18,0)")).alias("s"))
    inertia = inertia.select("cluster", held(F.col("s")).alias("cluster_inertia"), held(F.sum("s").over(Window.partitionBy())).alias("inertia"))
    digest = [(i, hashlib.sha256(_written(c).encode()).hexdigest()) for i, c in enumerate(centroids)]
    inertia = inertia.join(F.broadcast(spark.createDataFrame(digest, "cluster int, centroid_sha256 string")), "cluster")
    out = spread_join(rows.select("id", "x"), placed.select("x", "cluster", "distance"), "x", distinct)
    out = out.join(F.broadcast(inertia), "cluster")
    return out.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
