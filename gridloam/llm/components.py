"""Connected components of a graph of long ids, by alternating large and small stars; nothing comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloam.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def _lowest(edges: DataFrame) -> DataFrame:
    """(at, m): the smallest neighbour of each id.

    Stored, so that the join with the edges has an exchange on either side, and adaptive execution can split the
    centre of a large star.
    """
    return stored(edges.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m")), "lowest")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) of every id in the edges (u, v): root is the smallest id that it is linked with, over any way.

    Rounds go on until nothing changes, which takes a number of them in the order of the square of the logarithm of
    the ids at most.
    """
    ends = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = stored(edges.where("u <> v").select(*ends).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both).select("at", F.least("at", "m").alias("m"))
        # each larger neighbour of an id is tied to the smallest id in its neighbourhood
        large = both.join(low, both.u == low.at).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "edges")
        # then each smaller neighbour
        low = _lowest(large)
        small = large.join(low, large.u == low.at).where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = stored(small.unionByName(low.select(F.col("at").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select("u", F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
