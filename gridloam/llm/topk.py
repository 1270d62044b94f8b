"""Exact top-k inner products: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz bounds.

All vectors are rotated by the right singular vectors of the whole table (from their d x d second moments, which a
partial aggregate gathers), so that the first few components hold most of the products. Candidates are put into
blocks by descending length. A first pass holds each block of queries against the longest candidates, which gives
each query a k-th best score; a pair of blocks is then made only where the product of the largest lengths can still
reach the least of those. Within a pair, partial sums over the leading components plus the product of the residual
lengths bound every score; only what passes is multiplied out, in integers.

Vectors that are null or hold a null or non-finite component, or a null id, take no part, nor do those with a component that
is not finite after scaling. Vectors meet those of their own dimension, which are searched one dimension after the other.
Candidates with the query's own id are left out. Ties go to smaller ids. Rows repeated under one id are candidates as often as they come, and each is a query of
its own, so such an id has as many rows of each rank. Scores are exact; one that no long holds is given as the nearest long. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloam.llm.common import bounded_batches, stored

BLOCK = 4096
QUERY_BLOCK = 2048
LEVELS = 64
PAIR = ("q_block", "q_rows", "q_ids", "q", "c_ids", "c", "floor")
LEAD = 16
_MOST = 2**63 - 1


def quantized(df: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """(id, x): floor(scale * component) as doubles, of whole finite vectors only."""
    x = F.transform(F.col(vector), lambda v: v.cast("double") * scale)
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    out = df.select(F.col(key).cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null")
    # from 2**53 on every double is whole, and floor, which gives a long, may not hold it
    whole = F.transform("x", lambda v: F.when(F.abs(v) < float(1 << 53), F.floor(v).cast("double")).otherwise(v))
    return out.where((F.size("x") > 0) & ~bad).select("id", whole.alias("x"))


def moments(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of the outer products of all vectors, a d x d matrix."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for pdf in batches:
            m = np.stack(pdf["x"].to_numpy()).astype(np.float64)
            m /= np.maximum(1.0, np.abs(m).max(1, keepdims=True) / 1e6)  # a few huge vectors don't decide alone
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(dim), "row": [r.tolist() for r in total]})

    rows = vectors.mapInPandas(part, "i int, row array<double>").groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(str(j)) for j in range(dim)]).orderBy("i").collect()
    return np.array([[r[str(j)] for j in range(dim)] for r in rows])


def pack_block(ids: np.ndarray, m: np.ndarray) -> tuple[bytes, bytes]:
    return ids.astype("<i8").tobytes(), m.astype("<f8").tobytes()


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def lengths(m: np.ndarray) -> np.ndarray:
    """Euclidean lengths; components whose squares no double holds don't spoil them."""
    most = np.abs(m).max(1, initial=0.0)
    return np.sqrt(((m / np.maximum(most, 1e-300)[:, None]) ** 2).sum(1)) * most


def products(c: np.ndarray, c_len: np.ndarray, q: np.ndarray, q_len: float) -> np.ndarray:
    """Inner products of rows of c with q, as integers."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = np.rint(c @ q)
        big = np.flatnonzero(~(c_len * q_len < 2.0**53))
        if not len(big):
            return s.astype(np.int64)
        out = np.zeros(len(s), np.int64)
        small = np.flatnonzero(c_len * q_len < 2.0**53)
        out[small] = s[small].astype(np.int64)
        whole = [int(v) for v in q.tolist()]
        for i in big.tolist():
            exact = sum(int(a) * b for a, b in zip(c[i].tolist(), whole, strict=True))
            out[i] = max(-_MOST, min(_MOST, exact))
        return out


def block_top(q_rows, q_ids, q, c_ids, c, floor, rotation, k: int, lead: int) -> list[tuple[int, int, int, int]]:
    """(query's row, query, candidate, score) of the up to k best candidates of each query that reach its floor."""
    q_len, c_len = lengths(q), lengths(c)
    order = np.argsort(-c_len, kind="stable")
    c, c_ids, c_len = c[order], c_ids[order], c_len[order]
    with np.errstate(over="ignore", invalid="ignore"):
        qr, cr = q @ rotation, c @ rotation
    q_rest, c_rest = lengths(qr[:, lead:]), lengths(cr[:, lead:])
    eps = 1e-9 * (1 + q_len * (c_len[0] if len(c_len) else 0))
    out = []
    for i in range(len(q_ids)):
        reach = np.searchsorted(-c_len, -(floor[i] - eps[i]) / q_len[i], "right") if q_len[i] > 0 and floor[i] > 0 else len(c_len)
        if not reach:
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            bound = cr[:reach, :lead] @ qr[i, :lead] + c_rest[:reach] * q_rest[i] + eps[i]
        # bounds that doubles can't hold prune nothing
        huge = ~(c_len[:reach] * q_len[i] < 2.0**62)
        at = np.flatnonzero((bound >= floor[i]) | huge)
        if len(at) > 8 * k and not huge.any():  # the k best by bound first: their scores raise the floor for the others
            first = at[np.argpartition(-bound[at], 4 * k)[: 4 * k]]
            first = first[c_ids[first] != q_ids[i]]
            if len(first) >= k:
                low = np.partition(products(c[first], c_len[first], q[i], q_len[i]), len(first) - k)[len(first) - k]
                at = at[bound[at] >= low]
        at = at[c_ids[at] != q_ids[i]]
        s = products(c[at], c_len[at], q[i], q_len[i])
        if len(s) > 4096:
            low = np.partition(s, len(s) - k)[len(s) - k]
            at, s = at[s >= low], s[s >= low]
        for j in best(c_ids[at], s, k):
            out.append((int(q_rows[i]), int(q_ids[i]), int(c_ids[at[j]]), int(s[j])))
    return out


def search(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256, lead: int = LEAD) -> DataFrame:
    """(query_id, rank, <key>, score): each query's k highest integer inner products with all other rows."""
    spark = df.sparkSession
    out_kind = f"query_id long, rank int, `{key}` long, score long"
    vectors = quantized(df, key, vector, scale)
    dims = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").collect()  # a row for each dimension
    found = [_search(vectors, is_query, r["d"], key, k, lead, out_kind) for r in dims]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], out_kind)


def _search(vectors: DataFrame, is_query, dim: int, key: str, k: int, lead: int, out_kind: str) -> DataFrame:
    """`search` among the vectors of one dimension."""
    spark = vectors.sparkSession
    vectors = vectors.where(F.size("x") == dim).withColumn("len2", F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    rotation = np.linalg.eigh(moments(vectors, dim))[1][:, ::-1].copy()
    lead = min(lead, dim)
    n = vectors.count()
    # levels by descending length: quantiles of the length bound them; a hash of the id deals each level to blocks
    parts = max(1, min(LEVELS, -(-n // BLOCK)))
    cuts = sorted({*vectors.stat.approxQuantile("len2", [i / parts for i in range(1, parts)], 0.2 / parts)}, reverse=True) if parts > 1 else []
    sized = vectors.withColumn("level", sum((F.when(F.col("len2") < c, 1).otherwise(0) for c in cuts), F.lit(0)))
    share = {r["level"]: max(1, -(-r["count"] // BLOCK)) for r in sized.groupBy("level").count().collect()}
    salts = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    sized = sized.withColumn("salt", F.pmod(F.xxhash64("id", "x"), salts[F.col("level")]).cast("int"))

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf["x"].to_numpy())
        ids, raw = pack_block(pdf["id"].to_numpy(), m)
        return pd.DataFrame({"level": [pdf["level"].iloc[0]], "salt": [pdf["salt"].iloc[0]], "longest": [float(lengths(m).max())], "c_ids": [ids], "c": [raw]})

    kind = "level int, salt int, longest double, c_ids binary, c binary"
    bounded_batches(spark)
    candidates = stored(sized.select("level", "salt", "len2", "id", "x").groupBy("level", "salt").applyInPandas(blocks, kind))
    # each row is a query with a number of its own; stored, so that a number stays with its row
    queries = stored(vectors.where(is_query(F.col("id"))).select("id", "x", F.monotonically_increasing_id().alias("row")), "queries")
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    queries = queries.withColumn("q_block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")).groupBy("q_block")

    def query_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, raw = pack_block(pdf["id"].to_numpy(), np.stack(pdf["x"].to_numpy()))
        rows = pdf["row"].to_numpy().astype("<i8").tobytes()
        return pd.DataFrame({"q_block": [pdf["q_block"].iloc[0]], "q_rows": [rows], "q_ids": [ids], "q": [raw]})

    asked = stored(queries.applyInPandas(query_blocks, "q_block int, q_rows binary, q_ids binary, q binary"))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                q_rows, q_ids, c_ids = (np.frombuffer(x, "<i8") for x in (r.q_rows, r.q_ids, r.c_ids))
                q, c = np.frombuffer(r.q, "<f8").reshape(-1, dim), np.frombuffer(r.c, "<f8").reshape(-1, dim)
                floor = np.frombuffer(r.floor, "<f8") if r.floor is not None else np.full(len(q_ids), -np.inf)
                got = block_top(q_rows, q_ids, q, c_ids, c, floor, rotation, k, lead)
                hits = pd.DataFrame(got, columns=["row", "query_id", "id", "score"]).astype("int64")
                yield hits.assign(q_block=np.int32(r.q_block))

    hit = "row long, query_id long, id long, score long, q_block int"
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    top = (F.col("level") == min(share)) & (F.col("salt") == 0)
    first = asked.withColumn("level", F.lit(min(share))).withColumn("salt", F.lit(0)).join(candidates.where(top), ["level", "salt"])
    seed = stored(first.withColumn("floor", F.lit(None).cast("binary")).select(*PAIR).repartition(spread).mapInPandas(pairs, hit))

    # the k-th best score so far of each query, beside its block
    def floors(key_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["q_block", "q_rows", "q_ids", "q"]
        if left.empty:
            return pd.DataFrame({c: [] for c in (*names, "floor", "reach")})
        q_rows = np.frombuffer(left["q_rows"].iloc[0], "<i8")
        length = lengths(np.frombuffer(left["q"].iloc[0], "<f8").reshape(-1, dim))
        kth = {a: float(np.sort(g.to_numpy())[-k]) for a, g in right.groupby("row")["score"] if len(g) >= k}
        floor = np.array([kth.get(int(i), -np.inf) for i in q_rows])
        # a candidate shorter than this can't reach the floor of any query of the block
        need = np.where(floor > 0, floor / np.maximum(length, 1e-300), 0.0)
        return left[names].assign(floor=[floor.astype("<f8").tobytes()], reach=[float(need.min())])

    bound = asked.groupBy("q_block").cogroup(seed.groupBy("q_block")).applyInPandas(floors, "q_block int, q_rows binary, q_ids binary, q binary, floor binary, reach double")
    bound = stored(bound)
    # of a query block and a candidate block only numbers are paired; the vectors follow where a pair is left
    todo = bound.select("q_block", "reach", F.explode(F.lit(sorted(share))).alias("level"))
    todo = todo.join(candidates.where(~top).select("level", "salt", "longest"), "level").where(F.col("longest") * (1 + 1e-9) >= F.col("reach")).select("q_block", "level", "salt")
    later = todo.join(bound, "q_block").join(candidates, ["level", "salt"]).select(*PAIR)
    hits = seed.unionByName(later.repartition(spread).mapInPandas(pairs, hit))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "score", "id"], ascending=[True, False, True])
        pdf = pdf.assign(rank=pdf.groupby("row").cumcount() + 1)
        pdf = pdf[pdf["rank"] <= k]
        return pd.DataFrame({"query_id": pdf["query_id"], "rank": pdf["rank"].astype("int32"), key: pdf["id"], "score": pdf["score"]})

    return hits.withColumn("_deal", F.pmod(F.xxhash64("row"), F.lit(n_blocks * 64))).groupBy("_deal").applyInPandas(merge, out_kind)
