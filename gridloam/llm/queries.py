"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloam.llm import bpe, katz, kmeans, langid, neardup, negatives, packing, quality, repair, tiff, tokencount, topk, warc
from gridloam.llm.common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digests(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.with_decoded(bpe.encode(table(spark, sf_dir, "documents"), "doc_id"), "doc_id")
    n = (F.octet_length("ids") / 4).cast("long")
    return done.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    done = quality.classify(docs, labels, fold("doc_id", 4) != 2)
    return done.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = katz.score(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return done.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digests(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = langid.identify(table(spark, sf_dir, "documents"), fold("doc_id", 4) != 2)
    return done.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents"))


def op12_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster(table(spark, sf_dir, "embeddings"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), lambda i: i % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_repair": op2_repair,
    "op3_topk": op3_topk,
    "op4_bpe": op4_bpe,
    "op5_quality": op5_quality,
    "op6_katz": op6_katz,
    "op7_tiff": op7_tiff,
    "op8_langid": op8_langid,
    "op9_warc": op9_warc,
    "op10_neardup": op10_neardup,
    "op11_tokens": op11_tokens,
    "op12_kmeans": op12_kmeans,
    "op13_negatives": op13_negatives,
}

_BASE32 = " || ".join(f"substr('{warc.ALPHABET}', 1 + ((('0x' || substr(sha, {5 * i + 1}, 5))::INTEGER >> {s}) & 31), 1)" for i in range(8) for s in (15, 10, 5, 0))

_VECTORS = """
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def _round(i: int) -> str:
    """Assign all vectors to the centroids c{i}."""
    apart = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return f"""a{i} AS (
            SELECT rid, vec_id, x, cluster, distance
            FROM (SELECT v.rid, v.vec_id, v.x, c.k AS cluster, {apart} AS distance FROM v CROSS JOIN c{i} c)
            QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1
        )"""


def _moved(i: int) -> str:
    """The centroids c{i + 1}: means of the clusters of a{i}, rounded down; empty ones stay."""
    return f"""m{i} AS (
            SELECT k, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS x
            FROM (
                SELECT cluster AS k, j, CAST(sum(e) AS DOUBLE) AS s, count(*) AS n
                FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS j FROM a{i}) GROUP BY cluster, j
            ) GROUP BY k
        ), c{i + 1} AS (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON c.k = m.k)"""


ORACLE_SQL: dict[str, str] = {
    "op12_kmeans": f"""
        WITH v AS (SELECT row_number() OVER () AS rid, vec_id, x FROM ({_VECTORS}) WHERE len(x) = 64),
        c0 AS (
            SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS k, x
            FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h LIMIT 40)
        ), {", ".join(f"{_round(i)}, {_moved(i)}" for i in range(5))}, {_round(5)},
        s AS (SELECT cluster, sum(distance) AS cluster_inertia FROM a5 GROUP BY cluster)
        SELECT a.vec_id, a.cluster, CAST(a.distance AS BIGINT) AS distance, CAST(s.cluster_inertia AS BIGINT) AS cluster_inertia,
               CAST((SELECT sum(distance) FROM a5) AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM a5 a JOIN s ON a.cluster = s.cluster JOIN c5 c ON a.cluster = c.k
    """,
    "op13_negatives": f"""
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(x, lambda e: CAST(e AS DOUBLE)) AS x
            FROM ({_VECTORS}) WHERE vec_id IS NOT NULL AND label IS NOT NULL
        ), s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.x, c.x) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.x) = len(c.x)
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS "rank"
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
            AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
        QUALIFY "rank" <= 10
    """,
    "op3_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s)
        SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
    """,
    "op9_warc": f"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS sha FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS first FROM h)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM m
    """,
}
