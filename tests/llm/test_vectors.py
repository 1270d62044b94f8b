import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloam.llm import kmeans, negatives, queries, vectors

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<double>, label int, cluster string, x int, id string, row int, bucket int"


def frame(spark, rows, kind=KIND):
    return spark.createDataFrame([(i, e, y, "c", 1, "i", 2, 3) for i, e, y in rows], kind)


def awkward(dim=4, n=120, seed=1):
    """Ties, repeated rows and vectors, nulls, non-finite and huge components, other dimensions, no id, no label."""
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-3, 3) / 4 for _ in range(dim)], rng.randint(0, 3)) for i in range(n)]
    rows += rows[5:9] + [(10, [0.5] * dim, 1), (10, [0.5] * dim, 1)]
    rows += [(200, None, 1), (201, [None] * dim, 1), (202, [math.nan] * dim, 1), (203, [math.inf] + [0.0] * (dim - 1), 1)]
    rows += [(204, [], 1), (205, [1.0] * (dim + 1), 1), (210, [0.25] * (dim + 1), 1), (215, [0.75] * (dim + 1), 2)]
    rows += [(None, [0.25] * dim, 1), (207, [0.25] * dim, None), (220, [3e9, -7.3e9] + [0.1] * (dim - 2), 2), (221, [2.9e9, -7e9] + [0.1] * (dim - 2), 3), (222, [3.1e9, -7e9] + [0.0] * (dim - 2), 2), (223, [40000.0] * dim, 0)]
    return rows


def exact(v):
    return [math.floor(x * 256) if abs(x) < 2**60 else int(x) * 256 for x in v]


def whole(rows, dim=None):
    return [(i, exact(e), y) for i, e, y in rows if e and all(x is not None and math.isfinite(x) for x in e) and (dim is None or len(e) == dim)]


def test_bytes_are_exact():
    m = np.array([[0.1, -0.1, 127.9], [1e6, -1.0, 0.0], [1e300, 1e-300, -5e-324], [2.0**31, 1.5, -0.0], [-128.0, 0, 0], [1.7e308, -1.7e308, 3.3]])
    for raw, v in zip(vectors.encoded(m, 256), m.tolist(), strict=True):
        assert vectors.integers(raw, 3) == exact(v)


def plain_lloyd(rows, dim, k, rounds, seed):
    x = whole(rows, dim)
    order = sorted((i is None, hashlib.sha256(f"{seed}{i}".encode()).hexdigest(), vectors.encoded(np.array([v], float) / 256, 256)[0], v) for i, v, _ in x)
    c = [v for *_, v in order[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in c]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        at = [near(v)[0] for _, v, _ in x]
        for n in set(at):
            mine = [v for (_, v, _), a in zip(x, at, strict=True) if a == n]
            c[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    placed = [(i, *near(v)) for i, v, _ in x]
    most = 2**63 - 1
    of = {n: min(most, sum(min(d, most) for _, a, d in placed if a == n)) for n in {a for _, a, _ in placed}}
    total = min(most, sum(min(d, most) for *_, d in placed))
    return [(i, n, min(d, most), of[n], total, hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, n, d in placed]


def test_lloyd_equals_brute_force(spark):
    rows = awkward()
    got = kmeans.cluster(frame(spark, rows), dim=4, clusters=7, rounds=3, seed="s").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_lloyd(rows, 4, 7, 3, "s")))


def test_lloyd_with_few_vectors(spark):
    rows = [(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0), (3, [-0.5, 0.0], 0)]
    got = kmeans.cluster(frame(spark, rows), dim=2).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_lloyd(rows, 2, 40, 5, "2:")))
    assert kmeans.cluster(frame(spark, [(1, None, 2)]), dim=2).count() == 0


def test_lloyd_with_a_frequent_vector(spark):
    """Most rows have one vector: it is one row of a round, and is broadcast when the rows get their clusters."""
    rows = [(i, [0.5, 0.5] if i % 3 else [i / 1000, -i / 500], 0) for i in range(4000)]
    df = frame(spark, rows)
    got = kmeans.cluster(df, dim=2, clusters=5, rounds=2, seed="s").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_lloyd(rows, 2, 5, 2, "s")))


def plain_negatives(rows, every, positives=5, negatives=10, low=30, high=90):
    most = 2**63 - 1
    x = [r for r in whole(rows) if r[0] is not None and r[2] is not None]
    out = []
    for i, v, y in x:
        if i % every:
            continue
        s = [(max(-most - 1, min(most, sum(a * b for a, b in zip(v, w, strict=True)))), j, z) for j, w, z in x if j != i and len(w) == len(v)]
        s.sort(key=lambda r: (-r[0], r[1]))
        for p, j, _ in [r for r in s if r[2] == y][:positives]:
            fit = [r for r in s if r[2] != y and low * p <= 100 * r[0] <= high * p][:negatives]
            out += [(i, j, n, m, p, q) for n, (q, m, _) in enumerate(fit, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize(("block", "group", "pivots"), [(4096, 1024, 256), (8, 3, 16)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, group, pivots):
    for name, v in (("BLOCK", block), ("GROUP", group), ("PIVOTS", pivots), ("SLICE", 4), ("HELD", 2)):
        monkeypatch.setattr(negatives, name, v)
    for rows in (awkward(), awkward(6, 300, 2)[:300]):
        got = negatives.mine(frame(spark, rows), lambda i: i % 5 == 0)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(str(tuple(r)) for r in got.collect()) == plain_negatives(rows, 5)


def test_negatives_of_clusters_are_pruned(spark, monkeypatch):
    """Far-apart clusters: most blocks can't serve most groups, and the result is whole."""
    for name, v in (("BLOCK", 16), ("GROUP", 8), ("PIVOTS", 32)):
        monkeypatch.setattr(negatives, name, v)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(900):
        v = centres[i % 12] / np.linalg.norm(centres[i % 12]) + rng.normal(size=8) * 0.02
        rows.append((i, v.tolist(), int(i % 12) // 2 if i % 5 else int(i // 5) % 6))
    met = []
    whole_join = negatives.knn_join

    def counted(groups, candidates, space, cells, k, same):
        met.append((groups.count() * candidates.count(), cells))
        return whole_join(groups, candidates, space, cells, k, same)

    monkeypatch.setattr(negatives, "knn_join", counted)
    got = negatives.mine(frame(spark, rows), lambda i: i % 10 == 0)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_negatives(rows, 10)
    assert met[1][1] == 32


def test_negatives_of_nothing(spark):
    assert negatives.mine(frame(spark, [(1, None, 1)]), lambda i: i % 5 == 0).count() == 0
    assert negatives.mine(frame(spark, awkward()), lambda i: F.lit(False)).count() == 0


def test_ring_bounds_keep_all_that_can_serve():
    """For random groups and floors, every candidate over the floor lies in a cell and ring that is named."""
    import pandas as pd

    rng = np.random.default_rng(7)
    c = np.floor(256 * rng.normal(size=(500, 5)) * rng.uniform(0.2, 2, (500, 1))) / 256
    largest = float(np.linalg.norm(c, axis=1).max())
    space = negatives.Space({5: np.nextafter(largest, np.inf)}, {5: c[:12]})
    cell, dist = space.nearest(c, 5, 12, False)
    a = c[::25]
    s = negatives.products(a, c)
    low = np.sort(s, axis=1)[:, -8]
    rows = np.arange(len(a))
    group = pd.DataFrame([{"part": 1, "dim": 5, "bucket": 0, "rows": rows.astype("<i8").tobytes(), "width": 8, "x": a.astype("<f8").tobytes(), "anchors": rows.astype("<i8").tobytes(), "low": low.astype("<i8").tobytes()}])
    rings = {r.cell: (r.near, r.far) for r in pd.concat(negatives._reach(space, 12)([group])).itertuples()}
    for j in np.flatnonzero((s >= low[:, None]).any(0)):
        near, far = rings[cell[j]]
        assert near <= dist[j] <= far


@pytest.mark.parametrize("name", ["op12_kmeans", "op13_negatives"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = c.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
