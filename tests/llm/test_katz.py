import re
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloam.llm import exchange, katz, queries

from .cases import documents

SF = "/root/testdata/sf0.001"


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\\x20\\x09-\\x0D]+", folded), None]


def brute(rows, order=3):
    """The model in plain dictionaries: (id, learn, text) to what `score` gives."""
    one, after = Counter(), [defaultdict(Counter) for _ in range(order + 1)]
    for _, learn, text in rows:
        if learn:
            w = words(text)
            one.update(w)
            full = ["<s>", *w]
            for i in range(1, len(full)):
                for k in range(2, order + 1):
                    if i >= k - 1:
                        after[k][tuple(full[i - k + 1 : i])][full[i]] += 1
    d = {1: katz.discounts(Counter(one.values()))}
    for k in range(2, order + 1):
        d[k] = katz.discounts(Counter(n for c in after[k].values() for n in c.values()))
    total, types = sum(one.values()), len(one)
    cut = lambda n, k: n * (d[k][n] if n < len(d[k]) else 1.0)
    mass = sum(cut(n, 1) for n in one.values())
    scale = 1.0 if total and total - mass > 1e-12 * total else total / (total + 1)
    unknown = 1 - scale * mass / total if total else 1.0
    cache = {}

    def history(h):
        if h not in cache:
            k = len(h) + 1
            c, n = after[k][h], sum(after[k][h].values())
            seen = sum(cut(x, k) for x in c.values()) / n
            g = 1.0 if any(cut(x, k) < x for x in c.values()) else n / (n + 1)
            cache[h] = (g, n, (1 - g * seen) / (1 - sum(p(h[1:], w) for w in c)))
        return cache[h]

    def p(h, w):
        if not h:
            return scale * cut(one[w], 1) / total if w in one else unknown
        k = len(h) + 1
        if h not in after[k]:
            return p(h[1:], w)
        g, n, alpha = history(h)
        return g * cut(after[k][h][w], k) / n if w in after[k][h] else alpha * p(h[1:], w)

    for k in range(2, order + 1):
        for h in list(after[k])[:30]:  # exactly normalised: all known words and the unknown one
            assert sum(p(h, w) for w in one) + p(h, "never seen") == pytest.approx(1, abs=1e-9)
    out = []
    for i, learn, text in rows:
        w = words(text)
        full = ["<s>", *w]
        base = sum(log10((one[x] + 1) / (total + types + 1)) for x in w)
        score = sum(log10(p(tuple(full[max(0, j - order + 1) : j]), full[j])) for j in range(1, len(full)))
        out.append((i, learn, len(w), sum(x in one for x in w), total, base, score))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_hard_cases_against_brute_force(spark, order):
    df = documents(spark)
    lines = ["a b a b a b c", "a b", "a B c d", "x y", "x y", "x y", "Y x", "hello world x y", "q r s", "q r s", "q r s", "q r s t", "b a b z"]
    more = spark.createDataFrame([(50 + i, t) for i, t in enumerate(lines * 2)], "doc_id long, text string")
    df = df.unionByName(more, allowMissingColumns=True).repartition(5)
    for learn in (F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False)), F.lit(True), F.lit(False)):
        rows = [(r[0], r[1], r[2]) for r in df.select("doc_id", learn, "text").collect()]
        same(katz.score(df, learn, order=order, chunk_bytes=40).collect(), brute(rows, order))
    if order == 3:
        assert katz.score(df.where("false"), F.lit(True)).count() == 0


def test_histories_that_free_nothing(spark):
    """A history whose followers all come often is scaled, so that others after it have a probability."""
    rows = [(i, f"the same line is here {i % 3}") for i in range(60)] + [(101, "the same thing is here 9"), (102, "is here 1 more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    learn = F.col("doc_id") < 100
    for order in (2, 3):
        got = katz.score(df, learn, order=order, chunk_bytes=200).collect()
        same(got, brute([(r[0], r[0] < 100, r[1]) for r in rows], order))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", ~(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2), "text").collect()]
    got = queries.op6_katz(spark, SF).withColumn("held_out", ~F.col("held_out"))
    want = brute(rows)
    same(got.collect(), want)
    same(katz.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, chunk_bytes=50_000).collect(), want)


def test_blocks():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 56, 5000, dtype=np.uint64))
    assert (exchange.unpack_keys(exchange.pack_keys(keys)) == keys).all() and len(exchange.unpack_keys(b"")) == 0
    assert (exchange.unpack_keys(exchange.pack_keys(keys[:1])) == keys[:1]).all()
    n = np.array([0, 1, 254, 255, 256, 1 << 40, 3])
    assert (exchange.unpack_counts(exchange.pack_counts(n)) == n).all()
    at = exchange.cuts(keys, 7)
    assert at[0] == 0 and at[-1] == len(keys) and all(((int(k) * 7) >> 56) == b for b in range(7) for k in keys[at[b] : at[b + 1]])
