"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of hashed n-grams of two views: its bytes (n from 1 to 3, A-Z folded), and its
words' shapes (n from 1 to 3; a shape is the word's case, length, last mark and whether it repeats the word before).
Indicators are scaled by the log ratio of their smoothed counts in the two classes; a linear hinge-loss model is
fitted to them by dual coordinate descent, and its weights are drawn towards the mean weight as the method has it.
The sigmoid that maps margins to probabilities is fitted to margins of rows by models that haven't seen them.

The sample is bounded (`SAMPLE` labelled rows, chosen by a hash of the key); every whole text is scored. Labels,
language, source and key are no inputs. Null and empty texts have no feature and get the score of the bias alone.
With no label, or one class only, the score is that class's (1 without labels). Of several labels for one key the
smallest counts. Repeated rows are scored as often as they come.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloam.llm.common import bounded_batches, span_hashes, texts_of, word_spans

#: Labelled rows that are learned from, at most (in the mean; a hash of the key chooses them).
SAMPLE = 6000
VIEW = 1 << 15
WIDTH = 2 * VIEW
EPOCHS = 12
#: Parts of the sample; the sigmoid is fitted to margins of each from a model of the others.
PARTS = 3
COST = 1.0
SMOOTH = 1.0
BLEND = 0.25
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_KIND = np.zeros(256, np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 2


def present(raw: bytes) -> np.ndarray:
    """Which of the WIDTH features a text has."""
    flags = np.zeros(WIDTH, bool)
    for a in range(0, len(raw), 1 << 20):  # by pieces, for memory; n-grams reach over their ends
        buf = _FOLD[np.frombuffer(raw, np.uint8, min(len(raw) - a, (1 << 20) + 2), a)]
        flags[buf] = True
        two = buf[:-1] << 8 | buf[1:]
        flags[two * np.uint32(0x9E3779B1) >> np.uint32(17)] = True
        flags[((two[:-1] << 8 | buf[2:]) * np.uint32(0x85EBCA6B)) >> np.uint32(17)] = True
    buf, start, end = word_spans(raw)
    if len(start):
        words = span_hashes(buf, start, end, lower=True)
        caps = np.concatenate(([0], np.cumsum(_KIND[buf] == 1)))
        last = buf[end - 1].astype(np.int64)
        shape = _KIND[buf[start]] + 4 * np.minimum(caps[end] - caps[start], 3) + 16 * np.minimum((end - start) >> 2, 7) + 128 * np.where(_KIND[last] > 0, 0, last & 127)
        shape[1:] += (words[1:] == words[:-1]) << 14
        grams = [shape, shape[:-1] * 40503 + shape[1:] + (1 << 40), shape[:-2] * 1_640_531 + shape[1:-1] * 40503 + shape[2:] + (1 << 41)] if len(shape) > 2 else [shape]
        for g in grams:
            flags[VIEW + ((g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)] = True
    return flags


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def margin(self, flags: np.ndarray) -> float:
        return float(self.weights[flags].sum()) + self.bias

    def score(self, raw: bytes) -> float:
        return float(sigmoid(self.slope * self.margin(present(raw)) + self.shift))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, float]:
    """(weights of the scaled features, bias) of the L1-hinge support vector machine with a constant feature."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(len(scale)), 0.0
    q = np.array([float(scale[r] @ scale[r]) + 1.0 for r in rows])
    alpha = np.zeros(len(rows))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            v = scale[r]
            grad = y[i] * (float(w[r] @ v) + b) - 1
            new = min(max(alpha[i] - grad / q[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4 * cost:
            break
    return w, b


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid, by Newton's method with smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * margin + b)
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ margin, d.sum()])
        m = np.array([[h @ (margin * margin) + 1e-6, h @ margin], [h @ margin, h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(a, 1e-3), b


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model of feature indices and 0/1 labels."""
    y = np.where(labels > 0, 1.0, -1.0)
    if len(y) == 0 or (y > 0).all() or (y < 0).all():
        sure = 0.0 if len(y) and y[0] < 0 else 1.0
        return Model(np.zeros(WIDTH), 0.0, 1.0, 500.0 if sure else -500.0)

    def ratio(keep: np.ndarray) -> np.ndarray:
        count = [np.full(WIDTH, SMOOTH), np.full(WIDTH, SMOOTH)]
        for i in np.flatnonzero(keep):
            count[0 if y[i] > 0 else 1][rows[i]] += 1
        out = np.log((count[0] / count[0].sum()) / (count[1] / count[1].sum()))
        out[(count[0] <= SMOOTH) & (count[1] <= SMOOTH)] = 0
        return out

    def weights(keep: np.ndarray) -> tuple[np.ndarray, float]:
        scale = ratio(keep)
        at = np.flatnonzero(keep)
        size = np.mean([np.linalg.norm(scale[rows[i]]) for i in at]) or 1.0
        w, b = dual_descent([rows[i] for i in at], y[at], scale / size)
        w = (1 - BLEND) * np.abs(w).mean() + BLEND * w
        return w * scale / size, BLEND * b

    part = np.zeros(len(y), np.int64)
    for s in (1, -1):  # each class is dealt evenly to the parts
        part[y == s] = np.arange((y == s).sum()) % PARTS
    margin = np.zeros(len(y))
    for k in range(PARTS):
        rest, mine = part != k, np.flatnonzero(part == k)
        if (y[rest] > 0).all() or (y[rest] < 0).all():
            rest = np.ones(len(y), bool)
        w, b = weights(rest)
        margin[mine] = [w[rows[i]].sum() + b for i in mine]
    return Model(*weights(np.ones(len(y), bool)), *platt(margin, y))


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of the labelled rows for which `learn_from` (of the key) holds."""
    spark = docs.sparkSession
    known = labels.where(learn_from).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null")
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    known = known.groupBy("k").agg(F.min("y").alias("y"))
    # the sample is bounded, so its keys go to where the texts are
    rows = texts_of(docs, text, key).withColumnRenamed(key, "k").join(F.broadcast(known), "k").select("k", "y", F.encode("text", "UTF-8").alias("text"))

    def run(batches):
        for b in batches:
            found = [np.flatnonzero(present(t)).astype("<u2").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(found, pa.binary())], ["k", "y", "found"])

    bounded_batches(spark)
    got = sorted(rows.withColumn("k", F.xxhash64("k")).mapInArrow(run, "k long, y int, found binary").collect(), key=lambda r: (r["k"], r["found"]))
    return fit([np.frombuffer(r["found"], "<u2").astype(np.int32) for r in got], np.array([r["y"] for r in got]))


def scorer(spark, model: Model):
    """A function from a text column to its score."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([held.value.score(t) for t in texts], dtype="float64")

    bounded_batches(spark)
    return lambda c: score(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8"))


def classify(docs: DataFrame, labels: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", label: str = "quality", least: float = 0.7) -> DataFrame:
    """(key, score, predicted) of every document."""
    score = scorer(docs.sparkSession, train(docs, labels, learn_from, key, text, label))
    return docs.select(F.col(key), score(F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= least).cast("int"))
