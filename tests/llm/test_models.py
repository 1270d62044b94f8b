import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloam.llm import langid, quality, queries

from .cases import documents

SF = "/root/testdata/sf0.01"


def test_quality_query(spark):
    got = queries.op5_quality(spark, SF).cache()
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0
    held = got.where("held_out").join(labels, "doc_id").select("predicted", "quality").toPandas()
    assert (held["predicted"] == held["quality"]).mean() > 0.93
    assert got.where("held_out <> (crc32(cast(doc_id as string)) % 4 = 2)").count() == 0


def test_quality_hard_cases(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(0, 1, 3.0), (2, 0, 1.0), (2, 1, 1.0), (5, 1, 0.0), (7, None, 0.0), (None, 1, 0.0), (99, 0, 0.0)], "doc_id long, quality int, score double")
    for known in (labels, labels.where("quality = 1"), labels.where("false")):
        rows = quality.classify(docs, known, F.lit(True)).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] > 0.99 for r in rows)
    assert quality.classify(docs.where("false"), labels, F.lit(True)).count() == 0


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(20) < 0.3) for _ in range(80)]
    y = np.where([(3 in r) or (rng.random() < 0.1) for r in rows], 1.0, -1.0)
    scale = rng.normal(size=20)
    w, b = quality.dual_descent(rows, y, scale, epochs=400)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + sum(max(0.0, 1 - t * (w[r] @ scale[r] + b)) for r, t in zip(rows, y, strict=True))

    low = loss(w, b)
    for _ in range(300):
        assert loss(w + rng.normal(size=20) * 0.01, b + rng.normal() * 0.01) >= low - 1e-3


def test_langid_query(spark):
    got = queries.op8_langid(spark, SF).cache()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.count() == docs.count() and got.where("score < 0 or score > 1").count() == 0
    held = got.where("held_out").join(docs, "doc_id").select("lang", "lang_pred").toPandas()
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97


def test_langid_hard_cases(spark):
    docs = documents(spark)
    rows = {r["doc_id"]: r for r in langid.identify(docs, F.lit(True)).collect()}
    assert len(rows) == 15 and all((rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0) for i in (0, 1, 10))
    assert rows[2]["lang_pred"] == "en"
    assert all(r["lang_pred"] == "und" for r in langid.identify(docs, F.lit(False)).collect())
    assert langid.identify(docs.where("false"), F.lit(True)).count() == 0


def slow_ppm(texts, symbol, text):
    """Bits of a text by following contexts and escapes one by one."""
    s = lambda raw: [int(x) for x in symbol[np.frombuffer(b"   " + raw, np.uint8)]]
    counts = {}
    for t in texts:
        x = s(t)
        for i in range(3, len(x)):
            for k in range(4):
                c = counts.setdefault(tuple(x[i - k : i]), {})
                c[x[i]] = c.get(x[i], 0) + 1

    def prob(context, alive):
        """Probabilities of all symbols in `alive`, which sum to one."""
        if context is None:
            return dict.fromkeys(alive, 1 / len(alive))
        here = counts.get(context)
        lower = prob(context[1:] if context else None, alive)
        if not here:
            return lower
        n, kinds = sum(here.values()), len(here)
        escape = 0 if kinds == len(alive) else kinds / (n + kinds)
        rest = sum(lower[a] for a in alive if a not in here)
        return {a: (1 - escape) * here[a] / n if a in here else escape * lower[a] / rest for a in alive}

    x, bits = s(text), 0.0
    for i in range(3, len(x)):
        bits -= np.log2(prob(tuple(x[i - 3 : i]), range(64))[x[i]])
        bits += np.log2(256 - 26 - 63) if x[i] == 63 else 0
    return bits


def test_langid_code_lengths(spark):
    texts = [b"the cat sat on the mat", b"a rat ate the cat", b"Zq#1 the"]
    df = spark.createDataFrame([("a", t.decode()) for t in texts], "lang string, text string")
    grams = langid.four_grams(df, "text", "lang")
    # the padding between texts of one batch is left out, so each text is counted by itself
    grams = pd.concat([langid.four_grams(spark.createDataFrame([("a", t.decode())], "lang string, text string"), "text", "lang") for t in texts])
    model = langid.build(grams.groupby(["lang", "code"], as_index=False)["n"].sum())
    for t in (b"the rat", b"Qqq", b"cat\xc3\xa9 on"):
        want = slow_ppm(texts, model.symbol, t)
        assert model.code_lengths([b"x", t, b"", t])[[1, 3], 0] == pytest.approx([want, want], rel=1e-4)
    assert np.allclose(np.exp2(-model.bits[:, :63, 0].astype(float)).sum(1) + np.exp2(-model.bits[:, 63, 0].astype(float)) * (256 - 26 - 63), 1, atol=1e-3)


def test_langid_learns_every_language(spark, monkeypatch):
    """More languages than a block takes, the last with the fewest documents."""
    rng = np.random.default_rng(1)
    names = [f"l{k:02d}" for k in range(70)]
    words = {n: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(8)] for n in names}
    line = lambda n: " ".join(rng.choice(words[n], 20))
    rows = [(k, line(n), n) for k, n in enumerate(n for i, n in enumerate(names) for _ in range(4 if i < 66 else 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, "doc_id", "text", "lang")
    assert len(model.files) > 1 and [x for m in model for x in m.languages] == names
    got = langid.predict(model, [line(n) for n in names])
    assert got[0] == names and min(got[1]) > 0.99
    # blocks give what one model gives
    monkeypatch.setattr(langid, "BLOCK_LANGUAGES", 100)
    monkeypatch.setattr(langid, "BLOCK_BYTES", 1 << 40)
    whole = langid.train(docs, "doc_id", "text", "lang")
    mixed = [line(names[3])[:9] + line(names[68])[:9], "zz", None, "12"]
    a, b = langid.predict(model, mixed), langid.predict(whole, mixed)
    assert len(whole.files) == 1 and a[0] == b[0] and np.allclose(a[1], b[1])
