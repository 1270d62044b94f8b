from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from gridloam.llm.common import vocabulary

from .cases import documents
from .test_neardup import brute
from .test_tokens import check_packed

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    assert [n for n, _ in cp.STAGES] == ["quality", "language", "dedup", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = docs
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        rows, left = {r["doc_id"]: r["text"] for r in before.collect()}, after.collect()
        if name != "pack":
            assert set(after.columns) == set(docs.columns)
            ids = {r["doc_id"] for r in left}
            assert len(left) == len(ids) and all(rows[r["doc_id"]] == r["text"] for r in left)
        if name == "quality":
            assert sum(labels[i] for i in labels if i in rows and i not in ids) <= 4 and sum(1 - labels[i] for i in labels if i in ids) <= 4
        elif name == "language":
            assert {i for i in rows if i not in ids} == {i for i, t in rows.items() if not t or not any(map(str.isalpha, t))}
        elif name == "dedup":
            assert ids == {i for i, c in brute(list(rows.items())).items() if i == c}
        else:
            packed = [r for r in left]
            assert check_packed(packed, before.collect(), Tokenizer.from_file(vocabulary("word_bpe_49k.json")), 4096) < 0.2
        before = after


def test_run_and_hard_cases(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 1), (5, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = cp.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in rows if r["start"] == 0]
    assert ids.count(2) == 1 and ids.count(8) + ids.count(9) == 1 and ids.count(None) == 1 and not {0, 1, 10} & set(ids)
    documents(spark).where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).count() == 0


def test_query(spark):
    import __spark_entry__ as e

    assert e.queries()["pipeline"](spark, SF).where(F.col("length") > 4096).count() == 0


def test_dedup_goes_by_rows(spark):
    """Ids that are missing or have two texts: one row of each class stays, and no unique text is lost."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (7, b), (None, a), (None, c), (None, c), (9, d), (9, d), (4, ""), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = cp.dedup(spark, docs, SF).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=repr) == sorted([(1, a), (5, b), (None, c), (9, d), (4, "")], key=repr)


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for c in ("score", "found", "row", "_row", "first", "_score"):
        docs = docs.withColumn(c, F.lit(c))
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert got.where("score <> 'score' or found <> 'found' or row <> 'row' or _row <> '_row'").count() == 0
