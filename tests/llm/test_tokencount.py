import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from gridloam.llm import queries, tokencount
from gridloam.llm.common import vocabulary

from .cases import documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(tokencount.MODEL))


def test_words_equal_the_library(library):
    """Runs of white space, the sign for a space, special strings and bytes that have no piece, anywhere in a text."""
    mine = tokencount.counter(vocabulary(tokencount.MODEL))
    assert mine.by_words
    rng = random.Random(3)
    bits = [" ", " ", "  ", "\n", "\n", "\t", "\r", "\r\n", "　", "\xa0", "▁", "▁▁", "a", "b", "word", "don't", "12", "...", "é", "<s>", "</s>", "<0x0A>", "日本語", "👍🏽", "x" * 50, "\x00", "​"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(50_000)]
    assert mine.count(texts) == [len(x) for x in library.encode(texts)]


def test_words_are_forgotten(library, monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE_WORDS", 50)
    mine = tokencount.PieceCounts(vocabulary(tokencount.MODEL))
    texts = [" ".join(f"w{i * j} x.{j}" for j in range(40)) for i in range(60)]
    assert [mine.count([t])[0] for t in texts] == [len(x) for x in library.encode(texts)]


def test_query_equals_the_library(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_tokens(spark, SF).collect()}
    want = {}
    for r in rows:
        n = len(library.encode(r["text"] or ""))
        want[r["doc_id"]] = (len((r["text"] or "").encode()), n, n > 4096)
    assert got == want


def test_awkward_rows(spark, library):
    docs = documents(spark)
    got = tokencount.count(docs, limit=10).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in docs.collect()]
    assert sorted(map(str, want)) == sorted(str(tuple(g)[:3]) for g in got)
    assert all(g["over_limit"] == (g["n_tokens"] > 10) for g in got)
    assert tokencount.count(docs.where("false")).count() == 0


def test_cache_is_filled_once(spark, tmp_path):
    """Only what the cache lacks is encoded; another tokenizer has counts of its own."""
    cache, path = f"file://{tmp_path}/cache", vocabulary(tokencount.MODEL)
    docs = spark.createDataFrame([(i, "ab" * (i % 5)) for i in range(50)], "doc_id long, text string")

    def missed(df):
        rows = df.select(tokencount.content_digest(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")).groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
        return tokencount.fill(df, rows, cache)

    assert missed(docs) == 5
    assert missed(docs) == 0
    assert missed(docs.withColumn("text", F.concat("text", F.lit("ab")))) == 1
    held = tokencount.cached(spark, cache, tokencount.tokenizer_digest(path))
    assert held.count() == 6
    assert bytes(held.where(F.col("digest") == F.unhex(F.lit(hashlib.sha256(b"abab").hexdigest()))).first()["digest"])
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    other = tokencount.count(docs, cache=cache, path=vocabulary("byte_bpe_50k.json")).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in other} == {i: len(tok.encode("ab" * (i % 5)).ids) for i in range(50)}
    assert spark.read.parquet(cache).groupBy("tokenizer").count().count() == 2
    twice = spark.read.parquet(cache).select("digest", "n_tokens", "tokenizer")
    twice.write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert tokencount.count(docs, cache=cache).count() == 50


def test_many_misses_and_frequent_texts(spark, library, monkeypatch):
    """Joins by a shuffle, with some texts in the cache already, and a text that most rows have."""
    monkeypatch.setattr(tokencount, "BROADCAST_MISSES", 3)
    docs = spark.createDataFrame([(i, "frequent one" if i % 4 else f"text {i}") for i in range(6000)], "doc_id long, text string")
    import uuid

    cache = f"file:///tmp/checkpoints/cache-{uuid.uuid4().hex}"
    tokencount.count(docs.where("doc_id < 400"), cache=cache).collect()
    got = tokencount.count(docs, cache=cache).collect()
    want = {t: len(library.encode(t)) for t in {r["text"] for r in docs.collect()}}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == 6000 and all(g["n_tokens"] == want[texts[g["doc_id"]]] for g in got)
