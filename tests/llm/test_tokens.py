import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloam.llm import bpe, packing, queries, words
from gridloam.llm.common import vocabulary
from gridloam.llm.words import library_words

from .cases import documents

SF = "/root/testdata/sf0.001"


def library(name):
    tok = Tokenizer.from_file(vocabulary(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def all_docs(spark):
    return [*documents(spark).select("doc_id", "text").collect(), *spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text").collect()]


def frame(spark, rows):
    return spark.createDataFrame([(r["doc_id"], r["text"], 7) for r in rows], "doc_id long, text string, length int")


def test_bpe_equals_the_library(spark):
    tok, rows = library("byte_bpe_50k.json"), all_docs(spark)
    got = bpe.with_decoded(bpe.encode(frame(spark, rows), "doc_id"), "doc_id").collect()
    want = sorted((r["doc_id"] or -1, np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids, "<u4").tobytes()) for r in rows)
    assert sorted((g["doc_id"] or -1, bytes(g["ids"])) for g in got) == want
    for g in got:
        assert g["text"] == tok.decode(np.frombuffer(bytes(g["ids"]), "<u4").tolist(), skip_special_tokens=False)


def test_bpe_every_character(spark):
    tok, mine = library("byte_bpe_50k.json"), bpe.load(vocabulary("byte_bpe_50k.json"))
    for a in range(0, 0x30000, 24):
        t = "x ".join(chr(c) for c in range(a, a + 24) if not 0xD800 <= c < 0xE000) + " \n z"
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, hex(a)


def test_bpe_mixed_white_space():
    """Runs of white space that hold spaces and others, anywhere in a text."""
    tok, mine = library("byte_bpe_50k.json"), bpe.ByteBPE(vocabulary("byte_bpe_50k.json"))
    assert np.frombuffer(mine.encode("a \xa0 \xa0 b"), "<u4").tolist() == [64, 11504, 275]
    rng = random.Random(7)
    bits = [" ", " ", " ", "\xa0", "\t", "\n", "\r\n", "\u3000", "\x85", "\x1c", "\u200b", "a", "b", "word", "don't", "12", "...", "é", "<|endoftext|>", "'s"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(100_000)]
    for t, want in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == want.ids, repr(t)


def test_bpe_long_words_and_any_ids():
    tok, mine = library("byte_bpe_50k.json"), bpe.load(vocabulary("byte_bpe_50k.json"))
    for t in ("ab" * 2000, "abcdefghijklmnop" * 100, "é" * 999):
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    ids = np.random.default_rng(0).integers(0, 50257, 5000)
    assert mine.decode(ids.astype("<u4").tobytes()) == tok.decode(ids.tolist(), skip_special_tokens=False)


def test_bpe_query(spark):
    tok = library("byte_bpe_50k.json")
    got = {r["doc_id"]: r for r in queries.op4_bpe(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = tok.encode(r["text"], add_special_tokens=False).ids
        g = got.pop(r["doc_id"])
        assert g["n_tokens"] == len(ids) and g["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not got


def test_words_equal_the_library():
    """Texts of letters, marks, digits and odd white space, by the library and by words."""
    tok, mine = library("word_bpe_49k.json"), library_words(vocabulary("word_bpe_49k.json"))
    rng = random.Random(11)
    bits = ["a", "The", "été", "l'eau", "don't", "x's", "'s", "'", "...", ",", ".", ", ", ". ", "!?", "###", "%%%", " ", "  ", "\n", "\t", "\xa0", "12", "3", "_", "<|endoftext|>", "<|", "|>", "日本", "ﬁ", "İ", "ß", "e\u0301", "$5,000", "\x85", "word", "(", ")", "¿", "µ", "ªº"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(20_000)]
    got = mine.encode_many(texts)
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(words, "CACHE_WORDS", 50)
    monkeypatch.setattr(words, "SLICE", 300)
    tok, mine = library("word_bpe_49k.json"), words.LibraryWords(vocabulary("word_bpe_49k.json"))
    rng = random.Random(3)
    texts = [" ".join(f"{rng.choice('abcdé')}{rng.randrange(400):x}{rng.choice(['', ',', '##'])}" for _ in range(rng.randrange(40))) for _ in range(300)]
    for t, ids in zip(texts, mine.encode_many(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    assert len(mine.known) < 500


def check_packed(rows, docs, tok, capacity):
    """Every id in exactly one piece, windows gapless and within the capacity."""
    want = defaultdict(list)
    for r in docs:
        want[r["doc_id"]].append(np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == want.keys()
    for k, ids in want.items():
        assert sum(p[1] for p in pieces[k]) == sum(map(len, ids)) // 4
        for start, length, crc, total in pieces[k]:
            assert any(total == len(x) // 4 and crc == zlib.crc32(x[4 * start : 4 * (start + length)]) for x in ids)
        if len(ids) == 1:
            at = 0
            for start, length, _, _ in sorted(pieces[k]):
                assert start == at and length > 0
                at += length
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= capacity
    used = sum(length for w in windows.values() for _, length in w)
    return 1 - used / (capacity * len(windows))


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(spark, capacity):
    rows = all_docs(spark)
    got = packing.pack_digests(frame(spark, rows).drop("length"), "doc_id", capacity=capacity).collect()
    assert check_packed(got, rows, library("word_bpe_49k.json"), capacity) < 0.05


def test_packing_with_ids_and_empty(spark):
    rows = all_docs(spark)
    got = packing.pack(documents(spark), "doc_id", capacity=100)
    assert got.columns == ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    for r in got.collect():
        assert len(r["ids"]) == 4 * r["length"]
    assert packing.pack(frame(spark, rows).where("false"), "doc_id").count() == 0
    bare = packing.pack(documents(spark), "doc_id", end_id=None).select("doc_id").distinct().collect()
    assert 0 not in {r["doc_id"] for r in bare} and 2 in {r["doc_id"] for r in bare}


def test_whole_windows_are_not_shuffled(spark):
    """Pieces that fill a window, or have no ids, get windows of their own; only the others go to groups."""
    rows = [(i, 4096 if i % 3 else 100 + i, i, "x") for i in range(300)] + [(300, 0, 1, "x")]
    pieces = packing.stored(spark.createDataFrame(rows, "doc_id long, length long, _group int, sequence string"), "pieces")
    got = packing.assign_windows(pieces).collect()
    assert sorted((r["doc_id"], r["length"], r["_group"], r["sequence"]) for r in got) == sorted(rows)
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(w == [(0, w[0][1])] for w in windows.values() if w[0][1] in (0, 4096))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(windows) == 200 + 1 + -(-sum(r[1] for r in rows if 0 < r[1] < 4096) // 4096)


def test_window_count_rises_until_all_fit():
    assert sorted(map(len, packing.windows_of(np.array([3, 3, 3]), 4))) == [1, 1, 1]  # nine of four would be three windows
    assert len(packing.windows_of(np.array([3, 3, 2]), 4)) == 3  # eight of four would be two
    rng = np.random.default_rng(2)
    for n in (1, 7, 60, 500):
        sizes = rng.integers(1, 100, n)
        windows = packing.windows_of(sizes, 100)
        assert sorted(i for w in windows for i in w) == list(range(n)) and max(sizes[w].sum() for w in windows) <= 100
        assert len(windows) <= 1.35 * sizes.sum() / 100 + 1


def test_cuts_cover_a_document():
    for n in (0, 1, 15, 16, 4095, 4096, 4097, 9000):
        for filler in (False, True):
            got = packing.cuts_of(n, 4096, filler)
            assert sum(got) == n and all(0 < x <= 4096 for x in got)
    assert packing.cuts_of(5000, 4096, True) == [4096, *packing.cuts_of(904, 4096, True)] and len(packing.cuts_of(904, 4096, True)) > 4


def test_padding_is_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack_digests(docs, "doc_id").agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("w")).first()
    assert got["n"] > 0.985 * 4096 * got["w"]


def test_differencing_is_a_partition():
    rng = np.random.default_rng(1)
    for n, k in ((0, 3), (1, 3), (5, 2), (50, 7), (200, 64)):
        sizes = rng.integers(1, 1000, n)
        parts = packing.differencing(sizes, k)
        assert len(parts) == k and sorted(i for p in parts for i in p) == list(range(n))
    sizes = rng.integers(1, 1000, 400)
    sums = [int(sizes[p].sum()) for p in packing.differencing(sizes, 4)]
    assert max(sums) - min(sums) <= 10
