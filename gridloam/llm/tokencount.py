"""Token counts from a cache that is keyed by digests of the content and of the tokenizer.

The cache is a Parquet table in partitions by the tokenizer's digest (of its file and the library's version), with the
sha256 of a normalised text (null is empty, otherwise its UTF-8 bytes as they are, as any other folding could change the
count) and its number of tokens. A table of texts is counted in three steps: the digests of all rows are joined to the
cache; of each digest that isn't there one text is encoded, and its count appended; all rows then get their counts from
the cache by their digests.

The texts of missing digests are the only ones that are shuffled, after each task has left out its repeats, so a text
that a third of the rows repeat is sent once by each task. In the last join frequent digests are broadcast
(`common.spread_join`). Writers that append the same digest at one time do no harm: readers take it once.

Null and empty texts have 0 bytes and 0 tokens. Rows without an id and repeated rows are counted like any other. An
empty table gives no rows and appends nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloam.llm.common import bounded_batches, fresh_dir, spread_join, stored, texts_of, tidy, vocabulary

MODEL, LIMIT = "piece_bpe_32k.model", 4096
#: Missing digests that are broadcast at most; more are joined by a shuffle.
BROADCAST_MISSES = 200_000
#: Digests that a task remembers before it forgets them, to leave out repeats ahead of the shuffle.
REMEMBERED = 200_000
#: Text bytes in a partition that is encoded.
PARTITION_BYTES = 32 << 20
#: Words that a worker's cache holds before it starts anew, and characters of text that are split at a time.
CACHE_WORDS, SLICE = 400_000, 4 << 20
#: New words that are encoded as one text.
TOGETHER = 256
CACHE = "digest binary, n_tokens long, tokenizer string"
_SPACES = re.compile(" ( +)")


class PieceCounts:
    """Token counts of a sentencepiece model, by words where its pieces never reach over a space or a line's end.

    That holds if no piece has a space other than in front and none has a line's end, and the model keeps white space
    as it is; `__init__` checks both. Then a text is a row of words, each with the spaces before it, that are
    encoded apart. Any other model gets whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        #: Whether a piece begins with a space, as a word's first one does and no other.
        self.begins = np.array([p.startswith("▁") for p in pieces])
        self.by_words = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and self._plain()
        self._forget()

    def _plain(self) -> bool:
        """Whether white space is kept and a space goes in front of each text."""
        whole = ["a", "a b", " a", "a  b\n", "\n\na \n b", " ", "a\n", "  \n  x  "]
        self._forget()
        return [len(self.sp.encode(t)) for t in whole] == self._count_words(whole)

    def _forget(self) -> None:
        self.known, self.sizes = pa.array([""], pa.large_string()), np.ones(1, np.int64)

    def count(self, texts: list[str]) -> list[int]:
        out, a, held = [], 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= SLICE or i + 1 == len(texts):
                part = texts[a : i + 1]
                out += self._count_words(part) if self.by_words else [len(x) for x in self.sp.encode(part, num_threads=1)]
                a, held = i + 1, 0
        return out

    def _count_words(self, texts: list[str]) -> list[int]:
        """Counts by words: those after one space or line's end; further spaces are part of the word, as the piece's sign."""

        def spaced(t: str) -> str:
            t = t.replace("▁", " ")  # the same to the model
            if "  " in t or t.startswith(" "):
                t = _SPACES.sub(lambda m: " " + "▁" * len(m[1]), " " + t)[1:]
            return t.replace("\n", " \n")

        words = pc.split_pattern(pa.array([spaced(t) for t in texts], pa.large_string()), " ")
        coded = pc.dictionary_encode(words.values)
        n = self._sizes(coded.dictionary)[coded.indices.to_numpy()]
        ends = np.concatenate(([0], np.cumsum(n)))[words.offsets.to_numpy()]
        return [int(c) if t else 0 for t, c in zip(texts, np.diff(ends), strict=True)]

    def _sizes(self, words: pa.Array) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self._forget()
        place = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = words.take(pa.array(new))
            made = self._learn(fresh.to_pylist())
            place[new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, fresh])
            self.sizes = np.concatenate([self.sizes, np.array(made, np.int64)])
        return self.sizes[place]


    def _learn(self, new: list[str]) -> list[int]:
        """Counts of new words; many plain ones are encoded as one text, where each begins with a piece of its own."""
        made: dict[str, int] = {}
        plain = [w for w in new if w and w[0] not in "▁\n"]
        for a in range(0, len(plain), TOGETHER):
            some = plain[a : a + TOGETHER]
            begins = self.begins[self.sp.encode(" ".join(some))]
            at = np.append(np.flatnonzero(begins), len(begins))
            if len(at) == len(some) + 1:
                made |= zip(some, np.diff(at).tolist(), strict=True)
        # the library puts a space in front of each, which a word after a line's end hasn't
        rest = [w for w in new if w not in made]
        made |= {w: len(ids) - w.startswith("\n") for w, ids in zip(rest, self.sp.encode(rest, num_threads=1), strict=True)}
        return [made[w] for w in new]


class LibraryCounts:
    """Token counts of a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()

    def count(self, texts: list[str]) -> list[int]:
        return [len(self.tok.encode(t, add_special_tokens=False)) for t in texts]


_loaded: dict[str, PieceCounts | LibraryCounts] = {}


def counter(path: str) -> PieceCounts | LibraryCounts:
    """One per worker and file; sentencepiece for .model, tokenizers for .json."""
    if path not in _loaded:
        _loaded[path] = PieceCounts(path) if path.endswith(".model") else LibraryCounts(path)
    return _loaded[path]


def tokenizer_digest(path: str) -> str:
    """sha256 of the file and of the version of the library that reads it."""
    from importlib.metadata import version

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    h = hashlib.sha256(f"{library} {version(library)}\n".encode())
    with open(path, "rb") as f:
        h.update(f.read())
    return h.hexdigest()


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer, each digest once. A cache that isn't there is empty."""
    try:
        table = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return table.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose digest the task hasn't had; it forgets when it has seen many."""
    seen: set[bytes] = set()
    for b in batches:
        if len(seen) > REMEMBERED:
            seen = set()
        new = []
        for d in b.column(0).to_pylist():
            new.append(d not in seen)
            seen.add(d)
        yield b.filter(pa.array(new))


def fill(df: DataFrame, rows: DataFrame, cache: str, text: str = "text", path: str | None = None) -> int:
    """Encode one text of each digest in `rows` (digest, n_bytes, n) that the cache lacks, append; their number."""
    spark, path = df.sparkSession, path or vocabulary(MODEL)
    tokenizer = tokenizer_digest(path)
    missing = stored(rows.join(cached(spark, cache, tokenizer), "digest", "left_anti").select("digest", "n_bytes"), "missing")
    misses, size = missing.agg(F.count("*"), F.sum("n_bytes")).first()
    if not misses:
        return 0
    texts = texts_of(df, text)
    texts = texts.select(content_digest(F.col("text")).alias("digest"), "text")
    if misses <= BROADCAST_MISSES:
        texts = texts.join(F.broadcast(missing.select("digest")), "digest", "left_semi")
    bounded_batches(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // PARTITION_BYTES))
    sent = texts.select("digest", "text").mapInArrow(tidy(_once), "digest binary, text string").repartition(parts, "digest")
    if misses > BROADCAST_MISSES and misses < rows.count():
        sent = sent.join(missing.select("digest").repartition(parts, "digest").hint("shuffle_hash"), "digest", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # a partition's digests: all of its texts' bytes are bounded
        for b in batches:
            at = []
            for i, d in enumerate(b.column(0).to_pylist()):
                if d not in seen:
                    seen.add(d)
                    at.append(i)
            b = b.take(pa.array(at, pa.int64()))
            n = counter(path).count(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    counts = sent.select("digest", "text").mapInArrow(tidy(run), "digest binary, n_tokens long")
    counts.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    return misses


def count(df: DataFrame, key: str = "doc_id", text: str = "text", cache: str | None = None, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """(<key>, n_bytes, n_tokens, over_limit) of every row; what the cache lacks is encoded once and appended.

    `cache` is a folder that the driver and all executors share; without one, the call has a new one of its own.
    """
    spark, path = df.sparkSession, path or vocabulary(MODEL)
    cache = cache or fresh_dir(spark, "token-counts")
    whole = texts_of(df, text, key).toDF("id", "text")
    rows = stored(whole.select("id", content_digest(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    distinct = stored(rows.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.count("*").alias("n")), "distinct")
    fill(df, distinct, cache, text, path)
    found = stored(cached(spark, cache, tokenizer_digest(path)).join(distinct.select("digest"), "digest", "left_semi"), "counts")
    out = spread_join(rows, found, "digest", distinct)
    return out.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
