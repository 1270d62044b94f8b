"""Byte-level BPE encoding and decoding, by a contiguous rank array per short word.

A word's part boundaries and the ranks of its adjacent pairs lie in two plain arrays. The smallest rank is found
by a scan, its boundary deleted and the two neighbouring ranks refreshed, until no pair can merge. A word over
`LONG` bytes, where scans would be quadratic, takes the same merges from a heap instead.

Defined results: null and empty texts give no ids; a text that holds a special token's string gives that token;
decoding replaces invalid UTF-8, as the library does; repeated rows each give a row; other columns are left out.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloam.llm.common import bounded_batches, texts_of, vocabulary

LONG = 256
NONE = 1 << 60
#: The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks and words that a worker's caches hold before they start afresh.
CACHE_WORDS = 300_000


def byte_names() -> list[str]:
    """The printable character by which a byte-level vocabulary names each byte: itself, or the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = iter(range(256, 512))
    return [chr(b if b in plain else next(odd)) for b in range(256)]


class ByteBPE:
    """Vocabulary, merges and special tokens of a byte-level tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        names = byte_names()
        self.of_byte = [vocab[c] for c in names]
        value = {c: b for b, c in enumerate(names)}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for word, i in vocab.items():
            self.bytes_of[i] = bytes(value[c] for c in word) if all(c in value for c in word) else word.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for word, i in self.special.items():
            self.bytes_of[i] = word.encode()
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 32 | vocab[b]] = k
            self.made.append(vocab[a + b])
        self.words = regex.compile(PATTERN)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        parts = [self.of_byte[b] for b in word]
        if len(parts) > LONG:
            return self._merge_long(parts)
        rank, made = self.rank.get, self.made
        ranks = [rank(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            parts[i] = made[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 32 | parts[i + 1], NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.rank.get
        after, before, live = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], live[j] = self.made[r], False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (m := after[k]) >= 0 and (s := rank(parts[k] << 32 | parts[m])) is not None:
                    heapq.heappush(heap, (s, k, parts[k], parts[m]))
        return [p for p, x in zip(parts, live, strict=True) if x]

    def _word(self, word: str) -> bytes:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            got = self.cache[word] = np.array(self.merge(word.encode()), np.uint32).tobytes()
        return got

    def _run(self, text: str) -> bytes:
        return b"".join(map(self._word, self.words.findall(text)))

    def _plain(self, text: str) -> bytes:
        # A space between two characters that are no white space starts a pre-token, and none reaches over it; so the
        # text falls apart there. Runs of white space, which pre-tokens divide otherwise, stay within their part.
        head, *rest = text.split(" ")
        if not rest:
            return self._run(head)
        got = list(map(self.chunks.get, rest))
        if None in got:
            if len(self.chunks) > CACHE_WORDS:
                self.chunks.clear()
            for i, g in enumerate(got):
                if g is None:
                    x = rest[i]
                    if not x or x[0].isspace() or x[-1].isspace():
                        return self._mixed([head, *rest])
                    got[i] = self.chunks[x] = self._run(" " + x)
        if not head or head[-1].isspace():
            return self._mixed([head, *rest])
        return b"".join([self._run(head), *got])

    def _mixed(self, parts: list[str]) -> bytes:
        """Ids of parts with a space between each two, of which some are empty or have other white space at an end."""
        out, a, n = [], 0, len(parts)
        for i in range(1, n + 1):
            if i < n and (not parts[i - 1] or parts[i - 1][-1].isspace() or not parts[i] or parts[i][0].isspace()):
                continue
            if i - a > 1 or not a:
                out.append(self._run((" " if a else "") + " ".join(parts[a:i])))
            else:
                x = parts[a]
                got = self.chunks.get(x)
                if got is None:
                    got = self._run(" " + x)
                    if x and not x[0].isspace() and not x[-1].isspace():
                        self.chunks[x] = got
                out.append(got)
            a = i
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.at_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.at_special.split(text)
        return b"".join(np.uint32(self.special[p]).tobytes() if p in self.special else self._plain(p) for p in parts if p)

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """One per worker and file."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def _mapped(df: DataFrame, key: str, kind, column: str, ddl: str, f) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [f(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], [key, column])

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, f"`{key}` {df.schema[0].dataType.simpleString()}, {column} {ddl}")


def encode(df: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): every whole text's ids as little-endian unsigned 32-bit integers. No shuffle."""
    path = path or vocabulary("byte_bpe_50k.json")
    return _mapped(texts_of(df, text, key), key, pa.binary(), "ids", "binary", lambda t: load(path).encode(t))


def decode(df: DataFrame, key: str, ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text): the text of every row's ids; null ids give an empty text. No shuffle."""
    path = path or vocabulary("byte_bpe_50k.json")
    return _mapped(df.select(key, F.coalesce(F.col(ids), F.lit(b"")).alias("ids")), key, pa.string(), "text", "string", lambda t: load(path).decode(t))


def with_decoded(df: DataFrame, key: str, ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, ids, text): `decode`, keeping the ids beside the text."""
    path = path or vocabulary("byte_bpe_50k.json")

    def run(batches):
        for b in batches:
            t = load(path)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t.decode(x) for x in b.column(1).to_pylist()], pa.string())], [key, "ids", "text"])

    bounded_batches(df.sparkSession)
    df = df.select(key, F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))
    return df.mapInArrow(run, f"`{key}` {df.schema[0].dataType.simpleString()}, ids binary, text string")
