"""Packing of token sequences into windows of a fixed capacity, by Karmarkar-Karp multiway differencing.

A document's ids are cut into pieces of at most a window; pieces that fill one are windows themselves. The last,
shorter pieces are packed together. So that differencing has small pieces to even things out with, one short piece in
every `FILL_WINDOWS` windows' worth of ids gives up part of its end: a quarter window, an eighth, and so on.

The pieces are dealt at random (by a hash of the row number) to groups of about `GROUP_WINDOWS` windows. In a group
each piece starts as a partial partition of k parts of which one is filled; the two partitions with the largest
differences are merged, the fullest parts of one with the emptiest of the other, until one is left. Its parts are
the windows. k is first the least number that can hold the total; whenever a window exceeds the capacity, k rises by
one and the group is packed again.

Null texts count as empty and give the end id alone; without an end id an empty text has no ids and so no piece.
Repeated rows are packed as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloam.llm.common import bounded_batches, stored, texts_of, tidy, vocabulary
from gridloam.llm.words import library_words

CAPACITY = 4096
GROUP_WINDOWS = 256
#: One short piece in this many windows' worth of ids is cut into smaller ones.
FILL_WINDOWS = 2


def differencing(sizes: np.ndarray, k: int) -> list[list[int]]:
    """k lists of indices into sizes with near-equal sums: multiway Karmarkar-Karp, largest difference first.

    Only the parts that hold something are stored, fullest first, as (minus the sum, number, tree of indices);
    the others are empty.
    """
    if k <= 0 or not len(sizes):
        return [[] for _ in range(max(k, 0))]
    heap = [(-s, i, [(-s, i, i)]) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heap[0][2]
        if len(b) > len(a):
            a, b = b, a
        n += 1
        if len(b) == 1 and len(a) == k:
            s, _, x = a.pop()
            t, _, y = b[0]
            insort(a, (s + t, n, (x, y)))
        else:
            # the fullest parts of b take the empty parts of a, the next ones its emptiest that hold something
            free, held = k - len(a), len(a)
            for j, (t, _, y) in enumerate(b[free:]):
                s, u, x = a[held - 1 - j]
                a[held - 1 - j] = (s + t, u, (x, y))
            a += b[:free]
            a.sort()
        least = a[-1][0] if len(a) == k else 0
        heapq.heapreplace(heap, (a[0][0] - least, n, a))
    parts = []
    for _, _, tree in heap[0][2]:
        stack, items = [tree], []
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                items.append(x)
        parts.append(sorted(items))
    return parts + [[] for _ in range(k - len(parts))]


def windows_of(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows of pieces (indices into sizes) with sums of at most the capacity; the count rises until all fit."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        parts = differencing(sizes, k)
        if all(sizes[p].sum() <= capacity for p in parts):
            return [p for p in parts if p]
        k += 1


def cuts_of(length: int, capacity: int, filler: bool) -> list[int]:
    """Lengths of the pieces of a document; with `filler` the last short one gives up part of its end."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    tail = []
    if filler:
        part = min(capacity // 4, rest // 2)
        while part >= max(1, capacity // 256):
            tail.append(part)
            rest -= part
            part //= 2
    return out + [x for x in (rest, *tail) if x]


def cut_pieces(df: DataFrame, key: str, text: str = "text", capacity: int = CAPACITY, end_id: int | None = 2, path: str | None = None, digests: bool = False) -> DataFrame:
    """(key, start, length, doc_tokens, ids): every text's ids with the end id, in pieces of at most the capacity.

    With `digests` it is their crc32 (`ids_crc32`) in place of the ids.
    """
    path = path or vocabulary("word_bpe_49k.json")
    end = np.array([] if end_id is None else [end_id], np.uint32).tobytes()

    name = "ids_crc32" if digests else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0  # ids in short pieces so far
        for b in batches:
            row, start, length, total, ids = [], [], [], [], []
            for i, got in enumerate(library_words(path).encode_many(b.column(1).to_pylist())):
                got += end
                n, at, before = len(got) // 4, 0, held
                held += n % capacity
                filler = held // (FILL_WINDOWS * capacity) > before // (FILL_WINDOWS * capacity)
                for size in cuts_of(n, capacity, filler):
                    row.append(i), start.append(at), length.append(size), total.append(n)
                    piece = got[4 * at : 4 * (at + size)]
                    ids.append(zlib.crc32(piece) if digests else piece)
                    at += size
            columns = [b.column(0).take(pa.array(row, pa.int64()))]
            columns += [pa.array(c, pa.int64()) for c in (start, length, total)]
            columns.append(pa.array(ids, pa.int64() if digests else pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [key, "start", "length", "doc_tokens", name])

    bounded_batches(df.sparkSession)
    df = texts_of(df, text, key)
    kind = df.schema[0].dataType.simpleString()
    return df.mapInArrow(tidy(run), f"`{key}` {kind}, start long, length long, doc_tokens long, {name} {'long' if digests else 'binary'}")


def assign_windows(pieces: DataFrame, capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Windows of pieces: (all columns of the pieces, sequence_id, offset).

    The rows are read several times (for their total, then to pack), so give a stored table. Whole windows, and pieces of
    no ids, are numbered where they lie; only short pieces are shuffled, dealt to groups by their numbers. Equal rows have
    different numbers, so they are spread like any others.
    """
    name = "_group"
    while name in pieces.columns:
        name = f"_{name}"
    part = (F.col("length") < capacity) & (F.col("length") > 0)
    total = pieces.where(part).agg(F.sum("length").alias("n")).first()["n"] or 0
    groups = max(1, round(total / (capacity * group_windows)))
    dealt = pieces.where(part).withColumn(name, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf["length"].to_numpy(np.int64)
        seq, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for n, at in enumerate(windows_of(size, capacity)):
            seq[at] = n
            offset[at] = np.cumsum(size[at]) - size[at]
        out = pdf.drop(columns=name)
        out["sequence_id"] = pdf[name].to_numpy(np.int64) * (1 << 32) + seq
        out["offset"] = offset
        return out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    short = dealt.groupBy(name).applyInPandas(run, fields + ", sequence_id long, offset long")
    # beyond the numbers of any group
    whole = pieces.where(~part).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    return short.unionByName(whole)


def pack(df: DataFrame, key: str, text: str = "text", capacity: int = CAPACITY, end_id: int | None = 2, path: str | None = None) -> DataFrame:
    """(key, start, length, doc_tokens, ids, sequence_id, offset): the pieces with their ids and their windows."""
    return assign_windows(stored(cut_pieces(df, key, text, capacity, end_id, path), "pieces"), capacity)


def pack_digests(df: DataFrame, key: str, text: str = "text", capacity: int = CAPACITY, end_id: int | None = 2, path: str | None = None) -> DataFrame:
    """`pack` with the crc32 of each piece's ids in their place; no ids are moved."""
    return assign_windows(stored(cut_pieces(df, key, text, capacity, end_id, path, digests=True), "pieces"), capacity)
