"""Token files compressed by Re-Pair: frequent id pairs become nonterminals, shard by shard.

Documents are sorted by id into shards; a shard is written in blocks of about `BLOCK_TOKENS` ids, each a file that
can be decoded alone. In a block the pairs of adjacent symbols are counted exactly; every pair that comes `LEAST`
times or more, without overlaps, is frequent. Where occurrences of two frequent pairs share a symbol the more frequent
pair has it. Pairs that are still frequent then get a nonterminal each and are replaced all at once; this goes on until
no pair is frequent. Symbols are a linked list in typed arrays: after the first round only the positions beside a
replacement, and those of frequent pairs that had to yield, are looked at again, as no other pair can gain. No pair
reaches over the end of a document, so a document can be decoded by itself.

File format (little-endian): magic b"RPR1"; uint32 first nonterminal, rules, documents, symbols; uint8 bytes a
symbol; then rules x (uint32 left, uint32 right), rules x uint32 expansion length, documents x int64 id (and one
byte each telling a null id), (documents + 1) x uint32 first symbol, (documents + 1) x uint64 first token, symbols.

Null and empty texts give the end id alone; repeated ids stand side by side, in the order of their texts' hashes;
null ids come first; an empty table gives no file and no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloam.llm.common import bounded_batches, fresh_dir, partitions_for, read_bytes, stored, texts_of, trim, vocabulary, write_bytes
from gridloam.llm.words import library_words

MAGIC = b"RPR1"
BLOCK_TOKENS = 1_500_000
#: Bytes of ids that a task reads from files.
READ_BYTES = 32 << 20
LEAST = 16
FILES = "part long, block long, file string, n_docs long, n_tokens long"
_BITS = 18
_PHI = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)


def numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key, key of each number): equal keys share a number; some numbers are of no key.

    A key's number is its cell in a hash table; keys whose cell another one holds are sorted and numbered beyond it.
    """
    bits = min(_BITS, max(8, len(key).bit_length()))
    number = ((key * _PHI) >> np.uint64(64 - bits)).astype(np.intp)
    kinds = np.zeros(1 << bits, np.uint64)
    kinds[number] = key
    odd = np.flatnonzero(kinds[number] != key)
    if len(odd):
        more, at = np.unique(key[odd], return_inverse=True)
        number[odd] = (1 << bits) + at
        kinds = np.concatenate([kinds, more])
    return number, kinds


def every_other(at: np.ndarray, after: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Indices into `at` of the pairs of two equal symbols that overlap the one before: every other of a run."""
    i = np.flatnonzero(same)
    follow = np.zeros(len(i), bool)
    follow[1:] = (i[1:] == i[:-1] + 1) & (after[i[:-1]] == at[i[1:]])
    if not follow.any():
        return i[:0]
    place = np.arange(len(i))
    begin = np.maximum.accumulate(np.where(follow, 0, place))
    return i[((place - begin) & 1) == 1]


def compress(tokens: np.ndarray, ends: np.ndarray, first: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, last-of-a-document flags, rules) of ids of which `ends` flags each document's last."""
    n, made, rules = len(tokens), 0, []
    seq = tokens.astype(np.uint32)
    if n < 2:
        return seq, ends.copy(), np.zeros((0, 2), np.uint32)
    # a pair can only be frequent where the cell of its hash is
    cell = ((seq[:-1] * np.uint32(0x9E3779B1) ^ seq[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - _BITS)).astype(np.intp)
    full = (np.bincount(cell, minlength=1 << _BITS) >= least)[cell]
    at = np.flatnonzero(full & ~ends[:-1])
    del cell, full
    nxt = np.arange(1, n + 1)
    nxt[ends] = -1
    prv = np.arange(-1, n - 1)
    prv[1:][ends[:-1]] = -1
    live, again = np.ones(n, bool), np.zeros(n, bool)
    while len(at):
        after = nxt[at]
        left, right = seq[at], seq[after]
        put_off = every_other(at, after, left == right)
        if len(put_off):
            keep = np.ones(len(at), bool)
            keep[put_off] = False
            put_off = at[put_off]
            at, after, left, right = at[keep], after[keep], left[keep], right[keep]
        which, kinds = numbered(left.astype(np.uint64) << _HALF | right)
        times = np.bincount(which, minlength=len(kinds))
        often = np.flatnonzero(times >= least)
        if not len(often):
            break
        # ties by a hash, so that a passage that repeats is halved each round rather than folded up from one end
        often = often[np.lexsort((kinds[often] * np.uint64(0xBF58476D1CE4E5B9), -times[often]))]
        rank = np.full(len(kinds), len(often), np.int32)
        rank[often] = np.arange(len(often), dtype=np.int32)
        rank = rank[which]
        keep = np.flatnonzero(rank < len(often))
        at, after, rank = at[keep], after[keep], rank[keep]
        touch = np.flatnonzero(after[:-1] == at[1:])
        earlier = rank[touch] < rank[touch + 1]
        win = np.ones(len(at), bool)
        win[touch[~earlier]] = False
        win[touch[earlier] + 1] = False
        good = np.flatnonzero(np.bincount(rank[win], minlength=len(often)) >= least)
        number = np.full(len(often), -1, np.int32)
        number[good] = np.arange(len(good), dtype=np.int32)
        number = number[rank]
        win = np.flatnonzero(win & (number >= 0))  # of the first in rank all, so every round replaces something
        pos, gone = at[win], after[win]
        follow = nxt[gone]
        has = follow >= 0
        seq[pos] = number[win] + (first + made)
        nxt[pos], live[gone] = follow, False
        prv[follow[has]] = pos[has]
        made += len(good)
        rules.append(kinds[often[good]])
        again[at] = again[put_off] = True
        again[pos] = has
        before = prv[pos]
        again[before[before >= 0]] = True
        again[gone] = False
        at = np.flatnonzero(again)
        again[at] = False
    kinds = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    return seq[live], (nxt < 0)[live], np.stack([kinds >> _HALF, kinds & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)


def expansions(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(all expansions one after the other, start of each and the end of the last)."""
    out: list[tuple[int, ...]] = []
    for a, b in rules.tolist():
        out.append((out[a - first] if a >= first else (a,)) + (out[b - first] if b >= first else (b,)))
    start = np.zeros(len(out) + 1, np.int64)
    np.cumsum([len(x) for x in out], out=start[1:])
    return np.fromiter(chain.from_iterable(out), np.uint32, int(start[-1])), start


def expand(seq: np.ndarray, table: np.ndarray, start: np.ndarray, first: int) -> np.ndarray:
    """Token ids of symbols."""
    at = np.flatnonzero(seq >= first)
    rule = seq[at].astype(np.int64) - first
    size = np.ones(len(seq), np.int32)
    size[at] = np.diff(start)[rule]
    to = np.cumsum(size, dtype=np.int64)
    shift = np.arange(len(seq), dtype=np.int64)
    shift[at] = len(seq) + start[rule]
    shift -= to - size
    n = int(to[-1]) if len(to) else 0
    small = np.int32 if max(n, len(seq) + len(table)) < 1 << 31 else np.int64
    return np.concatenate([seq.astype(np.uint32), table])[np.repeat(shift.astype(small), size) + np.arange(n, dtype=small)]


def encode_block(ids: list[int | None], docs: list[bytes], first: int) -> bytes:
    """A file of documents' ids (each as little-endian unsigned 32-bit integers)."""
    size = np.array([len(d) // 4 for d in docs], np.int64)
    tokens = np.frombuffer(b"".join(docs), "<u4")
    ends = np.zeros(len(tokens), bool)
    ends[np.cumsum(size)[size > 0] - 1] = True
    seq, last, rules = compress(tokens, ends, first)
    length = np.diff(expansions(rules, first)[1])
    of = np.cumsum(size > 0)
    ends_at = np.concatenate(([0], np.flatnonzero(last) + 1))
    width = 2 if first + len(rules) <= 1 << 16 else 4
    return b"".join(
        [
            MAGIC,
            struct.pack("<IIIIB", first, len(rules), len(docs), len(seq), width),
            rules.astype("<u4").tobytes(),
            length.astype("<u4").tobytes(),
            np.array([x or 0 for x in ids], "<i8").tobytes(),
            bytes(x is None for x in ids),
            ends_at[np.concatenate(([0], of))].astype("<u4").tobytes(),
            np.concatenate(([0], np.cumsum(size))).astype("<u8").tobytes(),
            seq.astype(f"<u{width}").tobytes(),
        ]
    )


class Block:
    """A file's contents; any document or range of tokens can be had without decoding the rest."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a Re-Pair token file")
        self.first, n_rules, n_docs, n_symbols, width = struct.unpack_from("<IIIIB", raw, 4)
        at = 4 + struct.calcsize("<IIIIB")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.length = take("<u4", n_rules)
        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)]
        self.symbol = take("<u4", n_docs + 1).astype(np.int64)
        self.token = take("<u8", n_docs + 1).astype(np.int64)
        self.seq = take(f"<u{width}", n_symbols)
        self.table, self.begin = expansions(self.rules, self.first)

    def document(self, i: int) -> np.ndarray:
        return expand(self.seq[self.symbol[i] : self.symbol[i + 1]], self.table, self.begin, self.first)

    def documents(self) -> Iterator[np.ndarray]:
        every = expand(self.seq, self.table, self.begin, self.first)
        return (every[a:b] for a, b in zip(self.token[:-1], self.token[1:], strict=True))

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b of the block; only the symbols that cover them are expanded, found by expansion lengths."""
        size = np.ones(len(self.seq), np.int64)
        rule = self.seq >= self.first
        size[rule] = self.length[self.seq[rule] - self.first]
        ends = np.cumsum(size)
        b = min(b, int(ends[-1]) if len(ends) else 0)
        if a >= b:
            return np.zeros(0, np.uint32)
        i, j = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left") + 1
        skip = a - int(ends[i] - size[i])
        return expand(self.seq[i:j], self.table, self.begin, self.first)[skip : skip + b - a]


def write(df: DataFrame, key: str, where: str, text: str = "text", end_id: int | None = 1, path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Encode whole texts, sort by key and write them; a table of the files (`FILES`), also under `where`.

    The texts are dealt by ranges of the key once; ids are made, compressed and written in the tasks that get them.
    Files are numbered by partition and block, so a task that runs again writes the same names.
    """
    path = path or vocabulary("word_bpe_49k.json")
    end = np.array([] if end_id is None else [end_id], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, ids, docs, held = TaskContext.get().partitionId(), 0, [], [], 0
        words = library_words(path)
        first = words.tok.get_vocab_size()
        first += first % 2

        def block():
            nonlocal made, ids, docs, held
            name = f"{where}/{part:06d}-{made:06d}.rpr"
            write_bytes(name, encode_block(ids, docs, first))
            row = {"part": [part], "block": [made], "file": [name], "n_docs": [len(docs)], "n_tokens": [held]}
            made, ids, docs, held = made + 1, [], [], 0
            trim()
            return pa.RecordBatch.from_pydict(row)

        for b in batches:
            for i, got in zip(b.column(0).to_pylist(), words.encode_many(b.column(1).to_pylist()), strict=True):
                ids.append(i), docs.append(got + end)
                held += len(docs[-1]) // 4
                if held >= block_tokens:
                    yield block()
        if docs:
            yield block()

    spark = df.sparkSession
    parts = partitions_for(df)
    df = texts_of(df, text, key).withColumn(key, F.col(key).cast("long")).withColumn("_tie", F.xxhash64("text"))
    ordered = df.repartitionByRange(parts, key, "_tie").sortWithinPartitions(key, "_tie").drop("_tie")
    bounded_batches(spark)
    return stored(ordered.mapInArrow(run, FILES), "repair-files")


def read(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, ids) of every document in the files of `write`; start counts the ids of all documents before it."""
    # a running sum over the partitions' totals, then one within each partition
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part")
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens")
    placed = files.withColumn("_within", within).join(parts.select("part", before.alias("_before")), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block = Block(read_bytes(name))
                every = np.ascontiguousarray(expand(block.seq, block.table, block.begin, block.first), "<u4")
                for i in range(0, len(block.ids), 1000):
                    j = min(i + 1000, len(block.ids))
                    at = block.token[i : j + 1]
                    sizes, body = ((at - at[0]) * 4).astype(np.int32), every[at[0] : at[-1]]
                    ids = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(sizes), pa.py_buffer(body)])
                    columns = [pa.array(block.ids[i:j], pa.int64()), pa.array(at[:-1] + start), ids]
                    yield pa.RecordBatch.from_arrays(columns, [key, "start", "ids"])

    # by the ids that the files hold, not by the size of their list
    total = parts.agg(F.sum("n")).first()[0] or 0
    spread = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-4 * total // READ_BYTES))
    dealt = placed.select("file", (F.col("_before") + F.col("_within")).alias("start")).repartition(spread)
    return dealt.mapInArrow(run, f"`{key}` long, start long, ids binary")


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, n_tokens, ids_crc32): all documents written to the shared folder and read back."""
    back = read(write(df, key, fresh_dir(df.sparkSession, "repair"), text), key)
    return back.select(key, "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
