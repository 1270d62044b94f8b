"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A document is the multiset of its shingles (five words in a row, A-Z folded; all words if fewer). A shingle weighs
tf x idf, idf = 1 + ln((N+1)/(df+1)) / ln(N+1), df and N over all documents. Two different texts are linked if
they meet in a band and their weighted Jaccard similarity, worked out exactly, is at least `SIMILARITY`; classes are
the connected components of the links, equal multisets being one node. A class's id is its smallest document id.

How: documents are read in chunks of some MB, in which equal texts are one. A chunk asks for the document
frequencies of its distinct shingles (`exchange`). A text whose shingles that other texts have weigh less than the
similarity times its whole weight cannot be linked and is done. The others are sampled: `BANDS` bands of `ROWS`
samples (k, t) each. Texts that meet in a band are candidates of one group (found by stars around each bucket's
smallest member, and their components), and a group's links are found by adding up minima over an inverted index of
its shingles; only the links that join texts not yet joined are kept. In a group that is too large for a task every text
is first held against the group's smallest member, one by one. Those that are linked to it are of one class, and are
compared with each other no more. The rest are dealt to blocks, and each of these is compared with every block of the
group in a task of its own; only that is quadratic, and only in what the rest are.

Null and empty texts have no shingle and are alone in their class, as are documents without an id (their class is
null). Repeated rows come back as often as they come in; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloam.llm.common import bounded_batches, fresh_dir, mix64, read_bytes, stored, texts_of, tidy, trim, word_hashes, write_bytes
from gridloam.llm.components import components
from gridloam.llm.exchange import BITS, buckets_for, cuts, grouped, loosen, pack_counts, pack_keys, squeeze, tasks_for, unpack_counts, unpack_keys

WORDS = 5
SIMILARITY = 0.8
#: Texts at the similarity miss each other in all bands once in a million; at 0.5 four in five meet, at 0.3 one in five.
BANDS = 26
ROWS = 4
CHUNK_BYTES = 6 << 20
#: Texts, and shingles, of a group that one task takes.
GROUP_TEXTS = 1024
GROUP_SHINGLES = 1_000_000
_SHIFT = np.uint64(64 - BITS)
_C = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: bytes, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle keys, times each) of a text."""
    w = word_hashes(raw, lower=True)
    if not len(w):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = min(words, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        h = (h + w[j : len(w) - n + 1 + j]) * (_C + np.uint64(2 * j))
    return np.unique(mix64(h + np.uint64(n)) >> _SHIFT, return_counts=True)


def fingerprint(keys: np.ndarray, times: np.ndarray) -> int:
    """63 bits that equal multisets share."""
    return int(mix64(np.array([mix64(keys * _C + times.astype(np.uint64)).sum() + np.uint64(len(keys))], np.uint64))[0] >> np.uint64(1))


class Chunk:
    """The different texts of a chunk's documents, their shingles, and which documents have each."""

    def __init__(self, texts: list[bytes], ids: list[list]):
        self.texts, self.ids = texts, ids
        found = [shingles(t) for t in texts]
        fps = [fingerprint(*f) for f in found]
        first: dict[int, int] = {}
        keep, docs = [], []
        for i, fp in enumerate(fps):  # texts that differ in white space or case only are one
            if fp in first and len(found[i][0]):
                docs[first[fp]] = docs[first[fp]] + ids[i]
                continue
            first[fp] = len(keep)
            keep.append(i), docs.append(ids[i])
        self.docs, self.fps = docs, np.array([fps[i] for i in keep], np.int64)
        self.size = np.array([len(found[i][0]) for i in keep], np.int64)
        every = np.concatenate([found[i][0] for i in keep]) if keep else np.zeros(0, np.uint64)
        self.tf = np.concatenate([found[i][1] for i in keep]) if keep else np.zeros(0, np.int64)
        self.keys, self.at = np.unique(every, return_inverse=True)
        many = np.array([len(d) for d in docs], np.int64)
        self.df = np.bincount(self.at, np.repeat(many, self.size), len(self.keys)).astype(np.int64)
        self.known = np.flatnonzero(self.size > 0)  # texts that have shingles
        marks = self.fps[self.known].astype(np.uint64) >> np.uint64(63 - BITS)
        self.order = np.argsort(marks, kind="stable")
        self.marks, self.many = marks[self.order], many[self.known][self.order]

    @classmethod
    def of_rows(cls, ids: list, texts: list[bytes]) -> Chunk:
        by: dict[bytes, list] = {}
        for i, t in zip(ids, texts, strict=True):
            by.setdefault(t, []).append(i)
        return cls(list(by), list(by.values()))

    def dump(self) -> bytes:
        head = json.dumps({"ids": self.ids, "sizes": [len(t) for t in self.texts]}).encode()
        return len(head).to_bytes(8, "little") + head + squeeze(b"".join(self.texts))

    @classmethod
    def load(cls, raw: bytes) -> Chunk:
        n = int.from_bytes(raw[:8], "little")
        head, every, texts, at = json.loads(raw[8 : 8 + n]), loosen(raw[8 + n :], np.uint8).tobytes(), [], 0
        for size in head["sizes"]:
            texts.append(every[at : at + size])
            at += size
        return cls(texts, head["ids"])


def samples(keys: np.ndarray, weights: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """n consistent weighted samples of each set: sets x n hashes of the chosen (key, level)."""
    size = np.diff(np.append(begin, len(keys)))
    log_w = np.log(weights)
    out = np.empty((len(begin), n), np.uint64)

    def uniform(i: int, j: int) -> np.ndarray:
        return ((mix64(keys * _C + np.uint64((5 * i + j + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)

    for i in range(n):
        r = -np.log(uniform(i, 0) * uniform(i, 1))
        c = -np.log(uniform(i, 2) * uniform(i, 3))
        beta = uniform(i, 4)
        t = np.floor(log_w / r + beta)
        a = np.log(c) - r * (t - beta) - r
        least = np.minimum.reduceat(a, begin)
        hit = np.flatnonzero(a == np.repeat(least, size))
        hit = hit[np.searchsorted(hit, begin)]  # the first in each set
        out[:, i] = mix64(keys[hit] * _C + t[hit].astype(np.int64).astype(np.uint64))
    return out


def bands_of(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """sets x bands long keys."""
    bands = sig.shape[1] // rows
    key = np.zeros((len(sig), bands), np.uint64)
    for j in range(rows):
        key = mix64(key * _C + sig[:, j : rows * bands : rows] + np.arange(bands, dtype=np.uint64))
    return (key >> np.uint64(1)).astype(np.int64)


def answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's totals, in each chunk's order; for texts also which chunk has each first."""
    out, bucket = [], int(pdf["bucket"].iloc[0])
    for level, part in pdf.groupby("level"):
        part = part.sort_values("chunk")
        keys = [unpack_keys(k) for k in part["keys"]]
        n = np.concatenate([unpack_counts(c) for c in part["counts"]])
        order, begin = grouped(keys)
        reply, owned = np.empty(len(n), np.int64), np.zeros(len(n), bool)
        reply[order] = np.repeat(np.add.reduceat(n[order], begin), np.diff(np.append(begin, len(n))))
        owned[order[begin]] = True
        at = 0
        for chunk, k in zip(part["chunk"], keys, strict=True):
            here = slice(at, at + len(k))
            out.append((bucket, int(level), int(chunk), pack_counts(reply[here]), squeeze(np.packbits(owned[here])) if level == 2 else None, int(n[here].sum())))
            at += len(k)
    trim()
    return pd.DataFrame(out, columns=["bucket", "level", "chunk", "counts", "owned", "total"])


def links(keys: list[np.ndarray], weights: list[np.ndarray], least: float, other: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) with a weighted Jaccard similarity of at least `least` that join sets not yet joined.

    With `other`, a flag for each set, only pairs of sets with different flags are looked for.
    """
    m = len(keys)
    size = np.array([len(k) for k in keys])
    col = np.unique(np.concatenate(keys), return_inverse=True)[1]
    w = np.concatenate(weights)
    row = np.repeat(np.arange(m), size)
    begin = np.cumsum(size) - size
    total = np.add.reduceat(w, begin)
    order = np.argsort(col, kind="stable")
    row_of, w_of = row[order], w[order]
    start = np.searchsorted(col[order], np.arange(int(col.max()) + 2))
    root = np.arange(m)
    joined = m
    # sets with many common shingles first: they join the most
    spread = np.add.reduceat(np.diff(start)[col] * w, begin)
    for i in np.argsort(-spread / total, kind="stable"):
        c = col[begin[i] : begin[i] + size[i]]
        n = start[c + 1] - start[c]
        at = np.repeat(start[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(row_of[at], np.minimum(w_of[at], np.repeat(w[begin[i] : begin[i] + size[i]], n)), m)
        near = np.flatnonzero(both >= (least - 1e-12) * (total[i] + total - both))
        for j in near.tolist():
            if root[j] != root[i] and (other is None or other[i] != other[j]):
                root[root == root[j]] = root[i]
                joined -= 1
                yield int(i), j
        if joined == 1:
            return


def unpack_vector(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, weights) of a stored vector."""
    cut = len(raw) - 8 * n
    return unpack_keys(raw[:cut]), np.frombuffer(raw, "<f8", n, cut)


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float) -> bool:
    """Whether the weighted Jaccard similarity is at least `least`."""
    i = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    hit = a[0][i] == b[0]
    both = np.minimum(a[1][i[hit]], b[1][hit]).sum()
    return bool(both >= (least - 1e-12) * (a[1].sum() + b[1].sum() - both))


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(key, class_id) of every row."""
    spark = df.sparkSession
    where = fresh_dir(spark, "neardup")
    rows = texts_of(df, text, key).select(F.col(key).cast("long").alias("id"), F.encode("text", "UTF-8").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, spread = buckets_for(size), tasks_for(spark, size)
    bounded_batches(spark)

    def read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            a, held = 0, 0
            for i, t in enumerate(texts):
                held += len(t)
                if held < chunk_bytes and i + 1 < len(texts):
                    continue
                number = part << 32 | made
                made += 1
                chunk = Chunk.of_rows(ids[a : i + 1], texts[a : i + 1])
                a, held = i + 1, 0
                write_bytes(f"{where}/{number}.chunk", chunk.dump())
                # every chunk asks the first bucket, if only with nothing, so that it gets an answer
                out = [(0, number, 2, b"", pack_counts(np.zeros(0, np.int64)))] if not len(chunk.marks) else []
                for level, keys, n in ((1, chunk.keys, chunk.df), (2, chunk.marks, chunk.many)):
                    at = cuts(keys, buckets)
                    out += [(b, number, level, pack_keys(keys[at[b] : at[b + 1]]), pack_counts(n[at[b] : at[b + 1]])) for b in range(buckets) if at[b] < at[b + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk", "level", "keys", "counts"])

    asked = rows.mapInArrow(tidy(read_chunks), "bucket int, chunk long, level int, keys binary, counts binary")
    answers = stored(asked.groupBy("bucket").applyInPandas(answer, "bucket int, level int, chunk long, counts binary, owned binary, total long"), "neardup-df")
    n_docs = answers.where("level = 2").agg(F.sum("total")).first()[0] or 0

    def sample(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk.load(read_bytes(f"{where}/{int(pdf['chunk'].iloc[0])}.chunk"))
        ones, twos = (pdf[pdf["level"] == v].sort_values("bucket") for v in (1, 2))
        out = [(i, fp if n else None, None, None, 0) for fp, n, docs in zip(chunk.fps.tolist(), chunk.size.tolist(), chunk.docs, strict=True) for i in docs]
        if len(chunk.known):
            df_ = np.concatenate([unpack_counts(c) for c in ones["counts"]])
            replies = [unpack_counts(c) for c in twos["counts"]]
            copies, first = np.empty(len(chunk.known), np.int64), np.empty(len(chunk.known), bool)
            copies[chunk.order] = np.concatenate(replies)
            first[chunk.order] = np.concatenate([np.unpackbits(loosen(o, np.uint8), count=len(r)).astype(bool) for o, r in zip(twos["owned"], replies, strict=True)])
            idf = 1 + np.log((n_docs + 1) / (df_ + 1)) / np.log(n_docs + 1)
            begin = (np.cumsum(chunk.size) - chunk.size)[chunk.known]
            w = chunk.tf * idf[chunk.at]
            mine = np.repeat(copies, chunk.size[chunk.known])
            shared = np.add.reduceat(np.where(df_[chunk.at] > mine, w, 0.0), begin)
            pick = np.flatnonzero(first & (shared >= (least - 1e-9) * np.add.reduceat(w, begin)))
            if len(pick):
                spans = [slice(begin[p], begin[p] + chunk.size[chunk.known[p]]) for p in pick]
                size = chunk.size[chunk.known[pick]]
                at = np.concatenate([np.arange(s.start, s.stop) for s in spans])
                keys = chunk.keys[chunk.at[at]]
                bands = bands_of(samples(keys, w[at], np.cumsum(size) - size, BANDS * ROWS))
                for p, s, b in zip(pick, spans, bands, strict=True):
                    out.append((None, int(chunk.fps[chunk.known[p]]), b.tolist(), pack_keys(chunk.keys[chunk.at[s]]) + w[s].astype("<f8").tobytes(), s.stop - s.start))
        return pd.DataFrame({"id": pd.array([r[0] for r in out], "Int64"), "fp": pd.array([r[1] for r in out], "Int64"), "bands": [r[2] for r in out], "vector": [r[3] for r in out], "n": [r[4] for r in out]})

    sampled = stored(answers.repartition(spread, "chunk").groupBy("chunk").applyInPandas(sample, "id long, fp long, bands array<long>, vector binary, n long"), "neardup-samples")
    members, vectors = sampled.where("bands is null").select("id", "fp"), sampled.where("bands is not null").select("fp", "bands", "vector", "n")
    met = vectors.select("fp", F.explode("bands").alias("band"))
    centre = met.groupBy("band").agg(F.min("fp").alias("centre"), F.count("*").alias("size")).where("size > 1").select("band", "centre")
    centre = stored(centre, "centres")  # so that the join has an exchange on either side and a large bucket is split
    stars = met.join(centre, "band").where("fp <> centre").select(F.col("fp").alias("u"), F.col("centre").alias("v"))
    groups = components(stars)
    vector = vectors.select("fp", "vector", "n")
    weight = groups.join(vectors.select(F.col("fp").alias("u"), "n"), "u").groupBy("root").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    large = (F.col("texts") > GROUP_TEXTS) | (F.col("shingles") > GROUP_SHINGLES)
    # stored, as are the tables below, so that the joins have an exchange on either side and a large group is split
    weight = stored(weight.select("root", large.alias("large")), "groups")
    placed = groups.join(weight, "root").select(F.col("u").alias("fp"), "root", "large")
    centres = stored(weight.where("large").join(vector.select(F.col("fp").alias("root"), F.col("vector").alias("c_vector"), F.col("n").alias("c_n")), "root").drop("large"), "hubs")

    def near_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, centre = None, None
        for batch in batches:
            near = []
            for root, v, n, c_v, c_n in zip(*(batch.column(c).to_pylist() for c in ("root", "vector", "n", "c_vector", "c_n")), strict=True):
                if root != held:
                    held, centre = root, unpack_vector(c_v, c_n)
                near.append(alike(centre, unpack_vector(v, n), least))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("fp", "root", "n")), pa.array(near, pa.bool_())], ["fp", "root", "n", "near"])

    bounded_batches(spark)
    hub = placed.where("large").select("fp", "root").join(vector, "fp").join(centres, "root")
    hub = stored(hub.select("fp", "root", "vector", "n", "c_vector", "c_n").mapInArrow(tidy(near_centre), "fp long, root long, n long, near boolean"), "near-centres")
    # blocks of half a task's texts: a task takes two
    size = lambda of: F.greatest(F.ceil(2 * F.count_if(of) / GROUP_TEXTS), F.ceil(2 * F.sum(F.when(of, F.col("n")).otherwise(0)) / GROUP_SHINGLES)).cast("int")
    blocks = stored(hub.groupBy("root").agg(size(F.col("near")).alias("nears"), size(~F.col("near")).alias("rests")), "blocks")
    mine = F.pmod(F.xxhash64("fp"), F.when(F.col("near"), F.col("nears")).otherwise(F.col("rests"))).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    task = lambda cross, a, b: F.struct(F.lit(cross).alias("cross"), a.alias("a"), b.alias("b"))
    with_rests = F.transform(upto("rests"), lambda x: task(True, x, F.col("block")))
    with_all = F.concat(F.transform(upto("nears"), lambda x: task(True, F.col("block"), x)), F.transform(upto("rests"), lambda x: task(False, F.least(F.col("block"), x), F.greatest(F.col("block"), x))))
    split = hub.join(blocks.where("rests > 0"), "root").withColumn("block", mine)
    split = split.select("fp", "root", "near", F.explode(F.when(F.col("near"), with_rests).otherwise(with_all)).alias("t")).select("fp", "root", "near", "t.*")
    whole = placed.where("not large").select("fp", "root", F.lit(False).alias("near"), F.lit(False).alias("cross"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    dealt = whole.unionByName(split).join(vector, "fp")

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp", kind="stable").drop_duplicates("fp")
        each = [unpack_vector(v, n) for v, n in zip(pdf["vector"], pdf["n"], strict=True)]
        fps = pdf["fp"].to_numpy()
        other = pdf["near"].to_numpy(bool) if pdf["cross"].iloc[0] else None
        found = [(int(fps[i]), int(fps[j])) for i, j in links([k for k, _ in each], [w for _, w in each], least, other)] if len(pdf) > 1 else []
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    found = dealt.groupBy("root", "cross", "a", "b").applyInPandas(joined, "u long, v long")
    linked = components(found.unionByName(hub.where("near and fp <> root").select(F.col("fp").alias("u"), F.col("root").alias("v"))))
    named = members.join(linked.withColumnRenamed("u", "fp"), "fp", "left").select("id", F.coalesce("root", "fp").alias("root"))
    # stored, so that the join has an exchange on either side and a large class is split
    least_id = stored(named.where("root is not null").groupBy("root").agg(F.min("id").alias("class_id")), "classes")
    return named.join(least_id, "root", "left").select(F.col("id").alias(key), F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"))
