"""Katz backoff language model over words, counted and evaluated without a table of words on any machine.

Tokens are words between ASCII white space, A-Z folded, and one end for each text; the model has n-grams of up to
`ORDER` tokens, with one beginning as the first history. At every level counts up to `GOOD_TURING` are discounted by
Good-Turing. What that frees after a history h goes to the tokens not seen after it, by the next lower level, with the
backoff weight alpha(h) = (1 - sum of seen P(w|h)) / (1 - sum of their lower-level P), exact for each history; so

    P(w|h) = discounted count / count(h) if hw was seen, alpha(h) P(w|h') if h was, and P(w|h') otherwise,

h' being h without its first token, down to the unigrams. What these free is the probability of the one unknown word.
Where a history frees nothing (all its followers are undiscounted) its counts are scaled by c/(c+1), so that no text
has probability zero.

How: documents are read in chunks of some MB. A chunk's state (its distinct words, and its texts as indices into them)
goes to a file in the shared folder. Level by level a chunk asks for the counts of its distinct n-grams (`exchange`);
the answers are a table for each level, in partitions by bucket of the key. With a count comes whether other chunks
have that n-gram too: if not, all that follows it is known in the chunk, and nothing longer is asked. Each seen n-gram
is owned by one chunk, which adds to its history what it frees and its lower-level probability; those sums are a table
in partitions by bucket of the history. Only the histories from which some token backs off are looked up there, or
whose followers may all be undiscounted. All counts cover all training documents; keys are 56-bit hashes.

Null texts are empty: one token, the end. Without a training document every probability is one. Rows repeat as
often as they come; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloam.llm.common import bounded_batches, fresh_dir, mix64, read_bytes, stored, texts_of, tidy, trim, word_hashes, write_bytes
from gridloam.llm.exchange import (
    BITS,
    buckets_for,
    cuts,
    grouped,
    loosen,
    pack_counts,
    pack_flags,
    pack_keys,
    squeeze,
    tasks_for,
    unpack_counts,
    unpack_flags,
    unpack_keys,
)

ORDER = 3
GOOD_TURING = 5
CHUNK_BYTES = 8 << 20
_SHIFT = np.uint64(64 - BITS)
END = np.uint64(0x656E642E6F66)
BEGIN = np.uint64(0x626567696E)


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(h * np.uint64(0x9E3779B97F4A7C15) + w) >> _SHIFT


class Level:
    """A chunk's distinct n-grams of one length, sorted by key."""

    def __init__(self, keys, at, history=None, suffix=None):
        #: `at`: the n-gram that ends at each token, -1 where none does; `history` and `suffix`: n-grams one shorter
        self.keys, self.at, self.history, self.suffix = keys, at, history, suffix


class Chunk:
    """Distinct words (sorted keys) and texts as indices into them; longer n-grams are worked out when asked for."""

    def __init__(self, keys: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, learn: np.ndarray, ids: list):
        self.keys, self.tokens, self.sizes, self.learn, self.ids = keys, tokens, sizes, learn, ids
        self.ends = np.cumsum(sizes)
        self.first = self.ends - sizes
        self.learned = np.repeat(learn, sizes)
        self.levels = [None, Level(keys, tokens)]

    @classmethod
    def of_texts(cls, texts: list[bytes], learn: np.ndarray, ids: list) -> Chunk:
        words = [np.append(word_hashes(t, lower=True) >> _SHIFT, END) for t in texts]
        keys, tokens = np.unique(np.concatenate(words), return_inverse=True)
        return cls(keys, tokens.astype(np.int32), np.array([len(w) for w in words], np.int64), learn, ids)

    def level(self, k: int) -> Level:
        """The n-grams of k tokens, a beginning counting as one; the last history of level 1 is the beginning."""
        while len(self.levels) <= k:
            n, below = len(self.levels), self.levels[-1]
            before = np.empty(len(self.tokens), np.int64)
            before[1:] = below.at[:-1]
            before[self.first] = len(below.keys) if n == 2 else -1
            place = np.flatnonzero(before >= 0)
            hashes = np.append(below.keys, BEGIN) if n == 2 else below.keys
            key = pair_keys(hashes[before[place]], self.keys[self.tokens[place]])
            keys, one, which = np.unique(key, return_index=True, return_inverse=True)
            at = np.full(len(self.tokens), -1, np.int32)
            at[place] = which
            self.levels.append(Level(keys, at, before[place[one]], below.at[place[one]].astype(np.int64)))
        return self.levels[k]

    def dump(self) -> bytes:
        # tokens by how often they come, a byte plane after the other, are small; the order follows from the counts
        often = np.bincount(self.tokens, minlength=len(self.keys))
        rank = np.empty(len(often), "<u4")
        rank[np.argsort(-often, kind="stable")] = np.arange(len(often))
        planes = np.ascontiguousarray(rank[self.tokens].view(np.uint8).reshape(-1, 4).T)
        parts = [pack_keys(self.keys), pack_counts(often), squeeze(planes), squeeze(self.sizes.astype("<i8")), squeeze(self.learn.astype(np.uint8)), json.dumps(self.ids).encode()]
        return b"".join(len(p).to_bytes(8, "little") + p for p in parts)

    @classmethod
    def load(cls, raw: bytes) -> Chunk:
        parts, at = [], 0
        while at < len(raw):
            n = int.from_bytes(raw[at : at + 8], "little")
            parts.append(raw[at + 8 : at + 8 + n])
            at += 8 + n
        order = np.argsort(-unpack_counts(parts[1]), kind="stable").astype(np.int32)
        rank = np.ascontiguousarray(loosen(parts[2], np.uint8).reshape(4, -1).T).view("<u4").ravel()
        return cls(unpack_keys(parts[0]), order[rank], loosen(parts[3], "<i8"), loosen(parts[4], np.uint8).astype(bool), json.loads(parts[5]))

    def own_counts(self, k: int) -> np.ndarray:
        """How often the chunk's training texts have each n-gram."""
        level = self.level(k)
        return np.bincount(level.at[self.learned & (level.at >= 0)], minlength=len(level.keys)).astype(np.int64)

    def leads(self, k: int) -> np.ndarray:
        """The n-grams that stand before a token of a text that isn't learned from."""
        level = self.level(k)
        inner = ~self.learned
        inner[self.ends - 1] = False
        return np.bincount(level.at[inner & (level.at >= 0)], minlength=len(level.keys)) > 0


def texts_in_chunks(batch: pa.RecordBatch, most: int) -> Iterator[tuple[list, list[bytes], np.ndarray]]:
    """(ids, texts, learn) of about `most` bytes each, of a batch of (id, text as bytes, learn)."""
    ids, texts, learn = batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.array(batch.column(2).to_pylist(), bool)
    a, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most or i + 1 == len(texts):
            yield ids[a : i + 1], texts[a : i + 1], learn[a : i + 1]
            a, held = i + 1, 0


def discounts(n_of: dict[int, int], k: int = GOOD_TURING) -> np.ndarray:
    """d[r] for r up to k from counts of counts; d[0] is unused. Counts over k keep their mass."""
    n = [0] + [n_of.get(r, 0) for r in range(1, k + 2)]
    d = np.ones(k + 1)
    if not n[1]:
        return d
    tail = (k + 1) * n[k + 1] / n[1]
    absolute = n[1] / (n[1] + 2 * n[2])
    for r in range(1, k + 1):
        good = (((r + 1) * n[r + 1] / (r * n[r])) - tail) / (1 - tail) if n[r] and tail < 1 else -1.0
        d[r] = good if 0 < good <= 1 else (r - absolute) / r if absolute < r else 0.5
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c < len(d), d[np.minimum(c, len(d) - 1)], 1.0)


def few_of(n: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, ... `GOOD_TURING` + 1."""
    return np.bincount(np.minimum(n, GOOD_TURING + 2), minlength=GOOD_TURING + 3)[1 : GOOD_TURING + 2]


class World:
    """Totals and discounts of the whole training set; `few[k]` has the counts of counts of level k."""

    def __init__(self, total: int, types: int, texts: int, few: dict[int, list[int]]):
        self.total, self.types, self.texts = total, types, texts
        n_of = {k: {r + 1: n for r, n in enumerate(v)} for k, v in few.items()}
        self.d = {k: discounts(n_of[k]) for k in few}
        freed = sum(n * r * (1 - self.d[1][r]) for r, n in n_of[1].items() if r <= GOOD_TURING) / total if total else 1.0
        self.scale = 1.0 if freed > 1e-12 else total / (total + 1)
        self.unknown = freed if freed > 1e-12 else 1 / (total + 1)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * discounted(c, self.d[1]) / max(self.total, 1), self.unknown)

    def full_from(self, k: int) -> int:
        """The least count at level k that keeps its mass."""
        return next((r for r in range(1, GOOD_TURING + 1) if self.d[k][r] >= 1), GOOD_TURING + 1)


ASK = "bucket int, chunk long, keys binary, counts binary, leads binary, few array<long>"
ANSWER = "bucket int, chunk long, counts binary, owned binary, shared binary, wanted binary, total long, types long, few array<long>"


def columns_of(kind: str) -> list[str]:
    return [x.split()[0] for x in kind.split(", ")]


def asks(chunk: Chunk, k: int, number: int, buckets: int, which: np.ndarray | None = None) -> Iterator[tuple]:
    """Rows of `ASK` for the n-grams `which` of a level (all if None); what the others count is told beside the first."""
    level, n, leads = chunk.level(k), chunk.own_counts(k), chunk.leads(k)
    rest = np.zeros(0, np.int64) if which is None else n[~which]
    which = slice(None) if which is None else np.flatnonzero(which)
    keys, n, leads = level.keys[which], n[which], leads[which]
    # every chunk asks some bucket, if only with nothing, so that it gets an answer
    yield number % buckets, number, b"", pack_counts(np.zeros(0, np.int64)), pack_flags(np.zeros(0, bool)), few_of(rest).tolist()
    at = cuts(keys, buckets)
    for b in range(buckets):
        here = slice(at[b], at[b + 1])
        if here.start < here.stop:
            yield b, number, pack_keys(keys[here]), pack_counts(n[here]), pack_flags(leads[here]), None


def answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's counts, in each chunk's order: also which of the n-grams it owns, shares, and which lead on."""
    bucket, out = int(pdf["bucket"].iloc[0]), []
    few = np.array([x for x in pdf["few"] if x is not None], np.int64).reshape(-1, GOOD_TURING + 1).sum(0)
    full = pdf[pdf["few"].isna()].sort_values("chunk")
    keys = [unpack_keys(k) for k in full["keys"]]
    total = np.zeros(0, np.int64)
    if keys:
        n = np.concatenate([unpack_counts(c) for c in full["counts"]])
        leads = np.concatenate([unpack_flags(x, len(k)) for x, k in zip(full["leads"], keys, strict=True)])
        order, begin = grouped(keys)
        n, leads = n[order], leads[order]
        total, size = np.add.reduceat(n, begin), np.diff(np.append(begin, len(n)))
        owner = np.minimum.reduceat(np.where(n > 0, np.arange(len(n)), len(n)), begin)  # the first chunk that learns from it
        owned, back = np.zeros(len(n), bool), lambda x: _back(x, order, size)
        owned[order[owner[owner < len(n)]]] = True
        reply, shared, wanted = back(total), back(size > 1), back(np.add.reduceat(leads.astype(np.int64), begin) > 0)
        at = 0
        for chunk, k in zip(full["chunk"], keys, strict=True):
            here = slice(at, at + len(k))
            out.append((bucket, int(chunk), pack_counts(reply[here]), *(pack_flags(x[here]) for x in (owned, shared, wanted)), 0, 0, None))
            at += len(k)
    none = pack_flags(np.zeros(0, bool))
    for chunk in pdf["chunk"][pdf["few"].notna()]:
        out.append((bucket, int(chunk), pack_counts(np.zeros(0, np.int64)), none, none, none, 0, 0, None))
    out.append((bucket, -1, None, None, None, None, int(total.sum()), int((total > 0).sum()), (few + few_of(total)).tolist()))
    trim()
    return pd.DataFrame(out, columns=columns_of(ANSWER))


def _back(each: np.ndarray, order: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What each distinct key has, in the order that the keys were asked in."""
    out = np.empty(len(order), each.dtype)
    out[order] = np.repeat(each, size)
    return out


class Answers:
    """What a chunk was told about a level, put together in the order of the level's keys."""

    def __init__(self, counts, owned, shared, wanted):
        self.counts, self.owned, self.shared, self.wanted = counts, owned, shared, wanted

    @classmethod
    def of(cls, chunk: Chunk, k: int, asked: np.ndarray | None, parts: pd.DataFrame) -> Answers:
        parts = parts.sort_values("bucket", kind="stable")
        each = [unpack_counts(c) for c in parts["counts"]]
        counts = np.concatenate(each)
        flags = [np.concatenate([unpack_flags(x, len(c)) for x, c in zip(parts[f], each, strict=True)]) for f in ("owned", "shared", "wanted")]
        if asked is None:
            return cls(counts, *flags)
        # an n-gram that no other chunk can have is counted, owned and led on from here
        own, at = chunk.own_counts(k), np.flatnonzero(asked)
        out = cls(own, own > 0, np.zeros(len(own), bool), chunk.leads(k))
        for whole, part in zip((out.counts, out.owned, out.shared, out.wanted), (counts, *flags), strict=True):
            whole[at] = part
        return out

    def dump(self) -> bytes:
        parts = [pack_counts(self.counts), *(pack_flags(x) for x in (self.owned, self.shared, self.wanted))]
        return pickle.dumps(parts, 5)

    @classmethod
    def load(cls, raw: bytes) -> Answers:
        counts, *flags = pickle.loads(raw)
        counts = unpack_counts(counts)
        return cls(counts, *(unpack_flags(x, len(counts)) for x in flags))


def to_ask(chunk: Chunk, k: int, below: Answers) -> np.ndarray:
    """The n-grams of a level that other chunks may have too: their history and their suffix are shared."""
    level = chunk.level(k)
    lead = np.append(below.shared, True) if k == 2 else below.shared
    return lead[level.history] & below.shared[level.suffix]


class Tables:
    """What a chunk knows about its histories at one level: counts, whether shared, sums over the followers it owns."""

    def __init__(self, chunk: Chunk, k: int, told: dict[int, Answers], world: World):
        level, follow, d = chunk.level(k), told[k], world.d[k]
        self.key, self.shared, self.wanted = chunk.level(k - 1).keys, told[k - 1].shared, told[k - 1].wanted
        self.count = told[k - 1].counts
        if k == 2:  # the beginning
            self.key, self.count = np.append(self.key, BEGIN), np.append(self.count, world.texts)
            self.shared, self.wanted = np.append(self.shared, True), np.append(self.wanted, True)
        n, c = len(self.key), follow.counts
        mass = discounted(c, d)
        free = (c > 0) & (mass < c)
        self.loose = np.bincount(level.history[free], minlength=n) > 0  # surely not all undiscounted
        mine = np.flatnonzero(follow.owned & (c > 0))
        # numerators of the lower level's probabilities, which pack well; `finish` knows what they are over
        lower = discounted(told[k - 1].counts, world.d[k - 1])
        self.freed = np.bincount(level.history[mine], (c - mass)[mine], n).astype(np.float64)  # whole numbers if there are none
        self.lower = np.bincount(level.history[mine], lower[level.suffix[mine]], n).astype(np.float64)
        self.sent = self.shared & (self.count > 0) & (np.bincount(level.history[mine], minlength=n) > 0)
        self.sent &= self.wanted | (self.count >= world.full_from(k))


SUMS = "bucket int, chunk long, level int, asked boolean, keys binary, freed binary, lower binary"


class Pending:
    """Histories whose sums a chunk needs, and the terms of its texts' scores that wait for them."""

    def __init__(self, ids, learn, sizes, known, base, score, unit):
        self.ids, self.learn, self.sizes, self.known, self.base, self.score = ids, learn, sizes, known, base, score
        #: what a discounted count of a word is worth as a probability
        self.unit = unit
        #: per level k: index into its histories of those needed, their count, sums (if the chunk has them all)
        self.need: dict[int, dict] = {}
        #: (text, level, place among the level's needs, whether backing off, times)
        self.terms: list[tuple] = []


def evaluate(chunk: Chunk, told: dict[int, Answers], world: World, order: int) -> tuple[Pending, dict[int, Tables]]:
    """Scores as far as the chunk knows them, and which histories it still has to look up."""
    tables = {k: Tables(chunk, k, told, world) for k in range(2, order + 1)}
    text = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes)
    log_p = np.zeros(len(chunk.tokens))
    left = np.ones(len(chunk.tokens), bool)
    uses: dict[int, tuple] = {}
    for k in range(order, 1, -1):
        level, t, c = chunk.level(k), tables[k], told[k].counts
        place = np.flatnonzero(left & (level.at >= 0))
        gram = level.at[place].astype(np.int64)
        h = level.history[gram]
        seen = c[gram] > 0
        at, g, hs = place[seen], gram[seen], h[seen]
        log_p[at] = np.log10(discounted(c[g], world.d[k]) / t.count[hs])
        left[at] = False
        tight = ~t.loose[hs]
        off = ~seen & (t.count[h] > 0)
        backs = np.repeat([False, True], [tight.sum(), off.sum()])
        uses[k] = np.concatenate([text[at[tight]], text[place[off]]]), np.concatenate([hs[tight], h[off]]), backs
    rest = np.flatnonzero(left)
    ones = told[1].counts
    log_p[rest] = np.log10(world.unigram(ones))[chunk.tokens[rest]]
    add = lambda x: np.add.reduceat(x, chunk.first)
    base = np.log10((ones + 1) / (world.total + world.types + 1))
    out = Pending(chunk.ids, chunk.learn, chunk.sizes, add((ones > 0)[chunk.tokens].astype(np.int64)), add(base[chunk.tokens]), add(log_p), world.scale / max(world.total, 1))
    wanted: dict[int, np.ndarray] = {}
    for k in range(order, 1, -1):
        t, (texts, h, off) = tables[k], uses[k]
        need = np.unique(np.concatenate([h, wanted.get(k, h[:0])]))
        parent = np.full(len(need), -1, np.int64)
        if k > 2:  # the lower level's probabilities after the shorter history depend on whether that one is scaled
            short = chunk.level(k - 1).suffix[need]
            # the history without its first token, as a history of the level below
            open_ = ~tables[k - 1].loose[short]
            wanted[k - 1] = short[open_]
            parent = np.where(open_, short, -1)
        out.need[k] = {"history": need, "parent": parent, "count": t.count[need], "freed": t.freed[need], "lower": t.lower[need], "ask": t.shared[need], "key": t.key[need]}
        if k > 2:
            out.need[k]["below"] = tables[k - 1].count[chunk.level(k - 1).suffix[need]]
        if len(h):
            code, times = np.unique((texts * len(need) + np.searchsorted(need, h)) * 2 + off, return_counts=True)
            out.terms.append((k, code // 2 // len(need), code // 2 % len(need), code % 2 == 1, times))
    return out, tables


def finish(p: Pending, replies: dict[int, tuple[np.ndarray, np.ndarray]], order: int) -> np.ndarray:
    """Scores, once the sums of the histories that were asked for have come: (freed, lower) for each level."""
    scale, alpha = {}, {}
    for k in range(2, order + 1):
        n = p.need[k]
        freed, lower, c = n["freed"].copy(), n["lower"].copy(), n["count"].astype(float)
        at = np.flatnonzero(n["ask"])
        at = at[np.argsort(n["key"][at], kind="stable")]
        if len(at):
            freed[at], lower[at] = replies[k]
        tight = freed <= 0
        scale[k] = np.where(tight, c / (c + 1), 1.0)
        if k > 2:
            at = np.searchsorted(p.need[k - 1]["history"], n["parent"])
            shrink = np.ones(len(at))
            has = n["parent"] >= 0
            shrink[has] = scale[k - 1][at[has]]
            lower = lower * shrink / np.maximum(n["below"], 1)
        else:
            lower = lower * p.unit
        alpha[k] = np.where(tight, 1 / (c + 1), freed / np.maximum(c, 1)) / np.maximum(1 - lower, 1e-300)
    score = p.score.copy()
    for k, text, at, off, times in p.terms:
        score += np.bincount(text, times * np.log10(np.where(off, alpha[k][at], scale[k][at])), len(score))
    return score


def blocks(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    at = cuts(keys, buckets)
    for b in range(buckets):
        if at[b] < at[b + 1]:
            yield b, slice(at[b], at[b + 1])


def sums_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket of one level: the sums of each history, for the chunks that ask."""
    bucket, level, out = int(pdf["bucket"].iloc[0]), int(pdf["level"].iloc[0]), []
    told, asked = pdf[~pdf["asked"]].sort_values("chunk"), pdf[pdf["asked"]].sort_values("chunk")
    keys, freed, lower = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    if len(told) and len(asked):
        every = [unpack_keys(x) for x in told["keys"]]
        order, begin = grouped(every)
        keys = np.concatenate(every)[order][begin]
        freed, lower = (np.add.reduceat(np.concatenate([loosen(x, "<f8") for x in told[c]])[order], begin) for c in ("freed", "lower"))
    for chunk, raw in zip(asked["chunk"], asked["keys"], strict=True):
        k = unpack_keys(raw)
        at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
        hit = keys[at] == k if len(keys) else np.zeros(len(k), bool)
        a, b = np.zeros(len(k)), np.zeros(len(k))
        a[hit], b[hit] = freed[at[hit]], lower[at[hit]]
        out.append((bucket, int(chunk), level, squeeze(a), squeeze(b)))
    trim()
    return pd.DataFrame(out, columns=["bucket", "chunk", "level", "freed", "lower"])


def score(df: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(key, learned, n_tokens, n_known, train_tokens, base_score, score) of every whole text; `order` is 2 at least."""
    if order < 2:
        raise ValueError("the model needs histories: order 2 at least")
    spark = df.sparkSession
    where = fresh_dir(spark, "katz")
    rows = texts_of(df.withColumn("_learn", F.coalesce(learn_from, F.lit(False))), text, key, "_learn")
    rows = rows.select(F.col(key).cast("long").alias("id"), F.encode("text", "UTF-8").alias("text"), "_learn")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, spread = buckets_for(size), tasks_for(spark, size)
    bounded_batches(spark)
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))

    def read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for b in batches:
            for ids, texts, learn in texts_in_chunks(b, chunk_bytes):
                number = part << 32 | made
                made += 1
                chunk = Chunk.of_texts(texts, learn, ids)
                write_bytes(f"{where}/{number}.chunk", chunk.dump())
                columns = zip(*asks(chunk, 1, number, buckets), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], columns_of(ASK))

    def chunk_of(number: int) -> Chunk:
        return Chunk.load(read_bytes(f"{where}/{number}.chunk"))

    def told_below(number: int, k: int) -> dict[int, Answers]:
        return {j: Answers.load(read_bytes(f"{where}/{number}.{j}")) for j in range(1, k)}

    def learn_level(pdf: pd.DataFrame, k: int) -> tuple[int, Chunk, dict[int, Answers]]:
        """A chunk and all it was told up to level k; the file of level k is kept for the next steps."""
        number = int(pdf["chunk"].iloc[0])
        chunk, told = chunk_of(number), told_below(number, k)
        told[k] = Answers.of(chunk, k, to_ask(chunk, k, told[k - 1]) if k > 1 else None, pdf)
        return number, chunk, told

    def next_asks(k: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            number, chunk, told = learn_level(pdf, k)
            write_bytes(f"{where}/{number}.{k}", told[k].dump())
            out = pd.DataFrame(list(asks(chunk, k + 1, number, buckets, to_ask(chunk, k + 1, told[k]))), columns=columns_of(ASK))
            trim()
            return out

        return run

    asked = rows.mapInArrow(tidy(read_chunks), ASK)
    answers, few = {}, {}
    for k in range(1, order + 1):
        answers[k] = stored(asked.groupBy("bucket").applyInPandas(answer, ANSWER), f"katz-counts-{k}")
        whole = answers[k].where("chunk < 0").agg(F.sum("total").alias("total"), F.sum("types").alias("types"), *[F.sum(F.col("few")[i]).alias(f"n{i}") for i in range(GOOD_TURING + 1)]).first()
        few[k] = [whole[f"n{i}"] for i in range(GOOD_TURING + 1)]
        if k == 1:
            total, types = whole["total"], whole["types"]
            if total is None:
                return spark.createDataFrame([], f"`{key}` long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        if k < order:
            asked = answers[k].where("chunk >= 0").repartition(spread, "chunk").groupBy("chunk").applyInPandas(next_asks(k), ASK)
    world = World(total, types, rows.where("_learn").count(), few)

    def histories(pdf: pd.DataFrame) -> pd.DataFrame:
        """A chunk's sums for the histories that others may ask for, and the histories that it asks for."""
        number, chunk, told = learn_level(pdf, order)
        pending, tables = evaluate(chunk, told, world, order)
        out = [(number % buckets, number, 0, True, b"", None, None)]  # so that every chunk gets an answer
        for k, t in tables.items():
            for asking, at, key_ in ((False, np.flatnonzero(t.sent), t.key), (True, np.flatnonzero(pending.need[k]["ask"]), pending.need[k]["key"])):
                at = at[np.argsort(key_[at], kind="stable")]
                for b, here in blocks(key_[at], buckets):
                    i = at[here]
                    sums = (None, None) if asking else (squeeze(t.freed[i]), squeeze(t.lower[i]))
                    out.append((b, number, k, asking, pack_keys(key_[i]), *sums))
        write_bytes(f"{where}/{number}.pending", squeeze(pickle.dumps(pending, 5)))
        trim()
        return pd.DataFrame(out, columns=columns_of(SUMS))

    summed = answers[order].where("chunk >= 0").repartition(spread, "chunk").groupBy("chunk").applyInPandas(histories, SUMS)
    weights = stored(summed.groupBy("level", "bucket").applyInPandas(sums_of, "bucket int, chunk long, level int, freed binary, lower binary"), "katz-weights")

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pickle.loads(loosen(read_bytes(f"{where}/{int(pdf['chunk'].iloc[0])}.pending"), np.uint8))
        replies = {}
        for k, part in pdf[pdf["level"] > 0].groupby("level"):
            part = part.sort_values("bucket")
            replies[int(k)] = tuple(np.concatenate([loosen(x, "<f8") for x in part[c]]) for c in ("freed", "lower"))
        ids = pd.array(p.ids, "Int64")
        return pd.DataFrame({key: ids, "learned": p.learn, "n_tokens": p.sizes, "n_known": p.known, "train_tokens": world.total, "base_score": p.base, "score": finish(p, replies, order)})

    return weights.repartition(spread, "chunk").groupBy("chunk").applyInPandas(last, f"`{key}` long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
