"""Language identification by prediction by partial matching.

For each language a variable-order tree of byte contexts (up to three bytes) is counted on a bounded sample of its
training documents. A symbol's probability comes from the longest context: its share there, or else the escape
probability (method C: distinct symbols over distinct symbols plus occurrences) times its probability in the next
shorter context with the symbols of the longer one excluded, down to a uniform distribution. The statistics are
frozen, so every context's code lengths are worked out once; a text's code length is a sum of table look-ups over
all its bytes. The language with the shortest code wins. Every language met in training is learned; models are held in
blocks of languages, and a batch of texts takes the best of each block, then the minimum, as one model would give.

Bytes are A-Z folded; the 63 most frequent have a symbol each, the rest share one and are told apart uniformly.
Null texts and texts without a letter are `und` with score 0. With no training document every text is `und`.
Extra columns are left out (`identify`) or kept (`annotate`); repeated rows are scored as often as they come.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloam.llm.common import bounded_batches, fresh_dir, read_bytes, stored, write_bytes
from gridloam.llm.exchange import loosen, squeeze

SYMBOLS = 64
#: Documents of a language that are counted, at most, chosen by a hash of the key.
DOCUMENTS_A_LANGUAGE = 800
#: Languages, and bytes, of a model that is held at a time; all languages are learned, in as many blocks as they need.
BLOCK_LANGUAGES = 16
BLOCK_BYTES = 128 << 20
#: Bytes that count in full towards the score; a longer text's code length is scaled down to as many.
SURE_BYTES = 100
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PAD = b"   "


def four_grams(docs: DataFrame, text: str, lang: str) -> pd.DataFrame:
    """(lang, code, n) of all folded four-byte sequences; texts begin with three spaces."""
    return gram_counts(docs, text, lang).toPandas()


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:

    def run(batches):
        for b in batches:
            texts: dict[str, list[bytes]] = {}
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.setdefault(name, []).append(_PAD + t.encode())
            for name, raw in texts.items():
                raw = b"".join(raw)
                s = _FOLD[np.frombuffer(raw, np.uint8)].astype(np.uint32)
                code, n = np.unique(s[:-3] << 24 | s[1:-2] << 16 | s[2:-1] << 8 | s[3:], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).mapInArrow(run, "lang string, code long, n long")
    return rows.groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Model:
    """Code lengths in bits: `bits[row, symbol, language]`, where `row_of` maps three symbols to a row."""

    def __init__(self, languages: list[str], symbol: np.ndarray, row_of: np.ndarray, bits: np.ndarray):
        self.languages, self.symbol, self.row_of, self.bits = languages, symbol, row_of, bits

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        flat = self.bits.reshape(-1, len(self.languages))
        for a, b in slices([len(t) for t in texts], 1 << 19):
            s = self.symbol[np.frombuffer(b"".join(_PAD + t for t in texts[a:b]), np.uint8)].astype(np.int32)
            at = self.row_of[s[:-3] << 12 | s[1:-2] << 6 | s[2:-1]] * SYMBOLS + s[3:]
            begin = np.cumsum([0] + [len(t) + 3 for t in texts[a : b - 1]])
            keep = np.ones(len(at), bool)  # codes of the padding itself aren't counted
            for d in (1, 2, 3):
                keep[begin[1:] - d] = False
            size = np.array([len(t) for t in texts[a:b]])
            sums = np.zeros((len(at[keep]) + 1, len(self.languages)))
            np.cumsum(flat[at[keep]], axis=0, out=sums[1:])
            end = np.cumsum(size)
            out[a:b] = sums[end] - sums[end - size]
        return out


class Blocks:
    """Models of all languages as files in the shared folder, a block of languages each, in order of their names."""

    def __init__(self, files: list[str]):
        self.files = files

    def __iter__(self):
        for f in self.files:
            if _held.get("file") != f:
                _held.clear()  # the block before goes first, so that one is held at a time
                _held.update(file=f, model=pickle.loads(loosen(read_bytes(f), np.uint8)))
            yield _held["model"]


#: The block that a worker has loaded last.
_held: dict = {}


def predict(blocks: Iterable[Model], texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Best language and score of each text: the best of each block, then of all; ties go to the earlier name."""
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
    raw = [texts[i].encode() for i in known]
    scale = np.array([min(1.0, SURE_BYTES / len(t)) for t in raw])
    least, total = np.full(len(raw), np.inf), np.zeros(len(raw))
    for model in blocks if known else ():
        bits = model.code_lengths(raw)
        best = bits.argmin(1)
        lower = np.minimum(least, bits.min(1))
        for j in np.flatnonzero(lower < least).tolist():
            lang[known[j]] = model.languages[best[j]]
        total = total * np.exp2((lower - least) * scale) + np.exp2((lower[:, None] - bits) * scale[:, None]).sum(1)
        least = lower
    for i, n in zip(known, total.tolist(), strict=True):
        score[i] = 1 / n if n else 0.0
    return lang, score


def slices(sizes: list[int], most: int):
    """Ranges of items of about `most` bytes together."""
    a, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(sizes):
        yield a, len(sizes)


def symbols_of(often: np.ndarray) -> np.ndarray:
    """The symbol of each byte, from the number of times each folded byte is met."""
    symbol = np.full(256, SYMBOLS - 1, np.uint8)
    order = np.lexsort((np.arange(256), -often))
    order = order[often[order] > 0][: SYMBOLS - 1]
    symbol[order] = np.arange(len(order))
    return symbol[_FOLD]


def build(grams: pd.DataFrame, symbol: np.ndarray | None = None) -> Model:
    """Frozen trees from the counts of `four_grams`; ties between languages go to the earlier name.

    Blocks of languages have the symbols of all, so that their code lengths compare.
    """
    languages = sorted(grams["lang"].unique())
    if not languages:
        return Model([], np.zeros(256, np.uint8), np.zeros(SYMBOLS**3, np.int32), np.zeros((0, SYMBOLS, 0), np.float32))
    code, n = grams["code"].to_numpy(np.int64), grams["n"].to_numpy(np.int64)
    which = np.searchsorted(np.array(languages), grams["lang"].to_numpy(str))
    if symbol is None:
        symbol = symbols_of(np.bincount(code & 255, n, 256))
    part = [symbol[code >> s & 255].astype(np.int64) for s in (24, 16, 8, 0)]
    contexts = [np.zeros(len(code), np.int64)]
    for k in (1, 2, 3):  # of the last k symbols
        contexts.append(sum(part[3 - j] << 6 * (j - 1) for j in range(1, k + 1)))
    seen3 = np.unique(contexts[3])
    ids = [np.array([0]), np.arange(SYMBOLS), np.arange(SYMBOLS**2), seen3]
    bits = []
    for x in range(len(languages)):
        mine = which == x
        prob = np.full((1, SYMBOLS), 1 / SYMBOLS)
        levels = []
        for k in range(4):
            place = np.searchsorted(ids[k], contexts[k][mine])
            count = np.bincount(place * SYMBOLS + part[3][mine], n[mine], len(ids[k]) * SYMBOLS).reshape(-1, SYMBOLS)
            below = prob if k == 0 else prob[ids[k] & (SYMBOLS ** (k - 1) - 1)] if k > 1 else np.repeat(prob, SYMBOLS, axis=0)
            total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            others = np.where(count > 0, 0.0, below)
            rest = others.sum(1, keepdims=True)
            escape = np.where(kinds == SYMBOLS, 0, kinds / np.maximum(total + kinds, 1))
            prob = np.where(total > 0, np.where(count > 0, count / np.maximum(total, 1) * (1 - escape), escape * others / np.maximum(rest, 1e-300)), below)
            levels.append(prob)
        each = -np.log2(np.concatenate([levels[3], levels[2]]))
        each[:, SYMBOLS - 1] += np.log2(256 - 26 - (SYMBOLS - 1))  # one of the folded bytes that share the symbol
        bits.append(each.astype(np.float32))
    row_of = len(seen3) + (np.arange(SYMBOLS**3) & SYMBOLS**2 - 1)
    row_of[seen3] = np.arange(len(seen3))
    return Model(languages, symbol, row_of.astype(np.int32), np.stack(bits, axis=-1))


def cut(contexts: list[tuple[str, int]]) -> list[list[str]]:
    """Blocks of languages, from (name, three-byte contexts at most) in order of the names."""
    blocks: list[list[str]] = []
    rows = 0
    for name, n in contexts:
        n = min(n, SYMBOLS**3)
        if not blocks or len(blocks[-1]) == BLOCK_LANGUAGES or (min(rows + n, SYMBOLS**3) + SYMBOLS**2) * SYMBOLS * 4 * (len(blocks[-1]) + 1) > BLOCK_BYTES:
            blocks.append([])
            rows = 0
        blocks[-1].append(name)
        rows += n
    return blocks


def train(docs: DataFrame, key: str, text: str, lang: str, documents: int = DOCUMENTS_A_LANGUAGE) -> Blocks:
    """Models of all languages of the rows with a text and a language; a hash of the key (of the text, if the key is null) chooses a language's sample."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where("t is not null and l is not null")
    chosen = F.when(F.col("k").isNull(), F.xxhash64("t")).otherwise(F.xxhash64("k"))
    # stored, so that the planner knows the size and sends a small table rather than the texts
    most = stored(rows.groupBy("l").agg(F.least(F.lit(1 << 30), F.floor(F.lit((1 << 30) * documents) / F.count("*"))).cast("long").alias("most")), "langid-shares")
    grams = stored(gram_counts(rows.join(most, "l").where(F.pmod(chosen, F.lit(1 << 30)) < F.col("most")), "t", "l"), "langid-grams")
    often = np.zeros(256)
    for r in grams.groupBy(F.col("code").bitwiseAND(F.lit(255)).alias("byte")).agg(F.sum("n").alias("n")).collect():
        often[r["byte"]] = r["n"]
    contexts = grams.groupBy("lang").agg(F.countDistinct(F.shiftright("code", 8)).alias("n")).collect()
    symbol, where, files = symbols_of(often), fresh_dir(docs.sparkSession, "langid-models"), []
    for names in cut(sorted((r["lang"], r["n"]) for r in contexts)):
        files.append(f"{where}/{len(files)}.block")
        write_bytes(files[-1], squeeze(pickle.dumps(build(grams.where(F.col("lang").isin(names)).toPandas(), symbol), 5)))
    return Blocks(files)


def predictor(spark, blocks: Blocks):
    """A function from a text column to struct<lang_pred, score>."""

    @F.pandas_udf("lang_pred string, score double")
    def found(texts: pd.Series) -> pd.DataFrame:
        lang, score = predict(blocks, [None if t is None or t is pd.NA or t != t else t for t in texts])
        return pd.DataFrame({"lang_pred": lang, "score": score})

    bounded_batches(spark)
    return found


def identify(df: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang_pred, score): learned from the rows where `learn_from` holds, predicted for all."""
    model = train(df.where(learn_from), key, text, lang)
    found = predictor(df.sparkSession, model)
    return df.select(F.col(key), found(F.col(text).cast("string")).alias("_found")).select(key, "_found.lang_pred", "_found.score")
