"""Helpers that several training-data operators share: storage, hashing, sampling."""

from __future__ import annotations

import os
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def _lean() -> None:
    """Have glibc map large arrays by themselves, so that a worker gives their memory back when they go."""
    import ctypes

    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD, which is then no longer raised
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass


_lean()

#: Records in an Arrow batch, and bytes; they bound a Python worker's memory where texts are long.
BATCH_ROWS = 2000
BATCH_BYTES = 32 << 20
#: Rows of one key that a task of a join takes at least, and keys with more that are broadcast at most.
HOT_ROWS, HOT_KEYS = 1000, 10_000


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file; kept out of the repository, so looked up where it is used."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: `spark.checkpoint.dir`.

    Where that is unset, a local session (one machine) gets a folder of our own; a cluster is an error, as a folder of
    one machine would be missed by the others.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = sc.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file:///tmp/checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def open_fs(uri: str):
    """(pyarrow file system, path in it) of a URI or an absolute local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def write_bytes(uri: str, data: bytes) -> None:
    """Write a whole file under a temporary name, then rename it: a retried task leaves no half file."""
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def read_bytes(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts, for the plans built from now on; a smaller bound stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def spread_join(rows: DataFrame, table: DataFrame, on: str, counts: DataFrame) -> DataFrame:
    """Rows inner-joined to a table with one row for each key; no task gets all rows of a frequent key.

    `counts` has the rows of each key, `n`. Keys with over a ten-thousandth of the rows are at most ten thousand: their
    part of the table is broadcast, and only the other rows are shuffled. All three are read several times, so give
    stored tables.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(HOT_ROWS, total // HOT_KEYS)).select(on)
    if hot.isEmpty():
        return rows.join(table, on)
    hot = F.broadcast(hot)
    few = F.broadcast(table.join(hot, on, "left_semi"))
    return rows.join(few, on).unionByName(rows.join(hot, on, "left_anti").join(table, on))


def partitions_for(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Partitions for rows that are about to be dealt out: by their planned size, but not under the session's number."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // bytes_each, 1_000_000))


def stored(df: DataFrame, kind: str = "table") -> DataFrame:
    """Cut lineage: the rows as a table in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    where = fresh_dir(spark, kind)
    df.write.option("compression", "zstd").parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def texts_of(df: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """Only the key columns and the text, null as empty; other columns, whatever their names, are left out."""
    return df.select(*[F.col(k) for k in keys], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def tidy(run):
    """A batch function that gives unused memory back when its task ends; Python workers live on."""

    def tidied(batches):
        yield from run(batches)
        trim()

    return tidied


def trim() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def fold(key, of: int):
    """crc32 of the key as text, modulo `of`; null keys give -1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % of, F.lit(-1))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, vectorised: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, kind: str) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[kind] = have = np.multiply.accumulate(steps)
    return have[:n]


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the runs that hold no ASCII white space."""
    buf = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[buf], [True])).astype(np.int8))
    return buf, np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(raw: bytes, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word of UTF-8 bytes, in order; `lower` folds A-Z.

    A polynomial over the word's bytes, taken from prefix sums modulo 2**64, so that the cost is a few
    nanoseconds a byte and no table of words is held.
    """
    buf, start, end = word_spans(raw)
    return span_hashes(buf, start, end, lower)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _TABLE)[buf] * _power(_R, len(buf), "up"), out=sums[1:])
    return mix64((sums[end] - sums[start]) * _power(_R_INV, len(buf), "down")[start] + (end - start).astype(np.uint64))
