"""Counting and looking up very many hashed keys, in packed blocks.

A chunk of documents asks about each of its distinct keys once, however often it holds them. The keys, sorted, are
split by ranges into buckets and sent as blocks of differences; a bucket's task sums up what the chunks have and
answers each block in its own order. A key thus costs a few bytes for each chunk that has it, a hot key no more
than any other, and no task gets more than one block of each chunk.
"""

from __future__ import annotations

import numpy as np
import zstandard

#: Bits of a key; the others of a 64-bit hash are dropped.
BITS = 56


def squeeze(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def loosen(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences of as many bytes as the largest needs; the upper bytes, mostly small, are squeezed."""
    if not len(keys):
        return b""
    step = np.diff(keys, prepend=keys[:1])
    width = max(1, -(-int(step.max()).bit_length() // 8))
    planes = step.astype("<u8").view(np.uint8).reshape(-1, 8)
    head = bytes([width]) + int(keys[0]).to_bytes(8, "little") + len(keys).to_bytes(4, "little")
    body = head + planes[:, : min(width, 4)].tobytes()
    return body + squeeze(np.ascontiguousarray(planes[:, 4:width].T)) if width > 4 else body


def unpack_keys(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    width, n = raw[0], int.from_bytes(raw[9:13], "little")
    low = min(width, 4)
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :low] = np.frombuffer(raw, np.uint8, n * low, 13).reshape(-1, low)
    if width > 4:
        planes[:, 4:width] = loosen(raw[13 + n * low :], np.uint8).reshape(width - 4, n).T
    step = planes.reshape(-1).view("<u8").astype(np.uint64)
    step[0] = int.from_bytes(raw[1:9], "little")
    return np.cumsum(step, dtype=np.uint64)


def pack_flags(flags: np.ndarray) -> bytes:
    return squeeze(np.packbits(flags))


def unpack_flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(loosen(raw, np.uint8), count=n).astype(bool)


def pack_counts(n: np.ndarray) -> bytes:
    """Counts, of which nearly all are small."""
    small = np.minimum(n, 255).astype(np.uint8)
    big = n[n >= 255].astype("<u8")
    return squeeze(len(big).to_bytes(8, "little") + big.tobytes() + small.tobytes())


def unpack_counts(raw: bytes) -> np.ndarray:
    every = loosen(raw, np.uint8)
    n = int.from_bytes(every[:8].tobytes(), "little")
    out = every[8 + 8 * n :].astype(np.int64)
    out[out == 255] = every[8 : 8 + 8 * n].view("<u8")
    return out


def buckets_for(total_bytes: int) -> int:
    """Buckets for texts of so many bytes: about 8 MB of text to a bucket, 64 at least."""
    return max(64, total_bytes >> 23)


def tasks_for(spark, total_bytes: int) -> int:
    """Tasks for steps that take a chunk at a time: about 32 MB of text each, but not under the session's number.

    Their rows are small beside the work that they stand for, so adaptive execution would put too many into a task.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(total_bytes >> 25, 1_000_000))


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin, and the end."""
    edge = np.array([-(-(b << BITS) // buckets) for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, edge), len(keys))


def grouped(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts all keys, the blocks' own order among equals; where each distinct key begins in it)."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every = every[order]
    return order, np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
