"""TIFF columns: files are decoded by walking their image directories; each page becomes a row.

Read: both byte orders; strips and tiles; no compression, PackBits, LZW (most significant bit first) and deflate;
1-, 8- and 16-bit unsigned samples, one or more to a pixel, chunky or planar; horizontal differencing undone.
Written: one page of 8-bit grey samples in strips, with any of the four codings and, if asked, differencing.

Null and empty files and files that aren't TIFF give no page; a directory that points back to one that was
already walked ends the walk; short or broken strips are filled with zeros and flagged in `error`.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloam.llm.common import BATCH_BYTES, bounded_batches, texts_of

#: Tag numbers and field types of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 322, 323, 324, 325
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
CODES = {1: "none", 5: "lzw", 8: "deflate", 32773: "packbits", 32946: "deflate"}
NUMBERS = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}


def packbits_decode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += 2 + c
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    if not data:
        return b""
    arr = np.frombuffer(data, np.uint8)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(arr)) + 1, [len(arr)]))
    out, plain = bytearray(), bytearray()

    def flush():
        for k in range(0, len(plain), 128):
            out.append(len(plain[k : k + 128]) - 1)
            out.extend(plain[k : k + 128])
        plain.clear()

    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a < 3:
            plain += data[a:b]
            continue
        flush()
        for k in range(a, b, 128):
            m = min(128, b - k)
            out += bytes([257 - m if m > 1 else 0, data[a]])
    flush()
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, acc, bits, width, before = [], 0, 0, 9, None
    for byte in data:
        acc, bits = (acc << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits & (1 << width) - 1
        if code == 256:
            del table[258:]
            width, before = 9, None
            continue
        if code == 257:
            break
        if before is None:
            word = table[code] if code < len(table) else b""
        else:
            if code > len(table):
                raise ValueError("broken LZW data")
            word = table[code] if code < len(table) else before + before[:1]
            table.append(before + word[:1])
        out.append(word)
        before = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, acc, bits, width = bytearray(), 0, 0, 9
    table = {bytes([i]): i for i in range(256)}
    size, word = 258, b""

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    put(256)
    for byte in data:
        more = word + bytes([byte])
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = bytes([byte])
    if word:
        put(table[word])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if bits:
        out.append(acc << 8 - bits & 255)
    return bytes(out)


#: Each takes a segment and the most bytes that are of use.
DECODERS = {
    "none": lambda b, most: bytes(b[:most]),
    "lzw": lambda b, most: lzw_decode(b),
    "deflate": lambda b, most: zlib.decompressobj().decompress(b, most),
    "packbits": lambda b, most: packbits_decode(b),
}
#: No coding gives more bytes than this for one that is stored; a page that claims more is not unpacked.
MOST_RATIO = 4096
ENCODERS = {"none": bytes, "lzw": lzw_encode, "deflate": lambda b: zlib.compress(b, 1), "packbits": packbits_encode}


def encode_page(samples: np.ndarray, coding: str = "deflate", predictor: int = 1, strip_rows: int = 2048, order: str = "<") -> bytes:
    """A file with one page of 8-bit grey samples (rows x columns)."""
    return encode_pages([samples], coding, predictor, strip_rows, order)


def encode_pages(pages: list[np.ndarray], coding: str = "deflate", predictor: int = 1, strip_rows: int = 2048, order: str = "<") -> bytes:
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for samples in pages:
        height, width = samples.shape
        strips = []
        for r in range(0, height, strip_rows):
            rows = samples[r : r + strip_rows]
            if predictor == 2:
                rows = np.concatenate([rows[:, :1], np.diff(rows, axis=1)], axis=1)
            strips.append(ENCODERS[coding](rows.tobytes()))
        at = []
        for s in strips:
            at.append(len(out))
            out += s + b"\0" * (len(s) % 2)
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [NUMBERS[coding]]), (PHOTOMETRIC, 3, [1]), (STRIPS, 4, at), (SAMPLES, 3, [1]), (ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_BYTES, 4, [len(s) for s in strips]), (PREDICTOR, 3, [predictor])]
        begin = len(out)
        extra = begin + 2 + 12 * len(tags) + 4
        body, more = bytearray(), bytearray()
        for tag, kind, values in tags:
            raw = struct.pack(order + f"{len(values)}{TYPES[kind]}", *values)
            body += struct.pack(order + "HHI", tag, kind, len(values))
            if len(raw) > 4:
                body += struct.pack(order + "I", extra + len(more))
                more += raw
            else:
                body += raw.ljust(4, b"\0")
        out[link : link + 4] = struct.pack(order + "I", begin)
        out += struct.pack(order + "H", len(tags)) + body
        link = len(out)
        out += b"\0\0\0\0" + more
        out += b"\0" * (len(out) % 2)
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, tags) of each image directory; only directories are read, no samples."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        return
    at, walked = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in walked and at + 2 <= len(data):
        walked.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        if not n or at + 6 + 12 * n > len(data):
            return
        tags = {}
        for i in range(n):
            p = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(order + "HHI", data, p)
            if kind not in TYPES:
                continue
            size = struct.calcsize(order + TYPES[kind]) * count
            where = p + 8 if size <= 4 else struct.unpack_from(order + "I", data, p + 8)[0]
            if where + size <= len(data):
                tags[tag] = struct.unpack_from(order + f"{count}{TYPES[kind]}", data, where)
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def decode_page(data: bytes, order: str, tags: dict[int, tuple]) -> tuple[np.ndarray, str]:
    """(samples as rows x columns x samples of a pixel, what is broken or an empty string)."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, spp = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, coding, planar, predictor = one(BITS, 1), CODES.get(one(COMPRESSION, 1)), one(PLANAR, 1), one(PREDICTOR, 1)
    kind = np.dtype(np.uint8 if bits <= 8 else order + "u2")
    if coding is None or bits not in (1, 8, 16) or predictor not in (1, 2) or predictor == 2 and bits == 1:
        return np.zeros((0, 0, 1), kind), "not supported"
    tiled = TILES in tags
    across, down = (one(TILE_WIDTH, 16), one(TILE_HEIGHT, 16)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    at, sizes = (tags.get(TILES, ()), tags.get(TILE_BYTES, ())) if tiled else (tags.get(STRIPS, ()), tags.get(STRIP_BYTES, ()))
    if not width or not height or not across or not down:
        return np.zeros((height, width, spp), kind), "no size"
    if width * height * spp * bits > 8 * MOST_RATIO * (len(data) + 16) or across * down > MOST_RATIO * (len(data) + 16):
        return np.zeros((0, 0, 1), kind), "larger than its data can be"
    cols, rows = -(-width // across), -(-height // down)
    planes, each = (spp, 1) if planar == 2 else (1, spp)
    out, error = np.zeros((height, width, spp), kind), ""
    for k in range(planes * rows * cols):
        plane, r, c = k // (rows * cols), k // cols % rows, k % cols
        high = down if tiled else min(down, height - r * down)
        line = -(-across * each * bits // 8)
        raw = b""
        if k < min(len(at), len(sizes)):
            try:
                raw = DECODERS[coding](data[at[k] : at[k] + sizes[k]], line * high)
            except (ValueError, zlib.error, IndexError) as e:
                error = f"segment {k}: {e}"
        if len(raw) < line * high:
            error = error or f"segment {k} is short"
            raw = raw.ljust(line * high, b"\0")
        block = np.frombuffer(raw, np.uint8, line * high).reshape(high, line)
        if bits == 1:
            block = np.unpackbits(block, axis=1)[:, : across * each]
        elif bits == 16:
            block = block.reshape(-1).view(kind).reshape(high, -1)
        block = block.reshape(high, across, each)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        block = block[: height - r * down, : width - c * across]
        where = out[r * down : r * down + block.shape[0], c * across : c * across + block.shape[1]]
        where[:, :, plane : plane + each] = block
    return out, error


def pages(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """(key, media, page, width, height, samples, error): a row for each page of each file, its samples in rows as bytes."""

    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, held = [[] for _ in range(6)], 0

            def done() -> pa.RecordBatch:
                rows = pa.array(cols[0], pa.int64())
                made = [pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True)]
                return pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *made], [key, media, "page", "width", "height", "samples", "error"])

            for i, data in enumerate(x.as_py() for x in b.column(1)):
                for n, (order, tags) in enumerate(directories(data or b"")):
                    samples, error = decode_page(data, order, tags)
                    for c, v in zip(cols, (i, n, samples.shape[1], samples.shape[0], samples.tobytes(), error), strict=True):
                        c.append(v)
                    held += samples.nbytes + len(data)
                    if held > BATCH_BYTES:  # a page repeats its file's bytes
                        yield done()
                        cols, held = [[] for _ in range(6)], 0
            yield done()

    bounded_batches(df.sparkSession)
    df = df.select(key, media)
    return df.mapInArrow(run, f"`{key}` {df.schema[0].dataType.simpleString()}, `{media}` binary, page int, width int, height int, samples binary, error string")


def from_texts(df: DataFrame, key: str, text: str = "text", coding: str = "deflate", predictor: int = 1, width: int = 64) -> DataFrame:
    """(key, n_bytes, media): each whole text's UTF-8 bytes, filled with zeros to a positive multiple of the width, as one grey page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, media = [], []
            for raw in b.column(1).to_pylist():
                size.append(len(raw))
                full = raw.ljust(max(1, -(-len(raw) // width)) * width, b"\0")
                media.append(encode_page(np.frombuffer(full, np.uint8).reshape(-1, width), coding, predictor))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    bounded_batches(df.sparkSession)
    df = texts_of(df, text, key).withColumn("text", F.encode("text", "UTF-8"))
    return df.mapInArrow(run, f"`{key}` {df.schema[0].dataType.simpleString()}, n_bytes long, media binary")


def features(df: DataFrame, key: str, samples: str = "samples") -> DataFrame:
    """(all columns, feature): size, and mean, spread, entropy and edge strength of a page's bytes, as a short text.

    Samples of more than a byte, and several samples of a pixel, count byte by byte.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, w, h in zip(*(b.column(c).to_pylist() for c in (samples, "width", "height")), strict=True):
                x = np.frombuffer(raw, np.uint8)
                n = np.bincount(x, minlength=256)
                p = n[n > 0] / max(1, len(x))
                mean = float(n @ np.arange(256)) / max(1, len(x))
                spread = (float(n @ np.arange(256) ** 2) / max(1, len(x)) - mean**2) ** 0.5 if len(x) else 0.0
                grid = x.reshape(h, -1).astype(np.int16) if h else x.reshape(0, 1)
                edge = float(np.abs(np.diff(grid, axis=1)).mean()) if grid.size > h else 0.0
                out.append(f"{w}x{h} mean={mean:.3f} sd={spread:.3f} entropy={float(-(p * np.log2(p)).sum()):.4f} edge={edge:.3f}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*names, "feature"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", feature string")


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts stored as TIFF pages, read back from the stored bytes, and what their pages show."""
    made = from_texts(df, key, text)
    # n_bytes rides in the key column's struct, so that it stays beside its file
    made = made.select(F.struct(key, "n_bytes").alias("doc"), "media")
    back = features(pages(made, "doc"), "doc")
    return back.select(
        F.col("doc")[key].alias(key),
        F.col("doc.n_bytes").alias("n_bytes"),
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("samples"), F.lit(-64), F.lit(64))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
