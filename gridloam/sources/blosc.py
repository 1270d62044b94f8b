"""Blosc frames, the default of Zarr version 2 stores: blocks of shuffled bytes, compressed by lz4, zlib, zstd or snappy.

A frame is a header of 16 bytes, the place of each block, and blocks of one stream or, where each byte of an item is
compressed apart, as many streams as an item has bytes. The codecs are those of pyarrow and the standard library; frames of
the blosclz codec are an error. `pack` makes frames of one block a piece with lz4 and byte shuffle.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

#: Fixed values of the format: flags, codecs by number, and when a block is split into streams.
SHUFFLE, PLAIN, BITS, WHOLE = 0x01, 0x02, 0x04, 0x10
CODECS = {0: "blosclz", 1: "lz4", 2: "snappy", 3: "zlib", 4: "zstd"}
MOST_STREAMS, LEAST_STREAM = 16, 128
HEADER = "<BBBBIII"


class BadFrame(ValueError):
    """Bytes that aren't what their header says."""


def _expanded(raw: bytes, size: int, codec: str) -> bytes:
    try:
        if codec == "zlib":
            out = zlib.decompress(raw)
        elif codec == "zstd":
            import zstandard

            out = zstandard.ZstdDecompressor().decompress(raw, max_output_size=size)
        elif codec in ("lz4", "snappy"):
            out = pa.Codec("lz4_raw" if codec == "lz4" else codec).decompress(raw, decompressed_size=size, asbytes=True)
        else:
            raise BadFrame(f"codec {codec} is not supported")
    except BadFrame:
        raise
    except Exception as e:  # each codec has errors of its own
        raise BadFrame(f"{codec}: {e}") from e
    if len(out) != size:
        raise BadFrame(f"{codec}: {len(out)} bytes in place of {size}")
    return out


def _unshuffled(block: bytes, item: int, bits: bool) -> bytes:
    n = len(block) // item
    if bits:
        if n % 8:
            return block  # such blocks aren't shuffled
        m = np.unpackbits(np.frombuffer(block, np.uint8, n * item), bitorder="little").reshape(item * 8, n)
        head = np.packbits(m.T, bitorder="little").tobytes()
    else:
        head = np.frombuffer(block, np.uint8, n * item).reshape(item, n).T.tobytes()
    return head + block[n * item :]


def unpack(raw: bytes) -> bytes:
    """The bytes that a frame holds."""
    if len(raw) < 16:
        raise BadFrame(f"{len(raw)} bytes are no frame")
    version, _, flags, item, size, block, held = struct.unpack_from(HEADER, raw)
    codec = CODECS.get(flags >> 5)
    if version != 2 or codec is None or not item or held > len(raw) or (size and not block):
        raise BadFrame(f"no frame: version {version}, codec {flags >> 5}, {held} bytes of {len(raw)}")
    if flags & PLAIN:
        if 16 + size > len(raw):
            raise BadFrame(f"{size} bytes in a frame of {len(raw)}")
        return raw[16 : 16 + size]
    blocks = -(-size // block) if size else 0
    if 16 + 4 * blocks > len(raw):
        raise BadFrame(f"{blocks} blocks in a frame of {len(raw)} bytes")
    out = []
    for i, start in enumerate(struct.unpack_from(f"<{blocks}i", raw, 16)):
        length = min(block, size - i * block)
        split = not flags & WHOLE and item <= MOST_STREAMS and block // item >= LEAST_STREAM and length == block
        streams, parts, at = item if split else 1, [], start
        if length % streams:
            raise BadFrame(f"a block of {length} bytes in {streams} streams")
        for _ in range(streams):
            if not 16 <= at <= held - 4:
                raise BadFrame(f"a stream at {at} of {held} bytes")
            n, want = struct.unpack_from("<i", raw, at)[0], length // streams
            if n < 0 or at + 4 + n > held:
                raise BadFrame(f"a stream of {n} bytes at {at} of {held}")
            piece = raw[at + 4 : at + 4 + n]
            parts.append(piece if n == want else _expanded(piece, want, codec))
            at += 4 + n
        whole = b"".join(parts)
        if item > 1 and flags & (SHUFFLE | BITS):
            whole = _unshuffled(whole, item, bool(flags & BITS))
        out.append(whole)
    return b"".join(out)


def pack(data: bytes, item: int, block: int = 1 << 18) -> bytes:
    """A frame of whole blocks, their bytes shuffled and compressed by lz4."""
    block = max(item, block // item * item)
    codec, starts, body = pa.Codec("lz4_raw"), [], b""
    count = -(-len(data) // block)
    for a in range(0, len(data), block):
        piece = data[a : a + block]
        n = len(piece) // item
        piece = np.frombuffer(piece, np.uint8, n * item).reshape(n, item).T.tobytes() + piece[n * item :]
        small = codec.compress(piece, asbytes=True)
        starts.append(16 + 4 * count + len(body))
        small = small if len(small) < len(piece) else piece
        body += struct.pack("<i", len(small)) + small
    flags = SHUFFLE | WHOLE | 1 << 5
    return struct.pack(HEADER, 2, 1, flags, item, len(data), block, 16 + 4 * count + len(body)) + struct.pack(f"<{count}i", *starts) + body
