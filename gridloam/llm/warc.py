"""WARC archives: written from a table, read by a Python data source.

Written: one gzip member per record, whose header carries a `sl` extra field with the member's compressed and
unpacked lengths, so that a reader can pass over it unread. Records whose payload (by SHA-1) equals another's are
`revisit` records that name the `response` record with the largest id; payloads under `min_bytes` are never revisits.

Read: `spark.read.format("warc")` plans partitions of whole archives (a large one is read by one task),
parses the headers first, and leaves out records that pushed-down predicates on `record_type`, `target_uri`,
`record_id`, `refers_to`, `date` or `payload_digest` exclude, without unpacking their payloads. With option
`payload` set to `false` no payload is unpacked at all. Archives without `sl`, and plain ones, are read too.

Null payloads are empty payloads; a null id makes a record without an id and cannot be referred to; repeated rows
give a record each (of those with the largest id all are responses); an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

from gridloam.llm.common import bounded_batches, fresh_dir, open_fs, stored, write_bytes

#: The alphabet of RFC 4648 and the profile of the standard.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, date string, content_type string, content_length long, payload_digest string, payload_length long, refers_to string, payload binary"
FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
ARCHIVE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"


def base32_of_hex(digest: Column) -> Column:
    """RFC 4648 base32 of a hexadecimal SHA-1, with SQL functions alone."""
    out = []
    for i in range(8):
        n = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(ALPHABET), F.shiftright(n, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)


def member(record: bytes) -> bytes:
    """A gzip member with the lengths of itself and of what it holds in its header, if 32 bits hold them."""
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    size = 10 + 2 + 12 + len(body) + 8
    if max(size, len(record)) >> 32:
        head = b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
    else:
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(record))
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(kind: str, record_id, uri: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    name = lambda x: f"<urn:x-page:{x}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}"]
    if record_id is not None:
        head.append(f"WARC-Record-ID: {name(record_id)}")
    if uri is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in uri))
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(df: DataFrame, where: str, key: str = "page_id", payload: str = "html", uri: str = "url", min_bytes: int = 0) -> DataFrame:
    """Write archives into a folder that all executors see; a stored table (file, records, bytes) of them.

    The first record of each group of equal payloads is found by a partial aggregate on the digest; the join back
    is an ordinary equi-join, whose hot digests adaptive execution splits.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(F.col(key).alias("id"), F.col(uri).cast("string").alias("uri"), F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    many = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("sha").alias("same"), "first")
    many = stored(many, "warc-firsts")  # so that the join has an exchange on either side and a hot payload is split
    rows = rows.join(many, (rows.sha == many.same) & (F.octet_length("payload") >= min_bytes), "left")
    rows = rows.select("id", "uri", "payload", "sha", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, out, n = TaskContext.get().partitionId(), 0, io.BytesIO(), 0

        def archive():
            nonlocal made, out, n
            name = f"{where}/{part:06d}-{made:06d}.warc.gz"
            write_bytes(name, out.getvalue())
            row = pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [out.tell()]})
            made, out, n = made + 1, io.BytesIO(), 0
            return row

        for b in batches:
            for i, link, body, sha, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                out.write(member(record("response" if first is None else "revisit", i, link, body, digest, first)))
                n += 1
                if out.tell() >= ARCHIVE_BYTES:
                    yield archive()
        if n:
            yield archive()

    return stored(rows.mapInArrow(run, "file string, records long, bytes long"), "warc-files")


class Source:
    """A file that is read on, in blocks; a gzip member or a plain record at a time."""

    BLOCK = 1 << 20

    def __init__(self, stream):
        self.stream, self.held, self.at = stream, b"", 0

    def need(self, n: int) -> bool:
        """Whether n bytes are held from here on."""
        while len(self.held) - self.at < n:
            more = self.stream.read(max(self.BLOCK, n))
            if not more:
                return False
            self.held, self.at = self.held[self.at :] + bytes(more), 0
        return True

    def take(self, n: int) -> bytes:
        self.need(n)
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        have = len(self.held) - self.at
        if n <= have:
            self.at += n
        else:
            self.stream.seek(n - have, 1)
            self.held, self.at = b"", 0


def parse_header(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out, last = {}, None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def records(stream, wanted=lambda head: True, payload: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(header, block) of each wanted record; blocks of others, or all if not `payload`, are passed over."""
    src = Source(stream)
    while src.need(1):
        if src.held[src.at : src.at + 2] == b"\x1f\x8b" or src.need(2) and src.held[src.at : src.at + 2] == b"\x1f\x8b":
            src.need(24)
            lead = src.held[src.at : src.at + 24]
            known = len(lead) == 24 and lead[3] == 4 and lead[12:14] == b"sl" and lead[10:12] == b"\x0c\0"
            size = struct.unpack_from("<I", lead, 16)[0] if known else 0
            if known and src.need(min(size, 1 << 16)):
                unpack = zlib.decompressobj(31)
                text = unpack.decompress(src.held[src.at : src.at + min(size, 1 << 16)], 1 << 12)
                cut = text.find(b"\r\n\r\n")
                while cut < 0 and not unpack.eof and unpack.unconsumed_tail:
                    text += unpack.decompress(unpack.unconsumed_tail, 1 << 12)
                    cut = text.find(b"\r\n\r\n")
                head = parse_header(text[:cut])
                if not (wanted(head) and payload):
                    if wanted(head):
                        yield head, None
                    src.skip(size)
                    continue
                text = zlib.decompress(src.take(size), 31)
            else:
                unpack, parts = zlib.decompressobj(31), []
                while not unpack.eof and src.need(1):
                    parts.append(unpack.decompress(src.held[src.at :]))
                    src.held, src.at = unpack.unused_data, 0
                text = b"".join(parts)
            at = 0
            while (cut := text.find(b"\r\n\r\n", at)) >= 0:
                head = parse_header(text[at:cut].lstrip())
                n = int(head.get("content-length", 0))
                if wanted(head):
                    yield head, text[cut + 4 : cut + 4 + n] if payload else None
                at = cut + 4 + n
                while text[at : at + 2] == b"\r\n":
                    at += 2
                if at >= len(text):
                    break
            continue
        if src.held[src.at : src.at + 2] == b"\r\n":
            src.skip(2)
            continue
        size = 1 << 12
        while True:
            whole = src.need(size)
            cut = src.held.find(b"\r\n\r\n", src.at)
            if cut >= 0 or not whole:
                break
            size *= 2
        if cut < 0:
            return
        head = parse_header(src.take(cut - src.at))
        src.skip(4)
        n = int(head.get("content-length", 0))
        if wanted(head):
            if payload:
                yield head, src.take(n)
                continue
            yield head, None
        src.skip(n)


def payload_of(head: dict[str, str], block: bytes | None) -> bytes | None:
    """A block without its HTTP header."""
    if block is not None and head.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        return block[cut + 4 :] if cut >= 0 else b""
    return block


class WarcPartition(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.equal: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in FIELDS and isinstance(f, EqualTo):
                self.equal.append((FIELDS[name], (f.value,)))
            elif name in FIELDS and isinstance(f, In):
                self.equal.append((FIELDS[name], tuple(f.value)))
            elif name in FIELDS and isinstance(f, IsNotNull):
                self.equal.append((FIELDS[name], ()))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        where, path = open_fs(self.path)
        info = where.get_file_info(path)
        if info.type == fs.FileType.File:
            names = [info]
        else:
            names = [x for x in where.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz"))]
        out: list[WarcPartition] = []
        room = 0
        for x in sorted(names, key=lambda x: x.path):  # small archives share a partition
            if room < (x.size or 0) or not out:
                out.append(WarcPartition([]))
                room = ARCHIVE_BYTES // 4
            out[-1].files.append(x.path)
            room -= x.size or 0
        return out or [WarcPartition([])]

    def wanted(self, head: dict[str, str]) -> bool:
        return all((name in head) if not values else clean(name, head.get(name)) in values for name, values in self.equal)

    def read(self, partition):
        where, _ = open_fs(self.path)
        for name in partition.files:
            with where.open_input_file(name) as stream:
                rows: list[tuple] = []
                held = 0
                for head, block in records(stream, self.wanted, self.payload):
                    body = payload_of(head, block)
                    get = lambda k, h=head: clean(k, h.get(k))
                    revisit = head.get("warc-type") == "revisit"
                    size = head.get("x-payload-length")
                    rows.append((get("warc-record-id"), get("warc-type"), get("warc-target-uri"), get("warc-date"), head.get("content-type"), int(head.get("content-length", 0)), get("warc-payload-digest"), int(size) if size else None if body is None or revisit else len(body), get("warc-refers-to"), None if revisit else body))
                    held += len(body or b"") + 200
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)


def clean(name: str, value: str | None) -> str | None:
    """A header's value without angle brackets or the name of the hash."""
    if value is None:
        return None
    if name == "warc-payload-digest":
        return value.removeprefix("sha1:")
    return value[1:-1] if value[:1] == "<" and value[-1:] == ">" else value


def batch(rows: list[tuple]) -> pa.RecordBatch:
    s, n = pa.string(), pa.int64()
    kinds = [s, s, s, s, s, n, s, n, s, pa.binary()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class WarcDataSource(DataSource):
    """`spark.read.format("warc").load(folder or file)`."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def round_trip(df: DataFrame, key: str = "page_id", payload: str = "html", uri: str = "url") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archives written from all rows."""
    spark = df.sparkSession
    register(spark)
    where = fresh_dir(spark, "warc")
    if write(df, where, key, payload, uri).isEmpty():
        return spark.createDataFrame([], f"`{key}` long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    back = spark.read.format("warc").load(where)
    number = lambda c: F.regexp_extract(c, r"(-?\d+)$", 1).cast("long")
    return back.select(
        number("record_id").alias(key),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce(base32_of_hex(F.sha1("payload")), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
