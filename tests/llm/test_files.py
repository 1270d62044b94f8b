import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloam.llm import queries, repair, tiff, topk, warc
from gridloam.llm.common import fresh_dir, vocabulary

from .cases import documents

SF = "/root/testdata/sf0.001"


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    docs = [np.tile(rng.integers(0, 50, rng.integers(1, 40)), rng.integers(0, 30)).astype("<u4").tobytes() for _ in range(300)]
    docs[5] = b""
    raw = repair.encode_block([None, *range(1, 300)], docs, 49408)
    block = repair.Block(raw)
    assert len(block.rules) > 0 and len(raw) < sum(map(len, docs)) / 3
    assert block.ids[0] is None and [d.astype("<u4").tobytes() for d in block.documents()] == docs
    assert all(block.document(i).astype("<u4").tobytes() == docs[i] for i in range(300))
    every = np.frombuffer(b"".join(docs), "<u4")
    for a, b in ((0, 1), (17, 900), (len(every) - 3, len(every) + 9), (4, 4)):
        assert (block.tokens(a, b) == every[a:b]).all()
    assert (block.length == np.diff(repair.expansions(block.rules, block.first)[1])).all()


def most_frequent(seq, last):
    """How often the most frequent pair comes, without overlaps, counted plainly from left to right."""
    count, end = {}, {}
    for i in range(len(seq) - 1):
        pair = (int(seq[i]), int(seq[i + 1]))
        if not last[i] and end.get(pair, -1) < i:
            count[pair], end[pair] = count.get(pair, 0) + 1, i + 1
    return max(count.values(), default=0)


@pytest.mark.parametrize("kind", ["text", "runs", "copies", "few"])
def test_repair_goes_on_until_no_pair_is_frequent(kind):
    rng = np.random.default_rng(5)
    if kind == "text":
        parts = [rng.choice(500, rng.integers(1, 300), p=np.arange(500, 0, -1) / 125250) for _ in range(300)]
    elif kind == "runs":
        parts = [np.repeat(rng.integers(0, 3, 40), rng.integers(1, 30, 40)) for _ in range(60)]
    elif kind == "copies":
        parts = [rng.integers(0, 40000, 700)] * 40 + [rng.integers(0, 40000, 5) for _ in range(100)]
    else:
        parts = [np.array([1, 2]), np.array([0]), np.array([3, 3, 3])]
    tokens = np.concatenate(parts).astype("<u4")
    ends = np.zeros(len(tokens), bool)
    ends[np.cumsum([len(p) for p in parts]) - 1] = True
    seq, last, rules = repair.compress(tokens, ends, 49408)
    assert most_frequent(seq, last) < repair.LEAST
    table, begin = repair.expansions(rules, 49408)
    assert (repair.expand(seq, table, begin, 49408) == tokens).all() and last.sum() == len(parts)
    if kind == "copies":  # a passage of 700 ids is one symbol a copy
        assert len(seq) <= 40 + 500
    if kind == "few":
        assert not len(rules)


@pytest.mark.parametrize("tokens", [repair.BLOCK_TOKENS, 500])
def test_repair_files(spark, tokens):
    df = documents(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100), allowMissingColumns=True)
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    files = repair.write(df, "doc_id", fresh_dir(spark, "repair"), block_tokens=tokens)
    got = sorted(repair.read(files).collect(), key=lambda r: r["start"])
    rows = [(r["doc_id"], np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in df.collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], bytes(r["ids"])) for r in got), key=key) == sorted(rows, key=key)
    at, last = 0, -1
    for r in got:
        assert r["start"] == at and (-1 if r["doc_id"] is None else r["doc_id"]) >= last
        at, last = at + len(r["ids"]) // 4, -1 if r["doc_id"] is None else r["doc_id"]
    assert sum(f["n_tokens"] for f in files.collect()) == at


def test_repair_query(spark):
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got, at = {r["doc_id"]: r for r in queries.op2_repair(spark, SF).collect()}, 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*tok.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        g = got.pop(r["doc_id"])
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not got
    assert repair.digests(documents(spark).where("false")).count() == 0


def brute(rows, k=5):
    """Each query row's k best, in plain Python; scores are held within 64 bits."""
    ok = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    most, out = 2**63 - 1, []
    for q, x in ok:
        if q % 50 == 0:
            held = lambda v: max(-most, min(most, v))
            best = sorted((-held(sum(a * b for a, b in zip(x, v, strict=True))), i) for i, v in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 40])
def test_topk(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", block // 10)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 3])).astype("float32").tolist()) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(100, rows[3][1]), rows[9], (50, None), (None, rows[1][1]), (701, [float("nan")] + [0.0] * 7), (702, [None] + [0.0] * 7), (703, [float("inf")] * 8), (750, [0.0] * 8), (704, [])]
    df = spark.createDataFrame([(a, b, 5, 1.0) for a, b in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = topk.search(df, lambda i: i % 50 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows)


def test_topk_huge_components(spark):
    """Finite components of any size count; what no 64 bits hold is held at their ends."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    rows += [(150, [3e9] * 4), (151, [-3e9] * 4), (152, [3e9, 1.0, 0.0, 0.0]), (153, [1e300] * 4), (154, [2.0**30, 0.0, 0.0, 5.0]), (200, [2.0**21, 3.0, 1.0, 0.5]), (155, [1e308] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, lambda i: i % 50 == 0).collect()
    want = brute([r for r in rows if r[0] != 155])  # not finite once scaled
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


def test_topk_of_several_dimensions(spark):
    """Vectors meet those of their dimension, rare ones too."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4 if i % 3 else 6).tolist()) for i in range(160)] + [(200, [1.0]), (250, [2.0]), (251, [-3e9]), (300, [0.5] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, lambda i: i % 50 == 0).collect()
    want = [t for d in (1, 4, 6, 9) for t in brute([r for r in rows if len(r[1]) == d])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_topk_leaves_the_session_alone(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    topk.search(df, lambda i: i % 50 == 0).collect()
    assert int(spark.conf.get(name)) >= 2000


def test_topk_few_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.25])], "vec_id long, embedding array<float>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df, lambda i: i % 50 == 0).collect()) == brute([tuple(r) for r in df.collect()])
    assert topk.search(df.where("false"), lambda i: i % 50 == 0).count() == 0
    assert topk.search(df.where("vec_id > 0"), lambda i: i % 50 == 0).count() == 0


def test_tiff_sizes_beyond_the_data():
    """A page that claims more samples than its bytes can hold gives an error, not that much memory."""
    page = np.zeros((4, 8), np.uint8)
    good = tiff.encode_page(page)
    (order, tags), = tiff.directories(good)
    for width, height in ((1 << 31, 1 << 20), (1 << 31, 1), (8, 1 << 31)):
        samples, error = tiff.decode_page(good, order, tags | {tiff.WIDTH: (width,), tiff.HEIGHT: (height,)})
        assert error and samples.size < 1 << 24
    samples, error = tiff.decode_page(good, order, tags | {tiff.TILES: (8,), tiff.TILE_BYTES: (4,), tiff.TILE_WIDTH: (1 << 31,), tiff.TILE_HEIGHT: (1 << 31,)})
    assert error and samples.size == 0
    bomb = tiff.encode_page(np.zeros((100_000, 64), np.uint8))  # inflates far beyond what the page needs
    (order, tags), = tiff.directories(bomb)
    samples, error = tiff.decode_page(bomb, order, tags | {tiff.HEIGHT: (2,), tiff.ROWS_PER_STRIP: (2,)})
    assert samples.shape == (2, 64, 1) and not error


@pytest.mark.parametrize("coding", ["none", "packbits", "lzw", "deflate"])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_codings(coding, order, predictor):
    rng = np.random.default_rng(5)
    pages = [np.repeat(rng.integers(0, 256, (70, 9), dtype=np.uint8), 7, axis=1), rng.integers(0, 3, (300, 64), dtype=np.uint8), rng.integers(0, 256, (120, 64), dtype=np.uint8)]
    data = tiff.encode_pages(pages, coding, predictor, strip_rows=32, order=order)
    got = [tiff.decode_page(data, *d) for d in tiff.directories(data)]
    assert len(got) == 3
    for (x, error), want in zip(got, pages, strict=True):
        assert not error and (x[:, :, 0] == want).all()


def test_tiff_known_bytes():
    # the examples of the format's own description
    assert tiff.packbits_decode(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])).hex() == "aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa"
    assert tiff.lzw_decode(bytes([0x80, 0x01, 0xE0, 0x40, 0x80, 0x44, 0x08, 0x0C, 0x06, 0x80, 0x80])) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_tiff_tiles_planes_and_depths():
    import struct

    def build(tags, blobs):
        """One directory whose strips or tiles are the blobs."""
        out, at = bytearray(b"II*\0\0\0\0\0"), []
        for b in blobs:
            at.append(len(out))
            out += b
        tags = sorted([*tags, (tiff.TILES if any(t[0] == tiff.TILE_WIDTH for t in tags) else tiff.STRIPS, at), (tiff.TILE_BYTES if any(t[0] == tiff.TILE_WIDTH for t in tags) else tiff.STRIP_BYTES, [len(b) for b in blobs])])
        out[4:8] = struct.pack("<I", len(out))
        more, extra = bytearray(), len(out) + 2 + 12 * len(tags) + 4
        out += struct.pack("<H", len(tags))
        for tag, v in tags:
            raw = struct.pack(f"<{len(v)}I", *v)
            out += struct.pack("<HHI", tag, 4, len(v)) + (raw if len(raw) == 4 else struct.pack("<I", extra + len(more)))
            more += raw if len(raw) > 4 else b""
        return bytes(out + b"\0\0\0\0" + more)

    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (40, 50, 3), dtype=np.uint8)
    pad = np.zeros((48, 64, 3), np.uint8)
    pad[:40, :50] = x
    blobs = [zlib.compress(pad[r : r + 16, c : c + 16].tobytes()) for r in range(0, 48, 16) for c in range(0, 64, 16)]
    base = [(tiff.WIDTH, [50]), (tiff.HEIGHT, [40]), (tiff.BITS, [8]), (tiff.COMPRESSION, [8]), (tiff.SAMPLES, [3])]
    data = build([*base, (tiff.TILE_WIDTH, [16]), (tiff.TILE_HEIGHT, [16])], blobs)
    got, error = tiff.decode_page(data, *next(tiff.directories(data)))
    assert not error and (got == x).all()
    planes = [zlib.compress(x[r : r + 10, :, p].tobytes()) for p in range(3) for r in range(0, 40, 10)]
    data = build([*base, (tiff.PLANAR, [2]), (tiff.ROWS_PER_STRIP, [10])], planes)
    got, error = tiff.decode_page(data, *next(tiff.directories(data)))
    assert not error and (got == x).all()
    y = rng.integers(0, 65536, (5, 7)).astype("<u2")
    diff = np.concatenate([y[:, :1], np.diff(y, axis=1)], axis=1)
    data = build([(tiff.WIDTH, [7]), (tiff.HEIGHT, [5]), (tiff.BITS, [16]), (tiff.COMPRESSION, [1]), (tiff.PREDICTOR, [2])], [diff.tobytes()])
    got, error = tiff.decode_page(data, *next(tiff.directories(data)))
    assert not error and (got[:, :, 0] == y).all()
    bits = rng.integers(0, 2, (6, 13), dtype=np.uint8)
    data = build([(tiff.WIDTH, [13]), (tiff.HEIGHT, [6]), (tiff.BITS, [1]), (tiff.COMPRESSION, [1])], [np.packbits(bits, axis=1).tobytes()])
    got, error = tiff.decode_page(data, *next(tiff.directories(data)))
    assert not error and (got[:, :, 0] == bits).all()


def test_tiff_broken_files(spark):
    good = tiff.encode_page(np.arange(640, dtype=np.uint8).reshape(10, 64))
    loop = bytearray(good)
    n = int.from_bytes(good[4:8], "little")
    loop[n + 2 + 12 * 10 : n + 6 + 12 * 10] = good[4:8]
    rows = [(1, b""), (2, None), (3, b"not a tiff file"), (4, good[:30]), (5, good), (6, bytes(loop)), (7, good[:8] + bytes(len(good) - 8))]
    got = tiff.pages(spark.createDataFrame([(a, b, 9) for a, b in rows], "k long, media binary, page int"), "k").collect()
    assert sorted((r["k"], r["page"], r["width"], r["height"]) for r in got) == [(5, 0, 64, 10), (6, 0, 64, 10)]


def test_tiff_pages_come_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(tiff, "BATCH_BYTES", 1000)
    rows = [(i, tiff.encode_page(np.full((i + 1, 64), i, np.uint8))) for i in range(40)]
    got = tiff.pages(spark.createDataFrame(rows, "k long, media binary").coalesce(1), "k").collect()
    assert [(r["k"], bytes(r["media"]), r["height"], bytes(r["samples"])) for r in got] == [(i, m, i + 1, bytes([i]) * 64 * (i + 1)) for i, m in rows]


def test_tiff_query(spark):
    for df in (documents(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        got = sorted(tiff.digests(df).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        assert len(got) == len(rows)
        same = {}
        for g, r in zip(got, rows, strict=True):
            raw = (r["text"] or "").encode()
            full = raw + b"\0" * (-len(raw) % 64 if raw else 64)
            assert (g["doc_id"], g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (r["doc_id"], len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
            assert same.setdefault(raw, (g["media_bytes"], g["media_sha256"], g["feature"])) == (g["media_bytes"], g["media_sha256"], g["feature"])


def page_rows(spark):
    rows = [(1, "http://a/1", "same"), (2, None, "same"), (9, "http://a/9 x\r\ny", "same"), (4, "u", ""), (5, "u", None), (6, "u", "é" * 5000), (7, "u", "w " * 200_000), (7, "u", "w " * 200_000), (None, "u", "x")]
    return spark.createDataFrame([(*r, 3) for r in rows], "page_id long, url string, html string, record_type int")


def test_warc_round_trip(spark):
    df = page_rows(spark)
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    want, rows = [], [(r["page_id"], (r["html"] or "").encode()) for r in df.collect()]
    for i, body in rows:
        first = max((j for j, b in rows if b == body and j is not None), default=None)
        want.append((i or -1, len(body), warc.digest(body), "response" if i == first else "revisit", None if i == first else first))
    assert sorted(want, key=str) == sorted(got, key=str)
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_least_size(spark):
    where = fresh_dir(spark, "warc")
    warc.register(spark)
    warc.write(page_rows(spark), where, min_bytes=5)
    kinds = {r["record_id"]: r["record_type"] for r in spark.read.format("warc").load(where).where("record_id is not null").collect()}
    assert all(v == "response" for v in kinds.values())


def test_warc_pushdown(spark):
    where = fresh_dir(spark, "warc")
    warc.register(spark)
    warc.write(page_rows(spark), where)
    df = spark.read.format("warc").load(where)
    assert df.where("record_type = 'revisit'").count() == 3
    assert [r["record_id"] for r in df.where("target_uri = 'http://a/1'").collect()] == ["urn:x-page:1"]
    assert df.where("refers_to is not null and payload_length < 3").count() == 1
    assert df.where("record_id in ('urn:x-page:6', 'urn:x-page:9')").count() == 2
    assert spark.read.format("warc").option("payload", "false").load(where).where("payload is not null").count() == 0
    reader = warc.WarcReader({"path": where})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("content_length",), 3)]))
    assert len(left) == 1 and reader.equal == [("warc-type", ("revisit",))]


@pytest.mark.parametrize("pack", [lambda b: b, lambda b: zlib.compress(b, wbits=31), warc.member])
def test_warc_other_archives(pack):
    """Plain archives, members without lengths, and blocks larger than a read."""
    bodies = [b"", b"x\r\n\r\ny" * 10, b"z" * (3 << 20), b"end"]
    data = b"".join(pack(warc.record("response", i, "u", b, warc.digest(b))) for i, b in enumerate(bodies))
    got = [warc.payload_of(*r) for r in warc.records(io.BytesIO(data))]
    assert got == bodies
    skipped = [(h["warc-record-id"], b) for h, b in warc.records(io.BytesIO(data), lambda h: h["warc-record-id"].endswith((":1>", ":3>")))]
    assert [i for i, _ in skipped] == ["<urn:x-page:1>", "<urn:x-page:3>"] and warc.payload_of({"content-type": "application/http"}, skipped[1][1]) == b"end"
    assert len([1 for _, b in warc.records(io.BytesIO(data), payload=False) if b is None]) == 4
