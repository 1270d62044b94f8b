import base64
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloam.operators import pages
from gridloam.sources import files, pdf


def obj(n, body):
    return b"%d 0 obj\n%s\nendobj\n" % (n, body)


def stream(body, extra=b"", filters=b""):
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(body), extra, filters, body)


FLATE = b"/Filter /FlateDecode"
FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /fi /uni00E9 65 /B] >> >>"
CMAP = b"/CIDInit begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <6C34> <0002> <0066006C> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0078> <0079>] endbfrange endcmap"
COMPOSITE = b"<< /Type /Font /Subtype /Type0 /ToUnicode 9 0 R /DescendantFonts [<< /DW 1000 /W [1 [2000] 16 18 500] >>] >>"


def hand_made(contents, extra=b"", resources=b"/Font << /F1 5 0 R /F2 8 0 R >>", box=b"[0 0 600 800]", head=b"%PDF-1.5\n"):
    """A file of one page for each content, put together object by object; no cross-reference table is needed."""
    kids = b" ".join(b"%d 0 R" % (20 + 2 * i) for i in range(len(contents)))
    out = head + obj(1, b"<< /Type /Catalog /Pages 2 0 R >>") + obj(2, b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox %s /Resources << %s >> >>" % (kids, len(contents), box, resources))
    out += obj(5, FONT) + obj(8, COMPOSITE) + obj(9, stream(zlib.compress(CMAP), filters=FLATE)) + extra
    for i, c in enumerate(contents):
        out += obj(20 + 2 * i, b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (21 + 2 * i)) + obj(21 + 2 * i, c if c.startswith(b"<<") else stream(c))
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def of(raw, kind):
    return [i for i in pdf.items(raw) if i[1] == kind]


def texts(raw):
    return [i[7] for i in of(raw, "block")]


def test_text_and_places():
    """Moves, spacing, escapes, encodings and a composite font, each by hand."""
    content = rb"BT /F1 10 Tf 100 700 Td (Hello) Tj 0 -12 Td [(W) 50 (or) -300 (ld \(1\) \101\n)] TJ T* ET q 1 0 0 1 50 0 cm BT /F1 10 Tf 1 0 0 1 250 400 Tm <0102> Tj ET Q BT /F2 20 Tf 100 200 Td <0001000200100011> Tj <00200021> Tj ET"
    got = of(hand_made([content]), "block")
    assert [g[7] for g in got] == ["Hello\nWor ld (1) B", "ﬁé", "水flABxy"]
    # five codes of 500 thousandths at 10 points, 100 points from the left, the base line 100 from the top
    assert got[0][3:5] == (100.0, 92.0)
    assert got[1][3] == 300.0 and got[1][4] == pytest.approx(392.0)
    assert got[2][5] == pytest.approx(100 + 20 * (2 + 1 + 0.5 + 0.5) + 2 * 20)
    assert [w[7] for w in of(hand_made([content]), "word")] == ["Hello", "W", "or", "ld", "(1)", "B", "ﬁé", "水flAB", "xy"]


def test_blocks_and_columns():
    content = b"".join(b"BT /F1 10 Tf %d %d Td (%s) Tj ET " % (x, y, t) for x, y, t in ((50, 700, b"left one"), (300, 700, b"right one"), (50, 688, b"left two"), (300, 688, b"right two"), (50, 600, b"far below")))
    assert sorted(texts(hand_made([content]))) == ["far below", "left one\nleft two", "right one\nright two"]


@pytest.mark.parametrize("how", ["flate", "predicted", "lzw", "hex", "a85", "run", "two"])
def test_filters(how):
    raw = b"BT /F1 10 Tf 10 10 Td (" + b"abc " * 30 + b") Tj ET"
    if how == "flate":
        body = stream(zlib.compress(raw), filters=FLATE)
    elif how == "predicted":
        rows = [raw.ljust(-(-len(raw) // 16) * 16)[a : a + 16] for a in range(0, len(raw), 16)]
        coded, up = b"", bytes(16)
        for i, r in enumerate(rows):
            kind = i % 5
            left = bytes([0, *r[:-1]])
            corner = bytes([0, *up[:-1]])
            paeth = [min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] for a, b, c in zip(left, up, corner, strict=True)]
            guess = (bytes(16), left, up, bytes((a + b) // 2 for a, b in zip(left, up, strict=True)), bytes(paeth))[kind]
            coded += bytes([kind]) + bytes((x - g) & 255 for x, g in zip(r, guess, strict=True))
            up = r
        body = stream(zlib.compress(coded), filters=FLATE + b" /DecodeParms << /Predictor 15 /Columns 16 >>")
    elif how == "lzw":
        from .test_geotiff import lzw

        body = stream(lzw(raw), filters=b"/Filter /LZWDecode")
    elif how == "hex":
        body = stream(raw.hex().encode() + b">", filters=b"/Filter /ASCIIHexDecode")
    elif how == "a85":
        body = stream(base64.a85encode(raw) + b"~>", filters=b"/Filter /ASCII85Decode")
    elif how == "run":
        body = stream(b"".join(bytes([len(raw[a : a + 100]) - 1]) + raw[a : a + 100] for a in range(0, len(raw), 100)) + b"\x80", filters=b"/Filter /RunLengthDecode")
    else:
        body = stream(zlib.compress(raw).hex().encode(), filters=b"/Filter [/AHx /FlateDecode]")
    assert texts(hand_made([body])) == [" ".join(["abc"] * 30)]


def test_object_streams_versions_and_damage():
    """Objects within streams, a later version of an object, a wrong length, and a file cut short."""
    packed = b"1 0 2 38 20 120 " + b"<< /Type /Catalog /Pages 2 0 R >>".ljust(38) + b"<< /Type /Pages /Kids [20 0 R] /Count 1 >>".ljust(82) + b"<< /Type /Page /Parent 2 0 R /Contents 21 0 R /Resources << /Font << /F1 5 0 R >> >> >>"
    body = stream(zlib.compress(packed), b"/Type /ObjStm /N 3 /First 16", FLATE)
    content = b"BT /F1 9 Tf 5 5 Td (in streams) Tj ET"
    raw = b"%PDF-1.5\n" + obj(5, FONT) + obj(7, body) + obj(21, b"<< /Length 99999 >>\nstream\n" + content + b"\nendstream")
    raw += obj(30, stream(b"", b"/Type /XRef /Root 1 0 R"))
    assert texts(raw) == ["in streams"]
    assert texts(raw + obj(21, stream(content.replace(b"streams", b"updates")))) == ["in updates"]
    whole = hand_made([b"BT /F1 9 Tf 5 5 Td (first) Tj ET", b"BT /F1 9 Tf 5 5 Td (second) Tj ET"])
    assert texts(whole[: whole.index(b"second") + 10]) == ["first", "second"]


def test_forms_images_and_rules():
    rng = np.random.default_rng(0)
    grey, rgb, small = rng.bytes(160 * 150), rng.bytes(200 * 180 * 3), rng.bytes(20 * 20)
    image = lambda n, raw, w, h, space, f=b"": obj(n, stream(raw, b"/Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /ColorSpace /%s" % (w, h, space), f))
    extra = image(40, zlib.compress(grey), 160, 150, b"DeviceGray", FLATE) + image(41, rgb, 200, 180, b"DeviceRGB") + image(42, small, 20, 20, b"DeviceGray")
    extra += image(43, b"\xff\xd8jpeg", 300, 300, b"DeviceRGB", b"/Filter /DCTDecode") + image(44, b"x" * 10, 300, 300, b"DeviceCMYK")
    extra += obj(45, stream(b"q 2 0 0 2 0 0 cm /Im0 Do Q 10 10 m 110 10 l S", b"/Subtype /Form /Matrix [1 0 0 1 5 5] /Resources << /XObject << /Im0 40 0 R >> >>"))
    content = b"q 200 0 0 100 50 500 cm /A Do Q /B Do /C Do /D Do /E Do BI /W 1 ID xx EI 30 30 200 1 re f 0 0 m 50 50 l S 7 7 m 7 99 l n"
    raw = hand_made([content], extra, b"/XObject << /A 41 0 R /B 42 0 R /C 43 0 R /D 44 0 R /E 45 0 R >>")
    got = of(raw, "image")
    assert [(g[8], g[9], g[10] is not None) for g in got] == [(200, 180, True), (20, 20, True), (300, 300, True), (300, 300, False), (160, 150, True)]
    assert got[0][3:7] == (50.0, 200.0, 250.0, 300.0) and got[2][10] == b"\xff\xd8jpeg" and got[4][3:7] == (5.0, 793.0, 7.0, 795.0)
    png = got[4][10]
    at = png.index(b"IDAT")
    rows = zlib.decompress(png[at + 4 : at + 4 + struct.unpack(">I", png[at - 4 : at])[0]])
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and b"".join(rows[a + 1 : a + 161] for a in range(0, len(rows), 161)) == grey
    rules = [r[3:7] for r in of(raw, "rule")]
    assert (15.0, 785.0, 115.0, 785.0) in rules and (30.0, 770.0, 230.0, 770.0) in rules and len(rules) == 3


@pytest.mark.parametrize(
    ("raw", "said"),
    [
        (b"", "no PDF"),
        (b"plain text", "no PDF"),
        (b"%PDF-1.4\nnothing here", "no pages"),
        (hand_made([b""]).replace(b"trailer << ", b"trailer << /Encrypt 3 0 R "), "encrypted"),
        (hand_made([stream(b"zzz", filters=b"/Filter /Unknown")]), "Unknown"),
        (hand_made([stream(b"not deflated", filters=FLATE)]), "error"),
    ],
)
def test_broken_files_are_reported(raw, said):
    got = list(pdf.items(raw))
    assert got and got[0][1] == "error" and said in got[0][7]


def test_any_damage_is_reported():
    raw = hand_made([b"BT /F1 10 Tf 10 10 Td (" + b"abc " * 9 + b") Tj ET 0 0 m 90 0 l S"] * 2)
    rng = np.random.default_rng(1)
    for _ in range(300):
        at, n = int(rng.integers(9, len(raw))), int(rng.integers(1, 9))
        for _item in pdf.items(raw[:at] + rng.bytes(n) + raw[at + n :]):
            pass


def table_content(rows, x0=100, top=700, wide=120, high=20, caption=b""):
    out = b"".join(b"%d %d m %d %d l S " % (x0, top - i * high, x0 + wide * len(rows[0]), top - i * high) for i in range(len(rows) + 1))
    out += b"".join(b"%d %d m %d %d l S " % (x0 + j * wide, top, x0 + j * wide, top - high * len(rows)) for j in range(len(rows[0]) + 1))
    out += b"".join(b"BT /F1 10 Tf %d %d Td (%s) Tj ET " % (x0 + j * wide + 5, top - i * high - 14, t) for i, r in enumerate(rows) for j, t in enumerate(r))
    return out + (b"BT /F1 10 Tf %d %d Td (%s) Tj ET " % (x0, top - len(rows) * high - 30, caption) if caption else b"")


def test_figures_and_tables_of_files(spark, tmp_path):
    big = obj(40, stream(zlib.compress(bytes(200 * 200)), b"/Subtype /Image /Width 200 /Height 200 /BitsPerComponent 8 /ColorSpace /DeviceGray", FLATE))
    small = obj(41, stream(bytes(100), b"/Subtype /Image /Width 10 /Height 10 /BitsPerComponent 8 /ColorSpace /DeviceGray"))
    figure = b"q 200 0 0 200 100 400 cm /A Do Q q 10 0 0 10 0 0 cm /B Do Q BT /F1 10 Tf 100 370 Td (Figure 4: soil by depth) Tj ET"
    lone = b"q 200 0 0 200 100 400 cm /A Do Q"
    tables_ = table_content([[b"site", b"rain fall"], [b"goa", b"3000"], [b"", b"12 mm"]], caption=b"Table 2. Rain") + table_content([[b"one row", b"only"]], top=500) + table_content([[b"a"], [b"b"]], top=300)
    raw = hand_made([figure, tables_, lone], big + small, b"/Font << /F1 5 0 R >> /XObject << /A 40 0 R /B 41 0 R >>")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "study.pdf").write_bytes(raw)
    (tmp_path / "in" / "broken.PDF").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "in" / "notes.txt").write_text("some notes")
    items = pdf.read(spark, str(tmp_path / "in"))
    assert [r["text"] for r in items.where("kind = 'error'").collect()] == ["BadPdf: the file has no pages"]
    got = [(r["source"], r["page"], r["idx"], r["caption"], r["width"]) for r in pages.figures(items).orderBy("idx").collect()]
    assert got == [("study.pdf", 1, 4, "Figure 4: soil by depth", 200), ("study.pdf", 3, 5, None, 200)]
    found = pages.tables(items).orderBy("idx").collect()
    assert [(r["page"], r["idx"], r["caption"], r["text"]) for r in found] == [(2, 1, "Table 2. Rain", "site | rain fall\ngoa | 3000\n | 12 mm"), (2, 2, "Table on page 2", "a\nb")]
    assert "goa" in found[0]["page_text"] and pages.tables(items, 1).count() == 1 and pages.figures(items, 201).count() == 0
    docs = {r["source"]: r["text"] for r in files.read_documents(spark, str(tmp_path / "in")).collect()}
    assert set(docs) == {"study.pdf", "notes.txt"} and docs["study.pdf"].startswith("Figure 4: soil by depth") and "12 mm" in docs["study.pdf"]
    assert pages.tables(items.where(F.lit(False))).count() == 0 and pages.figures(items.where(F.lit(False))).count() == 0
