"""Text runs from files that are written here."""

import zlib

import pytest

from folioweave.sources import pdf, readers


def plain(objects, tail=b""):
    """A file with a cross-reference table; objects by number from 1."""
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + o + b"\nendobj\n"
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + table + b"trailer <</Size %d/Root 1 0 R%s>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, tail, len(out))


def stream(data, about=b"", pack=True):
    data = zlib.compress(data) if pack else data
    return b"<<%s/Length %d%s>>\nstream\n" % (about, len(data), b"/Filter/FlateDecode" if pack else b"") + data + b"\nendstream"


WIDTHS = b"/FirstChar 32/Widths[" + b" ".join(b"500" for _ in range(224)) + b"]"
TIMES = b"<</Type/Font/Subtype/Type1/BaseFont/ABCDEF+Times-Bold/Encoding/WinAnsiEncoding" + WIDTHS + b">>"
TREE = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 600 800]/Resources<</Font<</F1 5 0 R/F2 6 0 R>>>>>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>"]


def compact(objects):
    """A file with a cross-reference stream (Up predictor); all but streams stand in an object stream."""
    inner = [(i, o) for i, o in enumerate(objects, 1) if b"stream\n" not in o]
    head, body = b"", b""
    for i, o in inner:
        head += b"%d %d " % (i, len(body))
        body += o + b" "
    holder = len(objects) + 1
    out, rows = b"%PDF-1.5\n", {0: (0, 0, 255)}
    outer = [(i, o) for i, o in enumerate(objects, 1) if b"stream\n" in o] + [(holder, stream(head + body, b"/Type/ObjStm/N %d/First %d" % (len(inner), len(head))))]
    for i, o in outer:
        rows[i] = (1, len(out), 0)
        out += b"%d 0 obj\n" % i + o + b"\nendobj\n"
    rows |= {i: (2, holder, k) for k, (i, _) in enumerate(inner)}
    rows[holder + 1] = (1, len(out), 0)
    flat, before = b"", bytes(6)
    for n in range(holder + 2):
        kind, a, b = rows[n]
        row = bytes([kind]) + a.to_bytes(4, "big") + bytes([b])
        flat += b"\2" + bytes((x - y) & 255 for x, y in zip(row, before, strict=True))
        before = row
    about = b"/Type/XRef/Size %d/Root 1 0 R/W[1 4 1]/DecodeParms<</Predictor 12/Columns 6>>" % (holder + 2)
    return out + b"%d 0 obj\n" % (holder + 1) + stream(flat, about) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % len(out)


CMAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <00C4> <0002> <D83DDE42> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange 1 beginbfrange <0020> <0021> [<00660069> <0078>] endbfrange"
ROMAN = b"<</Type/Font/Subtype/Type1/BaseFont/CMR10/Encoding<</Differences[1/ff/uni03B1 65/B]>>/FirstChar 0/Widths[" + b"400 " * 128 + b"]/FontDescriptor<</Flags 64/Ascent 700/Descent -300>>>>"
WIDE = [b"<</Type/Font/Subtype/Type0/BaseFont/Sans/Encoding/Identity-H/DescendantFonts[<</Subtype/CIDFontType2/DW 1000/W[1[250 750] 16 18 600]>>]/ToUnicode 7 0 R>>", stream(CMAP)]


def rows(spark, *found):
    df = spark.createDataFrame([(f"f{i}", x) for i, x in enumerate(found)], "path string, content binary")
    out = pdf.page_texts(pdf.pages(df))
    return [r.asDict() for r in pdf.runs(out).orderBy("doc", "page", "id").collect()], sorted((r["doc"], r["page"], r["problem"]) for r in pdf.problems(out).collect())


@pytest.mark.parametrize("write", [plain, compact])
def test_runs(spark, write):
    content = rb"""% a comment with (brackets
BT /F1 12 Tf 1 0 0 1 40 740 Tm (Theorem) Tj ( ) Tj (2.4\. \(a\) \101\
b) Tj 0 -17 TD [(Next) -300 (word) 20 (s)] TJ T* <4142> Tj ET
q 2 0 0 2 10 10 cm BT /F2 5 Tf 0 0 Td (\001\002A) Tj ET Q BI /W 1 ID \377\000(EI
BT /F2 10 Tf 300 100 Td 200 Tz (A) ' ET"""
    got, bad = rows(spark, write([*TREE, stream(content), TIMES, ROMAN]))
    assert bad == []
    assert [r["text"] for r in got] == ["Theorem 2.4. (a) Ab", "Next words", "AB", "ffαB", "B"]
    first = got[0]
    assert (first["page"], first["font"], first["size"], first["bold"], first["italic"]) == (1, "Times-Bold", 12.0, True, False)
    assert [round(first[c], 6) for c in ("x0", "y0", "x1", "y1")] == [40.0, 800 - 740 - 9.6, 40 + 19 * 6, 800 - 740 + 2.4]
    assert round(got[1]["x1"], 6) == round(40 + 9 * 6 + 3.6 - 0.24, 6)
    assert got[3]["italic"] and got[3]["size"] == 10.0 and round(got[3]["x1"], 6) == 10 + 3 * 0.4 * 10
    assert round(got[4]["x1"], 6) == 300 + 8.0
    assert [r["line"] for r in got] == [0, 1, 2, 3, 4]
    assert [r["block"] for r in got][:3] == [0, 0, 0] and got[3]["block"] == 1


def test_unicode_maps_and_blank_runs(spark):
    content = b"BT /F2 10 Tf 0 100 Td <000100020010001100120020> Tj ET BT /F1 10 Tf 0 50 Td (Proof) Tj 60 0 Td ( ) Tj ET"
    got, bad = rows(spark, plain([*TREE, stream(content, pack=False), TIMES, *WIDE]))
    assert [r["text"] for r in got] == ["Ä🙂abcfi", "Proof "] and bad == []
    assert round(got[0]["x1"], 6) == (250 + 750 + 3 * 600 + 1000) / 100


def test_what_is_not_read_is_reported(spark):
    page = lambda content, *fonts: plain([*TREE, content, *fonts])
    lone = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>"
    dumb = WIDE[0].replace(b"/ToUnicode 7 0 R", b"")
    text = stream(b"BT /F1 9 Tf (A\200) Tj /F2 9 Tf (AB) Tj ET")
    got, bad = rows(
        spark,
        b"no pdf",
        b"",
        plain([*TREE, text, TIMES, TIMES], b"/Encrypt 9 0 R"),
        page(b"<</Length 2/Filter/LZWDecode>>\nstream\nxx\nendstream", TIMES, TIMES),
        page(text, lone, dumb),
        plain([b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R 4 0 R]>>", b"<</Type/Page/Contents 9 0 R>>", b"<</Type/Page/Contents 5 0 R/Resources<</Font<</F1 6 0 R>>>>>>", stream(b"BT /F1 9 Tf (ok) Tj ET"), TIMES]),
        page(stream(b"BT /F1 9 Tf (never ends"), TIMES, TIMES),
    )
    reported = {(d, p): why for d, p, why in bad}
    assert reported["f0", None] == reported["f1", None] == "no cross-references"
    assert reported["f2", None] == "encryption" and reported["f3", 1] == "filter LZWDecode"
    assert "no widths of Helvetica" in reported["f4", 1] and "without a map" in reported["f4", 1] and "code 128 of Helvetica" in reported["f4", 1]
    assert ("f5", 1) in reported and ("f5", 2) not in reported and reported["f6", 1] == "a string has no end"
    assert [(r["doc"], r["page"], r["text"]) for r in got if r["doc"] == "f5"] == [("f5", 2, "ok")]


def test_folder_and_lines(spark, tmp_path):
    """Files of a folder; what they say goes on to lines and anchors."""
    content = b"BT /F1 12 Tf 40 740 Td (Problem 1. Use the dimension) Tj 0 -17 Td (theorem to see Lemma 2.) Tj ET"
    (tmp_path / "b.pdf").write_bytes(plain([*TREE, stream(content), TIMES, ROMAN]))
    (tmp_path / "a.pdf").write_bytes(compact([*TREE, stream(content), TIMES, ROMAN]))
    (tmp_path / "c.txt").write_bytes(b"x")
    found = pdf.read(spark, f"file://{tmp_path}")
    assert readers.files(spark, f"file://{tmp_path}").count() == 2 and pdf.problems(found).isEmpty()
    from folioweave.operators import mentions

    anchors = mentions.anchor_boxes(pdf.runs(found), spark.createDataFrame([], "doc string, label string, page int, block long")).collect()
    boxes = [(r["surface"], r["y1"] - r["y0"]) for r in anchors if r["doc"].endswith("a.pdf")]
    assert sorted(s for s, _ in boxes) == ["Lemma 2", "the dimension theorem", "the dimension theorem"] and all(h < 20 for _, h in boxes)


def test_pages_of_one_file_spread(spark):
    pages = [b"<</Type/Page/Contents %d 0 R/Resources<</Font<</F1 4 0 R>>>>>>" % (5 + i) for i in range(40)]
    kids = b" ".join(b"%d 0 R" % (5 + 40 + i) for i in range(40))
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[%s]>>" % kids, b"null", TIMES, *[stream(b"BT /F1 9 Tf (page %d) Tj ET" % i) for i in range(40)], *pages]
    df = spark.createDataFrame([("f", plain(objects))], "path string, content binary")
    out = pdf.page_texts(pdf.pages(df), 8)
    assert [r["text"] for r in pdf.runs(out).orderBy("page").collect()] == [f"page {i}" for i in range(40)]
    from pyspark.sql import functions as F

    assert out.select(F.spark_partition_id()).distinct().count() > 3
