"""Edits and conversions of files: round trips and stated values."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.functions import package_edit, packages, pdf, pdf_edit, rasters
from quillframe.operators import conversions
from quillframe.sources import files


def _page_texts(content):
    found = {}
    for letter in pdf.letters(content):
        found[letter[0]] = found.get(letter[0], "") + letter[2]
    return [found[k] for k in sorted(found)]


def test_pdf_pages_move(spark):
    both = pdf_edit.merged([pdf.write_text([["one"], ["two"]]), pdf.write_text([["three"]])])
    assert _page_texts(both) == ["one", "two", "three"]
    turned = pdf_edit.extracted(both, [3, 1], 90)
    assert _page_texts(turned) == ["three", "one"] and [b[5] for b in pdf.page_boxes(turned)] == [90, 90]
    with pytest.raises(ValueError):
        pdf_edit.extracted(both, [4])
    parts = files.pdf_parts(spark.createDataFrame([("p", bytearray(both))], "path string, content binary"), 2).orderBy("part").collect()
    assert [_page_texts(bytes(r.content)) for r in parts] == [["one", "two"], ["three"]]


def test_pdf_description_and_form(spark):
    objects = [
        b"<</Type/Catalog/Pages 2 0 R/AcroForm<</Fields[4 0 R 6 0 R]>>>>", b"<</Type/Pages/Kids[]/Count 0>>", b"<</Title(A\\)b)/Author<FEFF00E9>/CreationDate(D:20240230101500-02'30')/ModDate(D:20240131)>>",
        b"<</T(person)/FT/Tx/Kids[5 0 R]>>", b"<</T(name)/V(Ann)/Ff 2>>", b"<</T(colour)/FT/Ch/V(b)/Opt[(a)[(b)(Blue)]]>>",
    ]
    data = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in enumerate(objects, 1)) + b"trailer\n<</Root 1 0 R/Info 3 0 R>>\n"
    df = spark.createDataFrame([("p", bytearray(data)), ("bad", bytearray(b"x"))], "path string, content binary")
    found = files.pdf_information(df).withColumn("changed", F.col("changed").cast("string")).collect()
    assert [(r.title, r.author, r.created, r.changed) for r in found] == [("A)b", "é", None, "2024-01-31 00:00:00")]
    assert [tuple(r)[1:] for r in files.pdf_form_fields(df).collect()] == [("person.name", "Tx", "Ann", 2, []), ("colour", "Ch", "b", 0, ["a", "Blue"])]


def test_bmp():
    pixels = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    body = b"".join(row[:, ::-1].tobytes().ljust(24, b"\0") for row in pixels[::-1])
    assert (rasters.decode(b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(body), 0, 54, 40, 7, 5, 1, 24, 0, 0, 0, 0, 0, 0) + body) == pixels).all()
    runs = bytes([3, 1, 0, 0, 0, 3, 0, 1, 0, 0, 0, 1])
    small = b"BM" + struct.pack("<IIIIiiHHIIiiII", 0, 0, 62, 40, 3, 2, 1, 8, 1, 0, 0, 0, 2, 0) + bytes([0, 0, 255, 0, 255, 0, 0, 0]) + runs
    assert rasters.decode(small)[:, :, 2].tolist() == [[0, 255, 0], [255, 255, 255]] and rasters.decode(small)[0, 0].tolist() == [255, 0, 0]


def test_gif():
    # Codes of three bits, cleared before each pixel so that the width never grows: clear 4, pixel, ..., end 5.
    index = [0, 1, 2, 3, 0, 1]
    bits = "".join(f"{c:03b}"[::-1] for p in index for c in (4, p)) + "101"
    body = bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))
    palette = bytes(range(12))
    data = b"GIF89a" + struct.pack("<HHBBB", 4, 2, 0x81, 0, 0) + palette + b"\x21\xf9\x04\x01\0\0\x03\0" + b"\x2c" + struct.pack("<HHHHB", 1, 0, 3, 2, 0) + bytes([2, len(body)]) + body + b"\0\x3b"
    made = rasters.decode(data)
    assert made.shape == (2, 4, 4) and made[:, 0].tolist() == [[0] * 4] * 2
    assert made[0, 1].tolist() == [0, 1, 2, 255] and made[1, 1].tolist() == [9, 10, 11, 0] and made[1, 3].tolist() == [3, 4, 5, 255]
    with pytest.raises(ValueError):
        rasters.decode(data[:20])


@pytest.mark.parametrize("packing", [1, 8, 32773])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff(packing, order):
    pixels = np.random.default_rng(2).integers(0, 256, (4, 5, 3)).astype(np.uint8)
    pack = {1: bytes, 8: zlib.compress, 32773: lambda b: b"".join(bytes([len(b[k : k + 100]) - 1]) + b[k : k + 100] for k in range(0, len(b), 100)) + b"\x80"}[packing]
    strips = [pack(pixels[k : k + 3].tobytes()) for k in (0, 3)]
    offsets = [8, 8 + len(strips[0])]
    extra = 8 + sum(map(len, strips))
    tail = struct.pack(order + "HHH", 8, 8, 8) + struct.pack(order + "II", *offsets) + struct.pack(order + "II", *map(len, strips))
    entries = [(256, 3, 1, 5), (257, 3, 1, 4), (258, 3, 3, extra), (259, 3, 1, packing), (262, 3, 1, 2), (273, 4, 2, extra + 6), (277, 3, 1, 3), (278, 3, 1, 3), (279, 4, 2, extra + 14)]
    table = struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", t, k, n) + (struct.pack(order + "HH", v, 0) if k == 3 and n == 1 else struct.pack(order + "I", v)) for t, k, n, v in entries) + b"\0\0\0\0"
    data = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", extra + len(tail)) + b"".join(strips) + tail + table
    assert (rasters.decode(data) == pixels).all()


def test_workbook_edits(spark):
    made = packages.write_workbook([("S", 1, 1, "num", 1.0, None, None, None, None, "0.00"), ("S", 3, 2, "num", 2.0, None, None, None, "A1*2", None)])
    edits = [("p", "S", "A1", "text", "x<y", 1), ("p", "S", "B3", "num", "7.5", 2), ("p", "S", "C2", "bool", "true", 3), ("p", "S", "A3", "formula", "=B3+1", 4), ("q", "T", "A1", "num", "1", 1)]
    source = spark.createDataFrame([("p", bytearray(made)), ("q", bytearray(made))], "path string, content binary")
    found = {r.path: r for r in files.edited_workbooks(source, spark.createDataFrame(edits, "path string, sheet string, ref string, kind string, value string, position int")).collect()}
    assert found["q"].edited is None and found["q"].problem == "no sheet T"
    rows = [(c[2], c[3], c[4], c[5], c[6], c[7], c[9], c[10]) for c in packages.workbook_cells(bytes(found["p"].edited))]
    assert rows == [(1, 1, "text", None, "x<y", None, None, "0.00"), (2, 3, "bool", None, None, True, None, "General"), (3, 1, "blank", None, None, None, "B3+1", "General"), (3, 2, "num", 7.5, None, None, None, "General")]
    assert b'fullCalcOnLoad="1"' in packages.Package(bytes(found["p"].edited)).part("xl/workbook.xml")


def test_tracked_changes_settle():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:rPr><w:del w:id="1"/></w:rPr></w:pPr><w:r><w:t>a</w:t></w:r><w:ins w:id="2"><w:r><w:t>b</w:t></w:r></w:ins></w:p><w:p><w:del w:id="3"><w:r><w:delText>c</w:delText></w:r></w:del><w:r><w:t>d</w:t></w:r></w:p></w:body></w:document>'
    made = packages.write_document([(None, "")])
    content = package_edit._with_parts(packages.Package(made), {"word/document.xml": body.encode()})
    texts = lambda c: [p[7] for p in packages.document_paragraphs(c)]
    assert texts(package_edit.settled_document(content)) == ["abd"]
    assert texts(package_edit.settled_document(content, accept=False)) == ["a", "cd"]


def test_chart_points():
    c = 'xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rels = lambda *r: ('<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="http://x/{kind}" Target="{t}"/>' for k, kind, t in r) + "</Relationships>").encode()
    series = '<c:ser><c:tx><c:strRef><c:f>S!A1</c:f><c:strCache><c:pt idx="0"><c:v>n</c:v></c:pt></c:strCache></c:strRef></c:tx><c:cat><c:strLit><c:pt idx="1"><c:v>k</c:v></c:pt></c:strLit></c:cat><c:val><c:numRef><c:f>S!B1:B2</c:f><c:numCache><c:pt idx="0"><c:v>2</c:v></c:pt><c:pt idx="1"><c:v>x</c:v></c:pt></c:numCache></c:numRef></c:val></c:ser><c:ser><c:val><c:numRef><c:f>S!C1</c:f></c:numRef></c:val></c:ser>'
    made = packages.Package(packages.write_workbook([("S", 1, 1, "num", 1.0, None, None, None, None, None)]))
    add = {
        "xl/worksheets/_rels/sheet1.xml.rels": rels((1, "drawing", "../drawings/d.xml")), "xl/drawings/d.xml": f'<x {c}><c:chart r:id="rId1"/><c:chart r:id="rId2"/></x>'.encode(), "xl/drawings/_rels/d.xml.rels": rels((1, "chart", "../c.xml"), (2, "chart", "../e.xml")),
        "xl/c.xml": f"<c:chartSpace {c}><c:chart><c:plotArea><c:barChart>{series}</c:barChart></c:plotArea></c:chart></c:chartSpace>".encode(), "xl/e.xml": f"<c:chartSpace {c}><c:chart><c:plotArea><c:radarChart/></c:plotArea></c:chart></c:chartSpace>".encode(),
    }
    import io
    import zipfile

    out = io.BytesIO(package_edit._with_parts(made, {}))
    with zipfile.ZipFile(out, "a") as z:
        for name, data in add.items():
            z.writestr(name, data)
    assert list(package_edit.chart_points(out.getvalue())) == [
        ("S", 1, "barChart", None, 1, "n", "S!B1:B2", 0, None, 2.0), ("S", 1, "barChart", None, 1, "n", "S!B1:B2", 1, "k", None), ("S", 1, "barChart", None, 2, None, "S!C1", None, None, None), ("S", 2, "radarChart", None, None, None, None, None, None, None),
    ]


def test_sheets_and_documents_as_text(spark):
    cells = spark.createDataFrame([("s", 1, 1, "=a", "text"), ("s", 1, 3, "-5", "num"), ("s", 3, 2, 'x"<', "text")], "sheet string, row int, col int, shown string, kind string")
    assert [r.record for r in conversions.sheet_csv(cells, ["sheet"]).orderBy("row").collect()] == ["'=a,,-5", ",,", ',"x""<",']
    assert conversions.sheet_html(cells, ["sheet"]).first().html == '<table><tr><td>=a</td><td></td><td class="n">-5</td></tr><tr><td></td><td></td><td></td></tr><tr><td></td><td>x&quot;&lt;</td><td></td></tr></table>'
    with pytest.raises(Exception, match="more cells than allowed"):
        conversions.sheet_csv(cells, ["sheet"], most=8).collect()
    made = packages.write_document([("Heading1", "C #"), (None, "1. a*b"), (None, ""), ("Heading 2", "x")])
    found = files.paragraphs(spark.createDataFrame([("d", bytearray(made))], "path string, content binary"))
    assert conversions.document_markdown(found).first().markdown == "# C \\#\n\n1\\. a\\*b\n\n## x"
    assert [(r.level, r.text) for r in conversions.contents_rows(found).orderBy("para_ix").collect()] == [(1, "C #"), (2, "x")]


def test_reading_order(spark):
    # A title over two columns, the left one of two blocks.
    blocks = [("p", "right", 55.0, 10.0, 100.0, 80.0), ("p", "low", 0.0, 10.0, 45.0, 40.0), ("p", "title", 0.0, 95.0, 100.0, 110.0), ("p", "high", 0.0, 42.0, 45.0, 80.0), ("q", "b", 5.0, 0.0, 10.0, 10.0), ("q", "a", 0.0, 0.0, 10.0, 10.0)]
    df = spark.createDataFrame(blocks, "doc string, block string, left double, bottom double, right double, top double")
    found = conversions.reading_order(df, ["doc"]).orderBy("doc", "place").collect()
    assert [r.block for r in found] == ["title", "high", "low", "right", "a", "b"] and [r.place for r in found] == [1, 2, 3, 4, 1, 2]


def test_gaps(spark):
    templates = spark.createDataFrame([("a", "en", "{0} and {1}"), ("a", "fr", "{1} et {0}")], "code string, culture string, template string")
    gaps = spark.createDataFrame([(1, 1, "a", ["{1}", "y"]), (1, 2, "a", ["{1}", "y"]), (1, 3, "b", [])], "doc int, n int, code string, arguments array<string>")
    found = conversions.gap_messages(gaps, templates, "fr")
    assert [(r.n, r.message) for r in conversions.gap_union(found, "doc", "n").orderBy("n").collect()] == [(1, "y et {1}"), (3, None)]
    assert {r.message for r in conversions.gap_messages(gaps, templates, "de").collect()} == {"{1} and y", None}


def test_sheets_of_odd_cells(spark, monkeypatch):
    monkeypatch.setattr(conversions, "ROWS_AT_ONCE", 2)
    cells = spark.createDataFrame([(None, 2**40, 2, "=a", "text"), (None, 2**40 + 6, None, "x", "text"), (None, None, 3, "x", "text"), ("s", 5, 1, "b,", "text"), ("none", 1, None, "x", "text")], "sheet string, row long, col int, shown string, kind string")
    found = [(r.sheet, r.row, r.record) for r in conversions.sheet_csv(cells, ["sheet"], most=None).orderBy("sheet", "row").collect()]
    assert found == [(None, 2**40, "'=a,"), *[(None, 2**40 + k, ",") for k in range(1, 7)], ("s", 5, '"b,"')]
    assert conversions.sheet_csv(cells, ["sheet"], neutralise=False, quoting="never").where("sheet = 's' or row = 1L << 40").orderBy("row").collect() == [("s", 5, "b,"), (None, 2**40, "=a,")]
