"""Word files made by hand, damaged ones, and long chains of styles."""

import io
import zipfile

from quillspark.sources import word as W

DOCUMENT = """<?xml version="1.0"?><w:document xmlns:w="m"><w:body><!-- a <w:p> that is none -->
<w:p w:rsidR="1"><w:pPr><w:pStyle w:val="Title"/><w:jc w:val="Center"/><w:spacing w:before="240" w:after="60"/><w:rPr><w:b/><w:sz w:val="99"/></w:rPr></w:pPr><w:r><w:t>A &amp; &lt;B&gt;</w:t></w:r><w:r><w:rPr><w:b w:val="0"/><w:i/><w:color w:val="ff00aa"/></w:rPr><w:t xml:space="preserve"> c</w:t><w:tab/><w:t>d</w:t></w:r></w:p>
<w:p/><w:p><w:pPr><w:pStyle w:val="heading2"/><w:pageBreakBefore/></w:pPr><w:r><w:rPr><w:b w:val="true"/></w:rPr><w:t>Two</w:t></w:r></w:p>
<w:p><w:pPr><w:pStyle w:val="MyCallout"/></w:pPr><w:r><w:t>careful</w:t></w:r><w:r><w:br w:type="page"/></w:r></w:p>
<w:p><w:pPr><w:shd w:val="clear" w:fill="abCDef"/><w:pBdr><w:left w:val="single" w:color="112233"/></w:pBdr><w:jc w:val="both"/></w:pPr><w:r><w:t>shaded</w:t></w:r></w:p>
<w:tbl><w:tblGrid><w:gridCol w:w="2000"/></w:tblGrid><w:tr><w:tc><w:tcPr><w:shd w:fill="00FF00"/><w:tcBorders><w:top w:val="single" w:sz="16" w:color="ABCDEF"/></w:tcBorders></w:tcPr><w:p><w:r><w:t>x</w:t></w:r></w:p><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc>
<w:tc><w:p><w:r><w:t>outer</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>
<w:p><w:r><w:t>end</w:t></w:r></w:p><w:sectPr><w:pgSz w:w="11900" w:h="16840"/><w:pgMar w:top="720" w:left="1000"/></w:sectPr></w:body></w:document>"""


def packed(**parts):
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(f"word/{name}.xml", text)
    return bytearray(blob.getvalue())


def test_paragraphs_runs_and_cells(spark):
    files = spark.createDataFrame([(1, packed(document=DOCUMENT))], "id int, content binary")
    tokens = W.word_tokens(W.word_parts(files, ["id"]), ["id"]).cache()
    got = [(r.block, r.in_table, r.style, r.level, r.align, r.before, r.after, r.callout, r.background, r.border, r.break_before, r.page_break, r.text) for r in W.word_paragraphs(tokens, ["id"]).orderBy("p").collect()]
    plain = ("", None, "left", 0.0, 6.0, False, None, None, False, False)
    assert got == [
        (0, False, "Title", 1, "center", 12.0, 3.0, False, None, None, False, False, "A & <B> cd"), (1, False, *plain, ""), (2, False, "heading2", 2, "left", 0.0, 6.0, False, None, None, True, False, "Two"),
        (3, False, "MyCallout", None, "left", 0.0, 6.0, True, "FEF2F2", "DC2626", False, True, "careful"), (4, False, "", None, "justify", 0.0, 6.0, True, "ABCDEF", "112233", False, False, "shaded"),
        (5, True, *plain, "x"), (5, True, *plain, "y"), (5, True, *plain, "outer"), (5, True, *plain, "inner"), (6, False, *plain, "end"),
    ]
    runs = [(r.p, r.text, r.bold, r.italic, r["size"], r.color) for r in W.word_runs(tokens, ["id"]).orderBy("run").collect()]
    assert runs[:4] == [(1, "A & <B>", False, False, 24.0, "0F172A"), (1, " cd", False, True, 24.0, "FF00AA"), (3, "Two", True, False, 18.0, "0F172A"), (4, "careful", False, False, 11.0, None)]
    cells = [(r.block, r.row, r.cell, r.fill, r.border, r.border_width) for r in W.word_cells(tokens, ["id"]).orderBy("cell").collect()]
    assert cells == [(5, 1, 1, "00FF00", "ABCDEF", 2.0), (5, 1, 2, None, "64748B", 1.0), (5, 2, 3, None, "64748B", 1.0)]
    s = W.word_setup(tokens, ["id"]).first()
    assert (s.width, s.height, s.top, s.bottom, s.left, s.right) == (595.0, 842.0, 36.0, 72.0, 50.0, 72.0)


def test_files_that_are_no_documents(spark):
    whole = packed(document=DOCUMENT)
    cut = bytearray(whole)
    cut[60:200] = bytes(140)
    rows = [(1, whole), (2, bytearray(b"PK no zip")), (3, None), (4, packed(other="<x/>")), (5, cut), (6, whole[: len(whole) // 2]), (7, packed(document=""))]
    parts = W.word_parts(spark.createDataFrame(rows, "id int, content binary"), ["id"])
    assert sorted(r.id for r in W.broken(parts, ["id"]).collect()) == [2, 3, 4, 5, 6]
    assert {r.id for r in W.word_paragraphs(W.word_tokens(parts, ["id"]), ["id"]).collect()} == {1}


def test_chains_and_circles_of_styles(spark):
    n = 40
    rows = [(1, f"S{k}", f"S{k - 1}" if k else None, 7.5 if k == 0 else 30.0 if k == 30 else None, True if k == 5 else None) for k in range(n)]
    rows += [(2, "A", "B", None, None), (2, "B", "C", 9.0, None), (2, "C", "A", None, False), (3, "D", "missing", None, None), (3, "D0", "D", None, True)]
    got = {(r.id, r.style_id): (r["size"], r.bold) for r in W.inherited(spark.createDataFrame(rows, "id int, style_id string, based_on string, size double, bold boolean"), ["id"], ["size", "bold"]).collect()}
    assert all(got[1, f"S{k}"] == (7.5 if k < 30 else 30.0, True if k >= 5 else None) for k in range(n))
    assert got[2, "A"] == (9.0, False) and got[3, "D"] == (None, None) and got[3, "D0"] == (None, True)


def test_written_styles_and_breaks_are_read(spark):
    run = lambda t: [(t, False, True, True, False, 12.5)]
    schema = "id int, place int, kind string, level int, align string, ordered boolean, marker string, runs array<struct<text: string, bold: boolean, italic: boolean, mono: boolean, serif: boolean, size: double>>, rows array<array<string>>"
    blocks = [(1, 0, "heading", 7, None, None, None, run("deep"), None), (1, 1, "break", None, None, None, None, None, None), (1, 2, "table", None, None, None, None, None, [["a"], ["b", None, "<c>"]]), (2, 0, "paragraph", None, "center", None, None, [], None)]
    parts = W.word_parts(W.word_files(spark.createDataFrame(blocks, schema), ["id"], "place"), ["id"])
    tokens = W.word_tokens(parts, ["id"])
    got = [(r.id, r.level, r.page_break, r.align, r.text) for r in W.word_paragraphs(tokens, ["id"]).orderBy("id", "p").collect()]
    assert got == [(1, 3, False, "left", "deep"), (1, None, True, "left", ""), *((1, None, False, "left", t) for t in ("a", "", "", "b", "", "<c>", "")), (2, None, False, "center", "")]
    assert [(r.text, r["size"], r.italic) for r in W.word_runs(tokens, ["id"]).where("id = 1 and p = 1").collect()] == [("deep", 12.5, True)]
    styles = {(r.id, r.style_id): r for r in W.inherited(W.word_styles(parts, ["id"]), ["id"], ["size", "bold"]).collect()}
    assert styles[1, "Heading2"]["size"] == 14.0 and styles[2, "Normal"].bold is None
