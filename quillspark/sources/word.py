"""Word documents (.docx): written from blocks and read back as paragraphs, runs, cells and styles.

Only packing and unpacking of the zip needs Python, in Arrow batches.  The XML of a document becomes one row for each tag
and text (``word_tokens``); running counts over them in order say which paragraph, run, row and cell a row is in and how
deep it is in tables, so that nesting needs no parser and memory does not grow with the document.  Paragraphs, runs and
cells are aggregations of those rows.  Styles take what they do not say from the styles they are based on.
"""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from quillspark.functions.slices import sliced
from quillspark.functions.text import escape_xml, unescape_xml

# Names, types and places of a document's parts.
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_KIND = "application/vnd.openxmlformats-officedocument.wordprocessingml"
_PARTS = {
    "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    + "".join(f'<Override PartName="/word/{n}.xml" ContentType="{_KIND}.{t}+xml"/>' for n, t in (("document", "document.main"), ("styles", "styles"), ("numbering", "numbering"))) + "</Types>",
    "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>',
    "word/_rels/document.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{_OFFICE}/{n}" Target="{n}.xml"/>' for k, n in enumerate(("styles", "numbering"), 1)) + "</Relationships>",
    # One bullet definition that all lists share.
    "word/numbering.xml": f'{_HEAD}<w:numbering {_MAIN}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/><w:lvlText w:val="•"/><w:pPr><w:ind w:left="720" w:hanging="360"/></w:pPr></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
}
# Looks of headings, callouts and cells where a document does not say; points, and colours.
BODY_SIZE, TITLE_SIZE, HEADING_SIZE, HEADING_COLOR = 11.0, 24.0, 18.0, "0F172A"
SPACE_AFTER = 6.0
CALLOUT, CALLOUT_BORDER = "FEF2F2", "DC2626"
CELL_BORDER, CELL_BORDER_WIDTH = "64748B", 1.0
PAGE = {"width": 612.0, "height": 792.0, "top": 72.0, "bottom": 72.0, "left": 72.0, "right": 72.0}
NO_TEXT = "(No extractable text found.)"

STYLES = [("Normal", None, None, None), *((f"Heading{k}", "Normal", size, True) for k, size in ((1, 16.0), (2, 14.0), (3, 12.0)))]


# -- writing


def run_xml(run: Column) -> Column:
    """XML of a run (text, bold, italic, mono, serif, size)."""
    face = F.when(run["mono"], "Courier New").when(run["serif"], "Times New Roman").otherwise("Calibri")
    fonts = F.concat(F.lit('<w:rFonts w:ascii="'), face, F.lit('" w:hAnsi="'), face, F.lit('"/>'))
    half = F.round(run["size"] * 2).cast("int").cast("string")
    return F.concat(
        F.lit("<w:r><w:rPr>"), fonts, F.when(run["bold"], "<w:b/>").otherwise(""), F.when(run["italic"], "<w:i/>").otherwise(""), F.lit('<w:sz w:val="'), half, F.lit('"/></w:rPr><w:t xml:space="preserve">'), escape_xml(run["text"]), F.lit("</w:t></w:r>"),
    )


def _table_xml(rows: Column) -> Column:
    """Rows of texts as a table with thin lines and a bold first row; shorter rows are filled up."""
    wide = F.array_max(F.transform(rows, F.size))
    side = "".join(f'<w:{s} w:val="single" w:sz="4" w:color="BFBFBF"/>' for s in ("top", "left", "bottom", "right"))
    text = lambda t, r: F.concat(F.when(r == 0, "<w:r><w:rPr><w:b/>").otherwise("<w:r><w:rPr>"), F.lit('<w:sz w:val="20"/></w:rPr><w:t xml:space="preserve">'), escape_xml(F.coalesce(t, F.lit(""))), F.lit("</w:t></w:r>"))
    cell = lambda t, r: F.concat(F.lit(f"<w:tc><w:tcPr><w:tcBorders>{side}</w:tcBorders></w:tcPr><w:p>"), text(t, r), F.lit("</w:p></w:tc>"))
    row = lambda cells, r: F.concat(F.lit("<w:tr>"), F.array_join(F.transform(F.sequence(F.lit(0), wide - 1), lambda c: cell(F.get(cells, c), r)), ""), F.lit("</w:tr>"))
    return F.concat(F.lit('<w:tbl><w:tblPr><w:tblW w:w="5000" w:type="pct"/></w:tblPr>'), F.array_join(F.transform(rows, row), ""), F.lit("</w:tbl><w:p></w:p>"))


def block_xml() -> Column:
    """XML of a block (kind, level, align, ordered, marker, runs, rows)."""
    runs = F.array_join(F.transform("runs", run_xml), "")
    para = lambda props, inner: F.concat(F.lit("<w:p><w:pPr>"), props, F.lit("</w:pPr>"), inner, F.lit("</w:p>"))
    heading = F.concat(F.lit('<w:pStyle w:val="Heading'), F.least("level", F.lit(3)).cast("string"), F.lit('"/>'))
    jc = F.concat(F.lit('<w:spacing w:after="120"/><w:jc w:val="'), F.when(F.col("align") == "justify", "both").otherwise(F.coalesce("align", F.lit("left"))), F.lit('"/>'))
    mark = F.concat(F.lit("<w:r><w:t xml:space=\"preserve\">"), escape_xml(F.coalesce("marker", F.lit(""))), F.lit("\t</w:t></w:r>"))
    numbered = para(F.lit('<w:spacing w:after="60"/><w:ind w:left="440" w:hanging="280"/>'), F.concat(mark, runs))
    bullet = para(F.lit('<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr><w:spacing w:after="60"/>'), runs)
    return (
        F.when(F.col("kind") == "heading", para(heading, runs)).when(F.col("kind") == "table", _table_xml(F.col("rows"))).when(F.col("kind") == "break", '<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        .when((F.col("kind") == "list") & F.col("ordered"), numbered).when(F.col("kind") == "list", bullet).otherwise(para(jc, runs))
    )


def style_xml(name: Column, based: Column, size: Column, bold: Column) -> Column:
    """XML of a paragraph style; null values are left to the style it is based on."""
    base = F.coalesce(F.concat(F.lit('<w:basedOn w:val="'), based, F.lit('"/>')), F.lit(""))
    half = F.coalesce(F.concat(F.lit('<w:sz w:val="'), F.round(size * 2).cast("int").cast("string"), F.lit('"/>')), F.lit(""))
    thick = F.when(bold, "<w:b/>").when(~bold, '<w:b w:val="0"/>').otherwise("")
    return F.concat(F.lit('<w:style w:type="paragraph" w:styleId="'), name, F.lit('"><w:name w:val="'), name, F.lit('"/>'), base, F.lit("<w:rPr>"), thick, half, F.lit("</w:rPr></w:style>"))


@F.arrow_udf(BinaryType())
@sliced
def _packed(documents: pa.Array, styles: pa.Array) -> pa.Array:
    out = []
    for document, style in zip(documents.to_pylist(), styles.to_pylist(), strict=True):
        blob = io.BytesIO()
        with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in (*_PARTS.items(), ("word/styles.xml", style), ("word/document.xml", document)):
                z.writestr(zipfile.ZipInfo(name), text)
        out.append(blob.getvalue())
    return pa.array(out, pa.binary())


def word_files(blocks: DataFrame, key: list[str], order: str, width: float = PAGE["width"], height: float = PAGE["height"], styles: DataFrame | None = None) -> DataFrame:
    """(key, content): a document of the blocks of every key, in order; ``styles`` (key, style_id, based_on, size, bold) replace the usual ones."""
    margins = " ".join(f'w:{s}="1080"' for s in ("top", "right", "bottom", "left"))
    end = f'<w:sectPr><w:pgSz w:w="{round(width * 20)}" w:h="{round(height * 20)}"/><w:pgMar {margins}/></w:sectPr></w:body></w:document>'
    body = blocks.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list(F.struct(order, block_xml().alias("xml"))))["xml"], "").alias("body"))
    empty = f'<w:p><w:r><w:t>{NO_TEXT}</w:t></w:r></w:p>'
    document = F.concat(F.lit(f"{_HEAD}<w:document {_MAIN}><w:body>"), F.when(F.col("body") == "", empty).otherwise(F.col("body")), F.lit(end))
    defaults = f'{_HEAD}<w:styles {_MAIN}><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Calibri"/><w:sz w:val="22"/></w:rPr></w:rPrDefault></w:docDefaults>'
    if styles is None:
        usual = [style_xml(F.lit(n), F.lit(b).cast("string"), F.lit(s).cast("double"), F.lit(t).cast("boolean")) for n, b, s, t in STYLES]
        given = body.withColumn("styles", F.concat(*usual))
    else:
        own = styles.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list(style_xml(F.col("style_id"), F.col("based_on"), F.col("size"), F.col("bold")))), "").alias("styles"))
        given = body.join(own, key, "left").withColumn("styles", F.coalesce("styles", F.lit("")))
    return given.select(*key, _packed(document, F.concat(F.lit(defaults), F.col("styles"), F.lit("</w:styles>"))).alias("content"))


# -- reading


@F.arrow_udf(StructType([StructField(n, StringType()) for n in ("error", "document", "styles", "rels")]))
@sliced
def _unpacked(files: pa.Array) -> pa.Array:
    out = []
    for blob in files.to_pylist():
        try:
            with zipfile.ZipFile(io.BytesIO(blob or b"")) as z:
                names = set(z.namelist())
                text = lambda n, z=z, names=names: z.read(n).decode("utf-8", "replace") if n in names else None
                document = text("word/document.xml")
                error = None if document is not None else "no document in the package"
                out.append({"error": error, "document": document, "styles": text("word/styles.xml"), "rels": text("word/_rels/document.xml.rels")})
        except (zipfile.BadZipFile, zipfile.LargeZipFile, KeyError, OSError, EOFError, RuntimeError, NotImplementedError, ValueError) as e:
            out.append({"error": str(e) or type(e).__name__, "document": None, "styles": None, "rels": None})
        except Exception as e:  # damaged deflate streams raise the error class of the zlib module
            out.append({"error": f"damaged: {e}", "document": None, "styles": None, "rels": None})
    return pa.array(out, pa.struct([(n, pa.string()) for n in ("error", "document", "styles", "rels")]))


def word_parts(files: DataFrame, key: list[str], content: str = "content", parts: int | None = None) -> DataFrame:
    """(key, error, document, styles, rels): the XML of the files' parts; an error for files that are no Word documents.

    Documents are dealt to ``parts`` partitions, where it is given: what comes from Python has lost its partitioning, and
    else their tags, many times as large, are shuffled.
    """
    found = files.select(*key, _unpacked(F.col(content)).alias("part")).select(*key, "part.*")
    return found.repartition(parts, *key) if parts else found


_COUNTED = {"p": "p", "r": "run", "tr": "row", "tc": "cell"}
_INSIDE = ("body", "tbl", "r", "t", "pPr", "rPr", "tcPr", "tblGrid", "pBdr", "tcBorders", "drawing")


def word_tokens(parts: DataFrame, key: list[str]) -> DataFrame:
    """One row for each tag and text of the body, in order (pos), with the numbers of what it is in and how deep.

    p, run, row and cell are numbers within the document from 1, block counts paragraphs and tables of the body from 0,
    in_* say how many such elements are open.  Elements without an end tag count as empty ones of their own.
    """
    tokens = F.regexp_extract_all("document", F.lit(r"(?s)<!--.*?-->|<[^>]+>|[^<]+"), F.lit(0))
    rows = parts.where("document is not null").select(*key, F.posexplode(tokens).alias("pos", "token"))
    name = F.regexp_extract("token", r"^</?w:(\w+)", 1)
    rows = rows.withColumns({"name": name, "tag": F.regexp_extract("token", r"^</?([\w:]+)", 1), "shut": F.col("token").startswith("</"), "alone": F.col("token").startswith("<") & F.col("token").endswith("/>")})
    w = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = lambda n: ((F.col("name") == n) & ~F.col("shut")).cast("int")
    deeper = lambda n: F.when(F.col("name") == n, F.when(F.col("shut"), -1).when(F.col("alone"), 0).otherwise(1)).otherwise(0)
    rows = rows.withColumns({c: F.sum(begins(n)).over(w) for n, c in _COUNTED.items()} | {f"in_{n}": F.sum(deeper(n)).over(w) for n in _INSIDE})
    block = (begins("p") == 1) & (F.col("in_tbl") == 0) | (begins("tbl") == 1) & (F.col("in_tbl") == 1)
    return rows.withColumn("block", F.sum(block.cast("int")).over(w) - 1).where("in_body > 0")


def _value(attribute: str = "w:val", pattern: str = '([^"]*)') -> Column:
    return F.nullif(F.regexp_extract("token", rf'\s{attribute}="{pattern}"', 1), F.lit(""))


def _first(where: Column, value: Column) -> Column:
    """The value of the first row where it is not null."""
    return F.min_by(value, F.when(where & value.isNotNull(), F.col("pos")))


def _points(where: Column, attribute: str, per: float = 20.0) -> Column:
    return _first(where, _value(attribute, r"(\d+)")).cast("double") / per


def _on(name: str, where: Column) -> Column:
    """Whether a switch such as bold is set: without a value, or with one that is not 0 or false."""
    value = _value()
    return F.coalesce(F.bool_or(where & (F.col("name") == name) & ~F.col("shut") & (value.isNull() | ~value.rlike("^(0|false)"))), F.lit(False))


_HEX = "([0-9A-Fa-f]{6})"


def _of_paragraph() -> Column:
    return F.expr("p > 0 and (in_tbl = 0 or in_tbl > 0 and cell > 0)")


def _level() -> Column:
    """The level of a heading by its ``style``; null for others."""
    heading = F.nullif(F.regexp_extract("style", r"(?i)^Heading(\d+)$", 1), F.lit("")).try_cast("int")
    return F.when(heading.isNotNull(), heading).when(F.lower("style").contains("title"), 1)


def word_paragraphs(tokens: DataFrame, key: list[str]) -> DataFrame:
    """Paragraphs in order: block, in_table, row, cell, p, style, level (null: no heading), align, space before and after, looks, breaks and text.

    row and cell are numbers in the document, null outside tables; an ended row or cell keeps its last number.
    """
    ppr = (F.col("in_pPr") > 0) & ~F.col("shut")
    of = lambda n: ppr & (F.col("name") == n)
    text = F.array_join(F.sort_array(F.collect_list(F.when((F.col("in_t") > 0) & (F.col("in_r") > 0) & ~F.col("token").startswith("<"), F.struct("pos", unescape_xml(F.col("token")).alias("t")))))["t"], "")
    g = tokens.where(_of_paragraph()).groupBy(*key, "p").agg(
        F.min("block").alias("block"), F.min_by(F.col("in_tbl") > 0, "pos").alias("in_table"), F.min_by("row", "pos").alias("row"), F.min_by("cell", "pos").alias("cell"),
        F.coalesce(_first(of("pStyle"), _value()), F.lit("")).alias("style"), F.lower(_first(of("jc"), _value())).alias("jc"), _points(of("spacing"), r"w:before").alias("before"), _points(of("spacing"), r"w:after").alias("after"),
        F.upper(_first(of("shd"), _value("w:fill", _HEX))).alias("fill"), F.max(of("pBdr")).alias("bordered"), F.upper(_first((F.col("in_pBdr") > 0) & ppr, _value("w:color", _HEX))).alias("edge"),
        F.coalesce(F.max(of("pageBreakBefore")), F.lit(False)).alias("break_before"), F.coalesce(F.bool_or((F.col("name") == "br") & F.coalesce(_value("w:type") == "page", F.lit(False))), F.lit(False)).alias("page_break"), text.alias("text"),
    )
    named = F.lower("style").contains("callout")
    align = F.when(F.col("jc").isin("center", "right"), F.col("jc")).when(F.col("jc").isin("both", "justify"), "justify").otherwise("left")
    return g.select(
        *key, "block", "in_table", F.when(F.col("in_table"), F.col("row")).alias("row"), F.when(F.col("in_table"), F.col("cell")).alias("cell"), "p", "style", _level().alias("level"), align.alias("align"),
        F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(SPACE_AFTER)).alias("after"), (named | F.col("fill").isNotNull() | F.coalesce("bordered", F.lit(False))).alias("callout"),
        F.coalesce("fill", F.when(named, CALLOUT)).alias("background"), F.coalesce("edge", F.when(named, CALLOUT_BORDER)).alias("border"), "break_before", "page_break", "text",
    )


def word_runs(tokens: DataFrame, key: list[str]) -> DataFrame:
    """Runs with text in order: p, run, text, bold, italic, size and color, by the run and the kind of its paragraph.

    The style of a paragraph is told by a window over its runs, so that tags are made and sorted once.
    """
    own, part = F.col("in_r") > 0, _of_paragraph()
    rpr = own & (F.col("in_rPr") > 0) & (F.col("in_pPr") == 0)
    text = F.array_join(F.sort_array(F.collect_list(F.when(own & (F.col("in_t") > 0) & ~F.col("token").startswith("<"), F.struct("pos", unescape_xml(F.col("token")).alias("t")))))["t"], "")
    of = lambda n: rpr & (F.col("name") == n) & ~F.col("shut")
    style = part & (F.col("in_pPr") > 0) & ~F.col("shut") & (F.col("name") == "pStyle") & _value().isNotNull()
    pieces = tokens.where("p > 0").groupBy(*key, "p", "run").agg(
        text.alias("text"), _on("b", rpr).alias("bold"), _on("i", rpr).alias("italic"), _points(of("sz"), "w:val", 2.0).alias("size"), F.upper(_first(of("color"), _value("w:val", _HEX))).alias("color"),
        F.max(part).alias("part"), F.min(F.when(style, F.struct("pos", _value().alias("style")))).alias("style"),
    )
    w = Window.partitionBy(*key, "p")
    told = pieces.withColumns({"part": F.max("part").over(w), "style": F.coalesce(F.min("style").over(w)["style"], F.lit(""))}).where("part and text <> ''").withColumn("level", _level())
    usual = F.when(F.col("level") == 1, TITLE_SIZE).when(F.col("level").isNotNull(), HEADING_SIZE).otherwise(BODY_SIZE)
    color = F.coalesce("color", F.when(F.col("level").isNotNull(), HEADING_COLOR))
    return told.select(*key, "p", "run", "text", "bold", "italic", F.coalesce("size", usual).alias("size"), color.alias("color"))


def word_cells(tokens: DataFrame, key: list[str]) -> DataFrame:
    """Cells of tables in order: block, row, cell, fill, border, border_width; numbers of rows and cells are those of the document."""
    own = (F.col("in_tcPr") > 0) & ~F.col("shut")
    edge = own & (F.col("in_tcBorders") > 0)
    g = tokens.where("in_tbl > 0 and cell > 0 and (in_tcPr > 0 or name = 'tc')").where(~(F.col("shut") & (F.col("name") == "tc"))).groupBy(*key, "cell").agg(
        F.min("block").alias("block"), F.min("row").alias("row"), F.upper(_first(own & (F.col("name") == "shd"), _value("w:fill", _HEX))).alias("fill"),
        F.coalesce(F.upper(_first(edge, _value("w:color", _HEX))), F.lit(CELL_BORDER)).alias("border"), F.coalesce(_points(edge, "w:sz", 8.0), F.lit(CELL_BORDER_WIDTH)).alias("border_width"),
    )
    return g.select(*key, "block", "row", "cell", "fill", "border", "border_width")


def word_setup(tokens: DataFrame, key: list[str]) -> DataFrame:
    """Page size and margins in points."""
    of = lambda n: (F.col("name") == n) & ~F.col("shut")
    found = {"width": _points(of("pgSz"), "w:w"), "height": _points(of("pgSz"), "w:h")} | {s: _points(of("pgMar"), f"w:{s}") for s in ("top", "bottom", "left", "right")}
    return tokens.groupBy(*key).agg(*(F.coalesce(v, F.lit(PAGE[n])).alias(n) for n, v in found.items()))


def inherited(styles: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """``styles`` (key, style_id, based_on, values) with what a style leaves null taken from the nearest style above it.

    Every round, a style takes what it lacks from the style it points to and then points to where that one points, so a
    chain of n styles takes about log n joins.  Styles that are based on each other in a circle keep pointing; they are
    left as they are once all others must be done.
    """
    rows = styles.select(*key, "style_id", F.col("based_on").alias("up"), *values).checkpoint()
    most = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(most).bit_length() + 1):
        if rows.where("up is not null").isEmpty():
            break
        above = rows.select(*key, F.col("style_id").alias("up"), F.col("up").alias("further"), *(F.col(v).alias(f"above_{v}") for v in values))
        found = rows.join(above, [*key, "up"], "left")
        rows = found.select(*key, "style_id", F.col("further").alias("up"), *(F.coalesce(v, f"above_{v}").alias(v) for v in values)).checkpoint()
    return rows.drop("up")


def word_styles(parts: DataFrame, key: list[str]) -> DataFrame:
    """(key, style_id, based_on, size, bold, italic, color, align) of all styles as they say themselves; null where they do not."""
    xml = F.explode(F.regexp_extract_all("styles", F.lit(r"(?s)<w:style\b.*?</w:style>"), F.lit(0)))
    s = parts.where("styles is not null").select(*key, xml.alias("x"))
    value = lambda n, a="w:val": F.nullif(F.regexp_extract("x", rf'<w:{n}\b[^>]*\s{a}="([^"]*)"', 1), F.lit(""))
    switch = lambda n: F.when(F.col("x").rlike(rf"<w:{n}\b[^>]*>"), ~F.coalesce(F.regexp_extract("x", rf'<w:{n}\s[^>]*w:val="([^"]*)"', 1).rlike("^(0|false)"), F.lit(False)))
    return s.select(*key, value("style", "w:styleId").alias("style_id"), value("basedOn").alias("based_on"), (value("sz").try_cast("double") / 2).alias("size"), switch("b").alias("bold"), switch("i").alias("italic"), F.upper(value("color")).alias("color"), F.lower(value("jc")).alias("align"))


def broken(parts: DataFrame, key: list[str]) -> DataFrame:
    """(key, error) of the files that could not be read."""
    return parts.where("error is not null").select(*key, "error")
