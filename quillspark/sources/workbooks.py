"""Workbooks (.xlsx): written from cells and read back as cells.

Only packing and unpacking of the zip needs Python, in Arrow batches; the XML is built and taken apart by SQL functions.
A workbook is one file, so that its rows are gathered when it is written.  Only cells that are there are written, so that a
sheet costs what it holds, wherever its cells are.
"""

from __future__ import annotations

import html
import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import BinaryType

from quillspark.functions.format_plans import ARROW_PLAN, IMPLICIT, plan, shown
from quillspark.functions.formats import BUILT_IN, formatted
from quillspark.functions.sheets import column_letters, column_number
from quillspark.functions.slices import sliced
from quillspark.functions.text import escape_xml, unescape_xml
from quillspark.operators.sheets import MOST_CELLS, TOO_LARGE

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_PARTS = {
    "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    # a number, and the formats 14 and 10 for days and shares
    "xl/styles.xml": f'{_HEAD}<styleSheet {_MAIN}><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="10" applyNumberFormat="1"/></cellXfs></styleSheet>',
}
#: Numbers of the styles that cells may be written in.
STYLES = {"number": 0, "day": 1, "share": 2}
#: Names of sheets are cut to so many characters; columns are so many characters wide.
MOST_NAME, LEAST_WIDTH, MOST_WIDTH = 31, 8, 60


#: Cells of workbooks in a partition; as XML they are some 100 bytes each.
CELLS = 500_000


@F.arrow_udf(BinaryType())
@sliced
def _packed(books: pa.Array) -> pa.Array:
    """Archives of sheets (name as escaped text, xml) in their order."""
    out = []
    for sheets in books.to_pylist():
        parts = dict(_PARTS)
        names, links, types = [], [], []
        for k, sheet in enumerate(sheets, 1):
            names.append(f'<sheet name="{sheet["name"]}" sheetId="{k}" r:id="rId{k}"/>')
            links.append(f'<Relationship Id="rId{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>')
            types.append(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_SHEET_TYPE}.worksheet+xml"/>')
            parts[f"xl/worksheets/sheet{k}.xml"] = sheet["xml"]
        links.append(f'<Relationship Id="rId{len(sheets) + 1}" Type="{_OFFICE}/styles" Target="styles.xml"/>')
        parts["xl/workbook.xml"] = f'{_HEAD}<workbook {_MAIN} xmlns:r="{_OFFICE}"><sheets>{"".join(names)}</sheets></workbook>'
        parts["xl/_rels/workbook.xml.rels"] = f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{"".join(links)}</Relationships>'
        kinds = f'<Override PartName="/xl/workbook.xml" ContentType="{_SHEET_TYPE}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_SHEET_TYPE}.styles+xml"/>'
        ends = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        parts["[Content_Types].xml"] = f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types">{ends}{kinds}{"".join(types)}</Types>'
        blob = io.BytesIO()
        with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in parts.items():
                z.writestr(zipfile.ZipInfo(name), text)
        out.append(blob.getvalue())
    return pa.array(out, pa.binary())


def workbooks(cells: DataFrame, key: list[str], sheet: str | None = None, name: str | None = None, most: int | None = MOST_CELLS) -> DataFrame:
    """(key, content, error): one workbook for the cells (row, col from 0, number or else text, style if there is one) of every key.

    ``sheet`` is a column that orders the sheets of a workbook and ``name`` one with their names, the same in all cells of
    a sheet (the least is taken; the sheet's number where it is null); without them there is one sheet, Sheet1.  ``style``
    is one of STYLES.  Columns are as wide as their longest value and two characters more, within limits.  A workbook with
    a sheet whose rows and columns span more than ``most`` cells has an error and no content, as dense_rows refuses it; with
    None every workbook is written.
    """
    own = F.col(name).cast("string") if name else F.lit(None).cast("string")
    style = F.col("style") if "style" in cells.columns else F.lit(None).cast("string")
    ids = F.coalesce(*(F.when(style == k, f' s="{n}"') for k, n in STYLES.items() if n), F.lit(""))
    place = F.concat(column_letters(F.col("col")), (F.col("row") + 1).cast("string"))
    number = F.concat(F.lit('<c r="'), place, F.lit('"'), ids, F.lit("><v>"), F.col("number").cast("string"), F.lit("</v></c>"))
    text = F.concat(F.lit('<c r="'), place, F.lit('" t="inlineStr"><is><t xml:space="preserve">'), escape_xml(F.col("text")), F.lit("</t></is></c>"))
    plain = F.regexp_replace(F.coalesce(F.col("number").try_cast("decimal(38,10)").cast("string"), F.col("number").cast("string")), r"\.?0+$", "")
    cells = cells.withColumns({"__sheet": F.col(sheet) if sheet else F.lit(1), "__name": own})
    of_sheet = [*key, "__sheet"]
    # cells are dealt by workbook as numbers and texts, once: what is told of rows, columns and sheets is all grouped by it first
    parts = max(cells.sparkSession.sparkContext.defaultParallelism, -(-cells.count() // CELLS))
    dealt = cells.repartition(parts, *key)
    if most is not None:
        size = cells.groupBy(*of_sheet).agg(((F.max("row") + 1).cast("long") * (F.max("col") + 1)).alias("n_cells")).groupBy(*key).agg(F.max("n_cells").alias("n_cells"))
        size = size.select(*key, F.when(F.col("n_cells") > most, TOO_LARGE).alias("error"))
        dealt = dealt.join(size.where("error is null").select(*key).repartition(parts, *key), key, "left_semi")
    width = F.least(F.greatest(F.coalesce(F.max(F.length(F.coalesce("text", F.when(F.col("number").isNotNull(), plain)))).over(Window.partitionBy(*of_sheet, "col")), F.lit(0)) + 2, F.lit(LEAST_WIDTH)), F.lit(MOST_WIDTH))
    kept = dealt.withColumn("width", width).select(*of_sheet, "__name", "row", "col", "width", F.coalesce(number, text).alias("xml"))
    rows = kept.groupBy(*of_sheet, "row").agg(
        F.min("__name").alias("__name"), F.array_sort(F.collect_set(F.struct("col", "width"))).alias("wide"), F.count("xml").alias("n"), F.array_join(F.sort_array(F.collect_list(F.struct("col", "xml")))["xml"], "").alias("xml"),
    )
    line = F.concat(F.lit('<row r="'), (F.col("row") + 1).cast("string"), F.lit('">'), F.col("xml"), F.lit("</row>"))
    lines = F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("row", line.alias("line")))))["line"]
    sheets = rows.groupBy(*of_sheet).agg(F.min("__name").alias("__name"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("wide")))).alias("wide"), lines.alias("lines"))
    column = lambda c: F.format_string('<col min="%d" max="%d" width="%d" customWidth="1"/>', c["col"] + 1, c["col"] + 1, c["width"])
    body = F.concat(F.lit(f"{_HEAD}<worksheet {_MAIN}><cols>"), F.array_join(F.transform("wide", column), ""), F.lit("</cols><sheetData>"), F.array_join("lines", ""), F.lit("</sheetData></worksheet>"))
    called = escape_xml(F.left(F.coalesce("__name", F.concat(F.lit("Sheet"), F.col("__sheet").cast("string"))), F.lit(MOST_NAME)))
    books = sheets.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("__sheet", called.alias("name"), body.alias("xml")))).alias("s"))
    written = books.select(*key, _packed(F.transform("s", lambda s: F.struct(s["name"].alias("name"), s["xml"].alias("xml")))).alias("content"), F.lit(None).cast("string").alias("error"))
    if most is None:
        return written
    return written.unionByName(size.where("error is not null").select(*key, F.lit(None).cast("binary").alias("content"), "error"))


_PART = pa.struct([("name", pa.string()), ("xml", pa.string())])
_STYLE = pa.struct([("id", pa.int32()), ("plan", ARROW_PLAN)])
_BOOK = pa.struct([("error", pa.string()), ("strings", pa.string()), ("base", pa.int32()), ("styles", pa.list_(_STYLE)), ("sheets", pa.list_(_PART))])
# The day from which serial numbers count where a workbook says so, as a serial number.
_BASE_1904 = 1462


def _attributes(tag: str) -> dict[str, str]:
    return {k: a or b for k, a, b in re.findall(r"([\w:]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", tag)}


def _styles(xml: str) -> list[dict]:
    """The format of every cell style: its number and plan; the general one has no plan."""
    own = {}
    for tag in re.findall(r"<(?:\w+:)?numFmt\b[^>]*>", xml):
        found = _attributes(tag)
        if found.get("numFmtId", "").isdigit() and "formatCode" in found:
            own[int(found["numFmtId"])] = html.unescape(found["formatCode"])
    out = []
    of_cells = re.search(r"(?s)<(?:\w+:)?cellXfs\b.*?</(?:\w+:)?cellXfs>", xml)
    for tag in re.findall(r"<(?:\w+:)?xf\b[^>]*>", of_cells[0] if of_cells else ""):
        number = _attributes(tag).get("numFmtId", "")
        number = int(number) if number.isdigit() else 0
        code = own.get(number) or BUILT_IN.get(number) or IMPLICIT.get(number) or "General"
        out.append({"id": number, "plan": None if number == 0 or code in ("General", "@") else plan(code)})
    return out


@F.arrow_udf(from_arrow_type(_BOOK))
@sliced
def _unpacked(files: pa.Array) -> pa.Array:
    """The XML of the parts that hold cells, sheets by the order of the workbook."""
    out = []
    for blob in files.to_pylist():
        try:
            with zipfile.ZipFile(io.BytesIO(blob or b"")) as z:
                names = set(z.namelist())
                text = lambda n, z=z, names=names: z.read(n).decode("utf-8-sig", "replace") if n in names else ""
                targets = {}
                for tag in re.findall(r"<Relationship\b[^>]*>", text("xl/_rels/workbook.xml.rels")):
                    found = dict(re.findall(r'(\w+)="([^"]*)"', tag))
                    targets[found.get("Id")] = found.get("Target", "").removeprefix("/xl/")
                sheets = []
                for tag in re.findall(r"<sheet\b[^>]*>", text("xl/workbook.xml")):
                    found = dict(re.findall(r'([\w:]+)="([^"]*)"', tag))
                    sheets.append({"name": found.get("name"), "xml": text(f"xl/{targets.get(found.get('r:id'))}")})
                late = _attributes("".join(re.findall(r"<(?:\w+:)?workbookPr\b[^>]*>", text("xl/workbook.xml")))).get("date1904", "").lower() in ("1", "true")
                out.append({"error": None, "strings": text("xl/sharedStrings.xml"), "base": _BASE_1904 * late, "styles": _styles(text("xl/styles.xml")), "sheets": sheets})
        except (zipfile.BadZipFile, KeyError, OSError) as e:
            out.append({"error": str(e), "strings": "", "base": 0, "styles": [], "sheets": []})
    return pa.array(out, _BOOK)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def workbook_cells(files: DataFrame, key: list[str], content: str) -> DataFrame:
    """(key, sheet, row, col, kind, raw, format_id, text, code, declined, error) of all cells that have a value; text is as the sheet shows it.

    kind is the cell's: n, s, str, inlineStr, b, e or d (a day in ISO form, shown by its serial number).  Numbers follow
    the cell's format, built-in or of the file's own (``code``), counted from 1904 where the file says so; where a format
    is not supported, ``declined`` says why and the number is in general form.  Rich and phonetic strings give their plain
    text.  A file that is no workbook gives one row that has an error only.
    """
    inner = lambda si: F.array_join(F.transform(_all(F.regexp_replace(si, r"(?s)<rPh\b.*?</rPh>", ""), r"(?s)<t(?:\s[^>]*)?>(.*?)</t>", 1), unescape_xml), "")
    opened = files.select(*key, _unpacked(F.col(content)).alias("w"))
    strings = F.transform(_all(F.col("w.strings"), r"(?s)<si>(.*?)</si>", 1), inner)
    sheets = opened.select(*key, strings.alias("strings"), "w.styles", "w.base", F.inline("w.sheets"))
    cells = sheets.select(*key, F.col("name").alias("sheet"), "strings", "styles", "base", F.explode(_all(F.col("xml"), r"(?s)<c\b[^>]*?(?:/>|>.*?</c>)")).alias("c"))
    head = F.regexp_extract("c", r"^<c\b[^>]*", 0)
    value = unescape_xml(F.regexp_extract("c", r"(?s)<v(?:\s[^>]*)?>(.*?)</v>", 1))
    kind = F.coalesce(F.nullif(F.regexp_extract(head, r'\st="(\w+)"', 1), F.lit("")), F.lit("n"))
    raw = F.when(kind == "s", F.get("strings", value.try_cast("int"))).when(kind == "inlineStr", inner(F.col("c"))).when(kind == "b", F.when(value == "1", "TRUE").otherwise("FALSE")).otherwise(value)
    place = F.regexp_extract(head, r'\sr="([A-Z]{1,3})(\d+)"', 1)
    row = F.regexp_extract(head, r'\sr="([A-Z]{1,3})(\d+)"', 2).try_cast("long") - 1
    style = F.get("styles", F.regexp_extract(head, r'\ss="(\d+)"', 1).try_cast("int"))
    found = cells.select(*key, "sheet", "base", row.alias("row"), column_number(place).cast("long").alias("col"), kind.alias("kind"), raw.alias("raw"), style.alias("style"))
    found = found.where("row is not null and raw is not null and raw <> ''")
    moment = F.try_to_timestamp(F.regexp_replace("raw", "Z$", ""))
    serial = (F.unix_micros(moment) - F.unix_micros(F.lit("1899-12-30").cast("timestamp"))) / 86400e6
    number = F.when(F.col("kind") == "n", F.col("raw").try_cast("double")).when(F.col("kind") == "d", serial)
    of = F.col("style")["plan"]
    dated = F.exists(of["sections"], lambda s: s["kind"] == "date")
    found = found.withColumn("number", F.when(dated & (F.col("kind") == "n"), number + F.col("base")).otherwise(number))
    text = F.coalesce(shown(F.col("number"), F.when(of["declined"].isNull(), of)), F.col("raw"))
    found = found.select(
        *key, "sheet", "row", "col", "kind", "raw", F.coalesce(F.col("style")["id"], F.lit(0)).alias("format_id"), text.alias("text"), of["code"].alias("code"), of["declined"].alias("declined"), F.lit(None).cast("string").alias("error"),
    )
    broken = opened.select(*key, F.col("w.error").alias("error")).where("error is not null")
    return found.unionByName(broken, allowMissingColumns=True)


def workbook_columns(files: DataFrame, key: list[str], content: str) -> DataFrame:
    """(key, sheet, col, width) of the columns whose widths a workbook states."""
    sheets = files.select(*key, F.inline(_unpacked(F.col(content))["sheets"]))
    cols = sheets.select(*key, F.col("name").alias("sheet"), F.explode(_all(F.regexp_extract("xml", r"(?s)<cols>.*?</cols>", 0), r"<col\b[^>]*>")).alias("c"))
    number = lambda a: F.regexp_extract("c", rf'\s{a}="([0-9.]+)"', 1)
    first, last = number("min").try_cast("long"), number("max").try_cast("long")
    known = cols.select(*key, "sheet", number("width").try_cast("double").alias("width"), F.when((first > 0) & (last <= 16384), F.sequence(first - 1, last - 1)).alias("of"))
    return known.where("width is not null").select(*key, "sheet", F.explode("of").alias("col"), "width")


def formatted_by_id(x: Column, number: Column) -> Column:
    """The text of a number by the number of a built-in format; unknown ones count as General, text formats as such."""
    out = formatted(x, "General")
    for k, code in BUILT_IN.items():
        if k and code != "@":
            out = F.when(number == k, formatted(x, code)).otherwise(out)
    return out
