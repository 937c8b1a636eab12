"""Presentations (.pptx): parts as rows, relations as a graph, shapes with what layouts, masters and themes give them.

A package is one row for each XML part and one for each relation between parts; a slide finds its layout, master and theme
by joins.  The XML of a part is one row for each tag and text, as for Word documents, with running counts of what it is in.
Shapes, levels of text styles and runs are aggregations of these rows.  What a shape does not say comes from the
placeholder of its layout, then of its master: left joins by the kind of placeholder and ``coalesce``.
"""

from __future__ import annotations

import io
import tempfile
import zipfile
from collections.abc import Iterator
from itertools import groupby
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from quillspark.functions.colors import hexadecimal, rgb, transformed
from quillspark.functions.slices import SLICE, sliced
from quillspark.functions.text import unescape_xml
from quillspark.sources.shared import written
from quillspark.sources.tables import partitions

# Units in a point, the usual page, and the text size and theme where a file has none.
EMU, PAGE, TEXT_SIZE = 12700.0, (960.0, 540.0), 18.0
THEME = {
    "dk1": "000000", "lt1": "FFFFFF", "dk2": "44546A", "lt2": "E7E6E6", "accent1": "4472C4", "accent2": "ED7D31", "accent3": "A5A5A5", "accent4": "FFC000",
    "accent5": "5B9BD5", "accent6": "70AD47", "hlink": "0563C1", "folHlink": "954F72",
}
COLOR_NAMES = {"bg1": "lt1", "tx1": "dk1", "bg2": "lt2", "tx2": "dk2"}
# Placeholders that stand for another kind.
PLACEHOLDERS = {"ctrTitle": "title", "subTitle": "body", "obj": "body", "tbl": "body", "chart": "body", "dgm": "body", "media": "body", "clipArt": "body", "pic": "body"}
COLORS = ("srgbClr", "schemeClr", "sysClr")
#: Parts that are Python objects at once while a package is written.
ROWS = 500
#: Bytes of XML in a partition whose tags become rows; these are some ten times as large.
XML_BYTES = 8 << 20

@F.arrow_udf(BinaryType())
@sliced
def packed(parts: pa.Array) -> pa.Array:
    """A package of parts (part, xml)."""
    out = []
    for own in parts.to_pylist():
        blob = io.BytesIO()
        with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
            for p in own:
                z.writestr(zipfile.ZipInfo(p["part"]), p["xml"])
        out.append(blob.getvalue())
    return pa.array(out, pa.binary())


def packages(parts: DataFrame, key: list[str]) -> DataFrame:
    """(key, content): a package of the parts (part, xml) of every key, written part by part as the sorted rows come."""
    schema = StructType([*(parts.schema[k] for k in key), StructField("content", BinaryType())])
    kinds = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, blob, z = None, None, None
        closed = lambda: pa.RecordBatch.from_arrays([*(pa.array([v], kinds.field(k).type) for k, v in zip(key, last, strict=True)), pa.array([blob.getvalue()], pa.binary())], schema=kinds)
        for batch in batches:
            for b in (batch.slice(k, ROWS) for k in range(0, batch.num_rows, ROWS)):
                for row in b.to_pylist():
                    own = tuple(row[k] for k in key)
                    if z is None or own != last:
                        if z is not None:
                            z.close()
                            yield closed()
                        last, blob = own, io.BytesIO()
                        z = zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED)
                    z.writestr(zipfile.ZipInfo(row["part"]), row["xml"], zipfile.ZIP_DEFLATED)
        if z is not None:
            z.close()
            yield closed()

    return parts.select(*key, "part", "xml").repartition(*key).sortWithinPartitions(*key, "part").mapInArrow(pack, schema)


def _read_parts(own: tuple, file: BinaryIO, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (key, error, part, xml) of a package in a file, a few parts at a time."""

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        columns = [[*own, *f] for f in found]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*columns, strict=True), kinds, strict=True)], schema=kinds)

    try:
        z = zipfile.ZipFile(file)
        names = [x for x in z.namelist() if x.startswith("ppt/") and x.endswith((".xml", ".rels"))]
        for name in names:  # a damaged file gives none of its parts
            z.read(name)
    except Exception as e:  # zip files fail in many ways, damaged streams with the errors of the zlib module
        yield rows_of([(str(e) or type(e).__name__, None, None)])
        return
    if "ppt/presentation.xml" not in z.NameToInfo:
        yield rows_of([("no presentation in the package", None, None)])
        return
    out, size = [], 0
    for name in names:
        out.append((None, name, z.read(name).decode("utf-8", "replace")))
        size += len(out[-1][2])
        if size > SLICE:
            yield rows_of(out)
            out, size = [], 0
    if out:
        yield rows_of(out)


def _part_schema(df: DataFrame, key: list[str]) -> StructType:
    return StructType([*(df.schema[k] for k in key), *(StructField(c, StringType()) for c in ("error", "part", "xml"))])


def slide_parts(files: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """(key, error, part, xml): the XML parts of presentations; one row with an error for a file that is none.

    Parts leave a file a few at a time and are dealt by their names, so that what follows needs no shuffle of their tags.
    """
    schema = _part_schema(files, key)
    kinds = to_arrow_schema(schema)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                yield from _read_parts(tuple(b.column(k)[n].as_py() for k in key), io.BytesIO(b.column(content)[n].as_py() or b""), kinds)

    return files.select(*key, content).mapInArrow(unpack, schema).repartition(*key, "part")


def written_and_read(parts: DataFrame, key: list[str]) -> DataFrame:
    """As slide_parts of packages: every package is written to a file of the task, which goes with it, and read back from there.

    A package grows with its slides, and no value holds one: only the list of its parts is in memory.
    """
    schema = _part_schema(parts, key)
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for k in range(0, batch.num_rows, ROWS) for row in batch.slice(k, ROWS).to_pylist())
        for own, parts_of in groupby(rows, key=lambda row: tuple(row[k] for k in key)):
            with tempfile.TemporaryFile() as file:
                with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
                    for row in parts_of:
                        z.writestr(zipfile.ZipInfo(row["part"]), row["xml"], zipfile.ZIP_DEFLATED)
                del z
                yield from _read_parts(own, file, kinds)

    return parts.select(*key, "part", "xml").repartition(*key).sortWithinPartitions(*key, "part").mapInArrow(run, schema)


def _attribute(name: str, column: str = "token") -> Column:
    return F.nullif(F.regexp_extract(column, rf'\s{name}="([^"]*)"', 1), F.lit(""))


def resolved_path(folder: Column, target: Column) -> Column:
    """A target's place in the package, seen from a folder."""
    joined = F.filter(F.split(F.concat(folder, F.lit("/"), target), "/"), lambda s: ~s.isin("", "."))
    walked = F.aggregate(joined, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s)))
    return F.when(target.startswith("/"), F.substring(target, 2, 1 << 30)).otherwise(F.array_join(walked, "/"))


def relations(parts: DataFrame, key: list[str]) -> DataFrame:
    """(key, owner, relation, type, target): relations of parts to parts of the same package."""
    owner = F.regexp_extract("part", r"^(.*)/_rels/([^/]*)\.rels$", 1), F.regexp_extract("part", r"^(.*)/_rels/([^/]*)\.rels$", 2)
    rows = parts.where("part like '%/_rels/%.rels'").select(*key, owner[0].alias("folder"), F.concat(owner[0], F.lit("/"), owner[1]).alias("owner"), F.explode(F.regexp_extract_all("xml", F.lit(r"<Relationship\b[^>]*>"), F.lit(0))).alias("token"))
    inside = ~F.coalesce(_attribute("TargetMode") == "External", F.lit(False))
    found = rows.where(inside).select(*key, "owner", _attribute("Id").alias("relation"), F.substring_index(_attribute("Type"), "/", -1).alias("type"), resolved_path(F.col("folder"), unescape_xml(_attribute("Target"))).alias("target"))
    return found.where("relation is not null and target is not null")


def deck_slides(parts: DataFrame, key: list[str]) -> DataFrame:
    """(key, slide, part, hidden, layout, master, theme): slides in order from 1; those of a deck that lists none by their file names."""
    rels = relations(parts, key)
    pres = parts.where("part = 'ppt/presentation.xml'")
    ids = pres.select(*key, F.posexplode(F.regexp_extract_all("xml", F.lit(r"<p:sldId\b[^>]*>"), F.lit(0))).alias("n", "token")).select(*key, "n", _attribute("r:id").alias("relation"))
    listed = ids.join(rels.where("owner = 'ppt/presentation.xml'"), [*key, "relation"]).select(*key, F.col("n").cast("long").alias("n"), F.col("target").alias("part"))
    number = F.regexp_extract("part", r"^ppt/slides/slide(\d+)\.xml$", 1)
    by_name = parts.where(number != "").select(*key, number.cast("long").alias("n"), "part").join(listed.select(*key).distinct(), key, "left_anti")
    slides = listed.unionByName(by_name).join(parts.select(*key, "part", F.regexp_extract("xml", r"<p:sld\b[^>]*>", 0).alias("head")), [*key, "part"])
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("n", "part"))
    out = slides.select(*key, rank.alias("slide"), "part", F.coalesce(_attribute("show", "head") == "0", F.lit(False)).alias("hidden"))
    for owner, kind, name in (("part", "slideLayout", "layout"), ("layout", "slideMaster", "master"), ("master", "theme", "theme")):
        one = rels.where(F.col("type") == kind).groupBy(*key, "owner").agg(F.min("target").alias(name))
        out = out.join(one.withColumnRenamed("owner", owner), [*key, owner], "left")
    return out.select(*key, "slide", "part", "hidden", "layout", "master", "theme")


_SHAPES = ("sp", "cxnSp", "pic", "graphicFrame")
_LISTS = ("lstStyle", "titleStyle", "bodyStyle", "otherStyle", "defaultTextStyle")
_INSIDE = {"sp": _SHAPES, "nv": ("nvSpPr", "nvCxnSpPr", "nvPicPr", "nvGraphicFramePr"), "spPr": ("spPr",), "ln": ("ln",), "xfrm": ("xfrm",), "fill": ("solidFill",), "clr": COLORS, "tx": ("txBody",), "list": _LISTS, "ppr": ("pPr",), "rpr": ("rPr",), "t": ("t",), "group": ("grpSp",)}


def slide_tokens(parts: DataFrame, key: list[str]) -> DataFrame:
    """One row for each tag and text of the parts, in order (pos), with the shape, paragraph and run it is in, and how deep it is in what."""
    rows = parts.where("xml is not null and part not like '%.rels'").select(*key, "part", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<!--.*?-->|<[^>]+>|[^<]+"), F.lit(0))).alias("pos", "token"))
    rows = rows.withColumns({"name": F.regexp_extract("token", r"^</?(?:\w+:)?(\w+)", 1), "shut": F.col("token").startswith("</"), "alone": F.col("token").startswith("<") & F.col("token").endswith("/>")})
    w = Window.partitionBy(*key, "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deeper = lambda *n: F.when(F.col("name").isin(*n), F.when(F.col("shut"), -1).when(F.col("alone"), 0).otherwise(1)).otherwise(0)
    begins = lambda *n: (F.col("name").isin(*n) & ~F.col("shut")).cast("int")
    level = F.when(F.col("name").rlike(r"^lvl\dpPr$") & ~F.col("shut"), F.regexp_extract("name", r"(\d)", 1).try_cast("int")).when((F.col("name") == "defPPr") & ~F.col("shut"), 0)
    named = F.when(F.col("name").isin(*_LISTS) & ~F.col("shut"), F.col("name"))
    return rows.withColumns(
        {"shape": F.sum(begins(*_SHAPES)).over(w), "p": F.sum(begins("p")).over(w), "run": F.sum(begins("r", "fld")).over(w), "level": F.last(level, ignorenulls=True).over(w), "list": F.last(named, ignorenulls=True).over(w)}
        | {f"in_{k}": F.sum(deeper(*n)).over(w) for k, n in _INSIDE.items()}
    )


def _first(where: Column, value: Column) -> Column:
    return F.min_by(value, F.when(where & value.isNotNull(), F.col("pos")))


def _on(value: Column) -> Column:
    return F.when(value.isNotNull(), value.isin("1", "true", "on"))


def _number(name: str, per: float) -> Column:
    return _attribute(name).try_cast("double") / per


def _color(where: Column) -> tuple[Column, Column]:
    """The name or digits of the first colour and its transforms."""
    of = where & F.col("name").isin(*COLORS) & ~F.col("shut")
    value = F.when(F.col("name") == "sysClr", _attribute("lastClr")).otherwise(_attribute("val"))
    mods = F.transform(F.sort_array(F.collect_list(F.when(where & (F.col("in_clr") > 0) & ~F.col("shut") & ~F.col("name").isin(*COLORS) & (F.col("name") != ""), F.struct("pos", "name", F.coalesce(_attribute("val").try_cast("double"), F.lit(0.0)).alias("val"))))), lambda m: F.struct(m["name"].alias("name"), m["val"].alias("val")))
    return _first(of, value), mods


def slide_shapes(tokens: DataFrame, key: list[str]) -> DataFrame:
    """Shapes of all parts: shape (number in the part), kind, name, hidden, ph_type and ph_idx (null: no placeholder), place in points, fill, mods and text.

    A place in a group is in the group's own units.
    """
    nv, ph = (F.col("in_nv") > 0) & ~F.col("shut"), (F.col("name") == "ph") & ~F.col("shut")
    x = (F.col("in_xfrm") > 0) & ~F.col("shut")
    head, off, ext = x & (F.col("name") == "xfrm"), x & (F.col("name") == "off"), x & (F.col("name") == "ext")
    fill, mods = _color((F.col("in_spPr") > 0) & (F.col("in_fill") > 0) & (F.col("in_ln") == 0))
    text = F.array_join(F.sort_array(F.collect_list(F.when((F.col("in_t") > 0) & ~F.col("token").startswith("<"), F.struct("p", "pos", unescape_xml(F.col("token")).alias("t")))))["t"], "")
    g = tokens.where("in_sp > 0").groupBy(*key, "part", "shape").agg(
        F.min_by("name", "pos").alias("kind"), F.coalesce(_first(nv & (F.col("name") == "cNvPr"), unescape_xml(_attribute("name"))), F.lit("")).alias("name"), F.coalesce(_first(nv & (F.col("name") == "cNvPr"), _on(_attribute("hidden"))), F.lit(False)).alias("hidden"),
        F.max(F.when(ph, F.coalesce(_attribute("type"), F.lit("body")))).alias("ph_type"), F.max(F.when(ph, _attribute("idx").try_cast("int"))).alias("ph_idx"),
        _first(off, _number("x", EMU)).alias("x"), _first(off, _number("y", EMU)).alias("y"), _first(ext, _number("cx", EMU)).alias("w"), _first(ext, _number("cy", EMU)).alias("h"),
        _first(head, F.coalesce(_number("rot", 60000.0), F.lit(0.0))).alias("rotation"), _first(head, F.coalesce(_on(_attribute("flipH")), F.lit(False))).alias("flip_h"), _first(head, F.coalesce(_on(_attribute("flipV")), F.lit(False))).alias("flip_v"),
        F.max("in_group").alias("groups"), fill.alias("fill"), mods.alias("mods"), text.alias("text"),
    )
    return g


_STYLE = ("size", "bold", "italic", "face", "color", "align")


def text_levels(tokens: DataFrame, key: list[str]) -> DataFrame:
    """(key, part, list, shape, level, styles): what text styles say of levels 1 to 9, and as level 0 of all; shape is 0 in lists of the part itself."""
    of = (F.col("in_list") > 0) & ~F.col("shut")
    run = of & (F.col("name") == "defRPr")
    color, _ = _color(of & (F.col("in_fill") > 0))
    g = tokens.where("in_list > 0 and level is not null").groupBy(*key, "part", "list", F.when(F.col("in_sp") > 0, F.col("shape")).otherwise(0).alias("shape"), "level").agg(
        _first(run, _number("sz", 100.0)).alias("size"), _first(run, _on(_attribute("b"))).alias("bold"), _first(run, _on(_attribute("i"))).alias("italic"), _first(of & (F.col("name") == "latin"), _attribute("typeface")).alias("face"), color.alias("color"),
        _first(of & F.col("name").rlike(r"^(lvl\dp|defP)Pr$"), _attribute("algn")).alias("align"),
    )
    return g


def slide_runs(tokens: DataFrame, key: list[str]) -> DataFrame:
    """Runs with text: part, shape, p, run, level (from 1), text and what the run itself says.

    What a paragraph says is told by a window over its runs, so that tags are made and sorted once.
    """
    own = (F.col("in_rpr") > 0) & ~F.col("shut")
    head, para = (F.col("name") == "rPr") & ~F.col("shut"), (F.col("name") == "pPr") & ~F.col("shut")
    color, _ = _color(own & (F.col("in_fill") > 0))
    text = F.array_join(F.sort_array(F.collect_list(F.when((F.col("in_t") > 0) & ~F.col("token").startswith("<"), F.struct("pos", unescape_xml(F.col("token")).alias("t")))))["t"], "")
    of_paragraph = lambda value: F.min(F.when(para & value.isNotNull(), F.struct("pos", value.alias("v"))))
    pieces = tokens.where("in_tx > 0 and in_list = 0 and p > 0").groupBy(*key, "part", "shape", "p", "run").agg(
        text.alias("text"), _first(head, _number("sz", 100.0)).alias("size"), _first(head, _on(_attribute("b"))).alias("bold"), _first(head, _on(_attribute("i"))).alias("italic"), _first(own & (F.col("name") == "latin"), _attribute("typeface")).alias("face"), color.alias("color"),
        of_paragraph(_attribute("lvl").try_cast("int")).alias("lvl"), of_paragraph(_attribute("algn")).alias("align"),
    )
    w = Window.partitionBy(*key, "part", "p")
    told = pieces.withColumns({"lvl": F.min("lvl").over(w)["v"], "align": F.min("align").over(w)["v"]}).where("text <> ''")
    return told.withColumn("level", F.coalesce("lvl", F.lit(0)) + 1).drop("lvl")


def _kind(ph: str) -> Column:
    out = F.col(ph)
    for name, to in PLACEHOLDERS.items():
        out = F.when(F.col(ph) == name, to).otherwise(out)
    return out


def placeholders(slides: DataFrame, shapes: DataFrame, key: list[str]) -> DataFrame:
    """(key, part, shape, ph_type, layout_shape, master_shape): the placeholders of the layout and master that a slide's shape is one of.

    In the layout, the first with the same index other than 0, or of the same kind with no contradicting index; in the
    master, the first of the same kind.
    """
    own = slides.select(*key, "part", "layout", "master").join(shapes.where("ph_type is not null"), [*key, "part"]).select(*key, "part", "layout", "master", "shape", "ph_type", _kind("ph_type").alias("kind"), "ph_idx")
    other = shapes.where("ph_type is not null").select(*key, F.col("part").alias("of"), F.col("shape").alias("found"), _kind("ph_type").alias("its_kind"), F.col("ph_idx").alias("its_idx"))
    a, b = F.col("ph_idx"), F.col("its_idx")
    same = F.coalesce((a == b) & (a != 0), F.lit(False))
    open_ = a.isNull() | b.isNull() | (a == 0) | (b == 0) | (a == b)
    found = lambda where, on, name: own.withColumnRenamed(on, "of").join(other, [*key, "of"]).where(where).groupBy(*key, "part", "shape").agg(F.min("found").alias(name))
    kind = F.col("kind") == F.col("its_kind")
    out = own.join(found(same | kind & open_, "layout", "layout_shape"), [*key, "part", "shape"], "left").join(found(kind, "master", "master_shape"), [*key, "part", "shape"], "left")
    return out.select(*key, "part", "shape", "ph_type", "layout_shape", "master_shape")


def _under(shapes: DataFrame, key: list[str], part: str, shape: str, columns: tuple[str, ...]) -> DataFrame:
    return shapes.select(*key, F.col("part").alias(part), F.col("shape").alias(shape), *(F.col(c).alias(f"{part}_{c}") for c in columns))


def theme_colors(parts: DataFrame, key: list[str]) -> DataFrame:
    """(key, theme, color, digits): the colours that themes have."""
    scheme = F.regexp_extract("xml", r"(?s)<a:clrScheme\b.*?</a:clrScheme>", 0)
    entry = r'(?s)<a:(dk1|lt1|dk2|lt2|accent\d|hlink|folHlink)>\s*<a:(?:srgbClr[^>]*\sval|sysClr[^>]*\slastClr)="([0-9A-Fa-f]{6})"'
    rows = parts.where("part like 'ppt/theme/%.xml'").select(*key, F.col("part").alias("theme"), F.explode(F.regexp_extract_all(scheme, F.lit(entry), F.lit(0))).alias("x"))
    return rows.select(*key, "theme", F.regexp_extract("x", entry, 1).alias("color"), F.upper(F.regexp_extract("x", entry, 2)).alias("digits"))


_PLACE = ("x", "y", "w", "h", "rotation", "flip_h", "flip_v")


def dealt_tokens(parts: DataFrame, key: list[str]) -> DataFrame:
    """Tags of parts that are written or cheap to make again; parts are dealt by the bytes of their XML, and no tags are shuffled."""
    return slide_tokens(parts.repartition(partitions(parts, "xml", XML_BYTES), *key, "part"), key)


def resolved_shapes(parts: DataFrame, tokens: DataFrame, key: list[str]) -> DataFrame:
    """Shapes of slides in order: slide, shape, kind, name, hidden, ph_type, place, color (six digits, null: none), alpha and text.

    The place is the shape's, else its layout placeholder's, else its master's, as a whole; so is the fill.  Slides and
    shapes are looked at several times and written once.
    """
    slides, shapes = written(deck_slides(parts, key), "slides"), written(slide_shapes(tokens, key), "shapes")
    placed = shapes.withColumns({"place": F.when(F.col("x").isNotNull() | F.col("w").isNotNull(), F.struct(*_PLACE)), "paint": F.when(F.col("fill").isNotNull(), F.struct("fill", "mods"))})
    under = ("place", "paint")
    rows = slides.drop("hidden").join(placed, [*key, "part"]).join(placeholders(slides, shapes, key).select(*key, "part", "shape", "layout_shape", "master_shape"), [*key, "part", "shape"], "left")
    rows = rows.join(_under(placed, key, "layout", "layout_shape", under), [*key, "layout", "layout_shape"], "left").join(_under(placed, key, "master", "master_shape", under), [*key, "master", "master_shape"], "left")
    rows = rows.withColumns({c: F.coalesce(c, f"layout_{c}", f"master_{c}") for c in under})
    name = F.col("paint.fill")
    for a, b in COLOR_NAMES.items():
        name = F.when(F.col("paint.fill") == a, b).otherwise(name)
    rows = rows.withColumn("__color", name).join(theme_colors(parts, key).withColumnRenamed("color", "__color"), [*key, "theme", "__color"], "left")
    usual = F.create_map(*(F.lit(v) for pair in THEME.items() for v in pair))
    digits = F.coalesce("digits", F.try_element_at(usual, F.coalesce("__color", F.lit(""))), F.when(F.col("__color").rlike("^[0-9A-Fa-f]{6}$"), F.col("__color")), F.when(F.col("__color").isNotNull(), "000000"))
    rows = rows.withColumn("__rgb", transformed(F.when(digits.isNotNull(), rgb(digits)), F.col("paint.mods")))
    return rows.select(*key, "slide", "shape", "kind", "name", F.col("hidden"), "ph_type", *(F.col(f"place.{c}").alias(c) for c in _PLACE), hexadecimal(F.col("__rgb")).alias("color"), F.col("__rgb.alpha").alias("alpha"), "text")


def resolved_runs(parts: DataFrame, tokens: DataFrame, key: list[str]) -> DataFrame:
    """Runs of slides: slide, shape, p, run, level, text, size, bold, italic, face, align.

    What a run does not say comes from its paragraph's level in the lists of the shape, of its layout and master
    placeholders, of the master's styles for titles, bodies and others, and of the presentation; a level before all levels.
    Slides, placeholders and levels are written once; only parts that have levels are cut into tags for these.
    """
    slides = written(deck_slides(parts, key), "slides")
    shapes = written(slide_shapes(tokens, key).select(*key, "part", "shape", "ph_type", "ph_idx").where("ph_type is not null"), "placeholders")
    levels = written(text_levels(dealt_tokens(parts.where(F.col("xml").rlike(r"<(?:\w+:)?(lvl\dpPr|defPPr)\b")), key), key), "levels")
    runs = slides.join(slide_runs(tokens, key), [*key, "part"]).join(placeholders(slides, shapes, key).select(*key, "part", "shape", "ph_type", "layout_shape", "master_shape"), [*key, "part", "shape"], "left")
    ph = F.col("ph_type")
    runs = runs.withColumn("style", F.when(ph.isin("title", "ctrTitle"), "titleStyle").when(ph.isin("body", "subTitle", "obj"), "bodyStyle").when(ph.isNotNull(), "otherStyle"))
    names = ("size", "bold", "italic", "face", "align")
    values = F.struct(*names)
    sources = []
    for n, (part, shape, list_) in enumerate((("part", "shape", F.lit("lstStyle")), ("layout", "layout_shape", F.lit("lstStyle")), ("master", "master_shape", F.lit("lstStyle")), ("master", None, F.col("style")), (None, None, F.lit("defaultTextStyle")))):
        runs = runs.withColumns({"__list": list_, "__shape": F.lit(0) if shape is None else F.col(shape), "__part": F.lit("ppt/presentation.xml") if part is None else F.col(part)})
        for at in ("level", "all"):
            own = levels.where("level > 0" if at == "level" else "level = 0").select(*key, F.col("part").alias("__part"), F.col("list").alias("__list"), F.col("shape").alias("__shape"), *(["level"] if at == "level" else []), values.alias(f"s{n}{at}"))
            runs = runs.join(own, [*key, "__part", "__list", "__shape", *(["level"] if at == "level" else [])], "left")
            sources.append(f"s{n}{at}")
    found = {c: F.coalesce(c, *(F.col(f"{s}.{c}") for s in sources)) for c in names}
    usual = {"size": F.lit(TEXT_SIZE), "bold": F.lit(False), "italic": F.lit(False), "align": F.lit("l")}
    return runs.select(*key, "slide", "shape", "p", "run", "level", "text", *((F.coalesce(v, usual[c]) if c in usual else v).alias(c) for c, v in found.items()))
