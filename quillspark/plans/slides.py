"""Queries on presentations, one for each nation with a slide for each of its customers, and on colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import colors as K
from quillspark.plans.registry import query
from quillspark.sources import slides as S
from quillspark.sources.shared import written
from quillspark.sources.tables import read

_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_NS = f'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="{_REL}" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
_PH = lambda kind, place="", text="": f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="x"/><p:cNvSpPr/><p:nvPr><p:ph {kind}/></p:nvPr></p:nvSpPr><p:spPr>{place}</p:spPr><p:txBody><a:bodyPr/>{text}<a:p/></p:txBody></p:sp>'
_AT = lambda x, y, w, h: f'<a:xfrm><a:off x="{x * 12700}" y="{y * 12700}"/><a:ext cx="{w * 12700}" cy="{h * 12700}"/></a:xfrm>'
_TREE = lambda tag, body, rest="": f"<p:{tag} {_NS}><p:cSld><p:spTree>{body}</p:spTree></p:cSld>{rest}</p:{tag}>"
_LINK = lambda kind, target: f'<Relationships><Relationship Id="rId1" Type="{_REL}/{kind}" Target="{target}"/></Relationships>'

_FIXED = {
    "ppt/slideLayouts/slideLayout1.xml": _TREE("sldLayout", _PH('type="ctrTitle"', _AT(50, 20, 860, 80)) + _PH('idx="1"', "", '<a:lstStyle><a:lvl1pPr><a:defRPr sz="2000"/></a:lvl1pPr></a:lstStyle>')),
    "ppt/slideLayouts/_rels/slideLayout1.xml.rels": _LINK("slideMaster", "../slideMasters/slideMaster1.xml"),
    "ppt/slideMasters/slideMaster1.xml": _TREE(
        "sldMaster", _PH('type="title"', _AT(1, 2, 3, 4)) + _PH('type="body" idx="1"', _AT(50, 120, 600, 300), '<a:lstStyle><a:lvl1pPr><a:defRPr sz="9900"/></a:lvl1pPr><a:lvl2pPr><a:defRPr sz="1700"/></a:lvl2pPr></a:lstStyle>'),
        '<p:txStyles><p:titleStyle><a:lvl1pPr algn="ctr"><a:defRPr sz="4400" b="1"><a:latin typeface="+mj-lt"/></a:defRPr></a:lvl1pPr></p:titleStyle><p:bodyStyle><a:lvl1pPr><a:defRPr sz="3200"/></a:lvl1pPr><a:lvl2pPr><a:defRPr sz="2800"/></a:lvl2pPr><a:lvl3pPr><a:defRPr sz="2400"/></a:lvl3pPr></p:bodyStyle><p:otherStyle/></p:txStyles>',
    ),
    "ppt/slideMasters/_rels/slideMaster1.xml.rels": _LINK("theme", "/ppt/theme/theme1.xml"),
    "ppt/theme/theme1.xml": '<a:theme><a:themeElements><a:clrScheme name="x"><a:dk1><a:sysClr val="windowText" lastClr="111111"/></a:dk1><a:accent1><a:srgbClr val="0a0b0c"/></a:accent1><a:accent2><a:srgbClr val="102030"/></a:accent2></a:clrScheme></a:themeElements></a:theme>',
}


def _xml(*pieces: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces))


def _decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every nation's deck."""
    k = F.col("c_custkey")
    text = lambda c: F.replace(F.col(c), F.lit("&"), F.lit("&amp;"))
    title = _xml(
        '<p:sp><p:nvSpPr><p:cNvPr id="2" name="Title"/><p:cNvSpPr/><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:spPr>', F.when(k % 3 == 0, _xml('<a:xfrm><a:off x="', k % 50 * 12700, '" y="127000"/><a:ext cx="3810000" cy="508000"/></a:xfrm>')).otherwise(""),
        "</p:spPr><p:txBody><a:bodyPr/><a:p><a:r>", F.when(k % 4 == 0, _xml('<a:rPr sz="', (30 + k % 5) * 100, '"/>')).otherwise(""), "<a:t>", text("c_name"), "</a:t></a:r></a:p></p:txBody></p:sp>",
    )
    body = _xml(
        '<p:sp><p:nvSpPr><p:cNvPr id="3" name="Text" hidden="', k % 2, '"/><p:cNvSpPr/><p:nvPr><p:ph idx="1"/></p:nvPr></p:nvSpPr><p:spPr><a:ln><a:solidFill><a:srgbClr val="FFFFFF"/></a:solidFill></a:ln><a:solidFill><a:schemeClr val="accent', k % 6 + 1, '">', F.when(k % 2 == 1, "<a:inv/>").otherwise(""),
        '</a:schemeClr></a:solidFill></p:spPr><p:txBody><a:bodyPr/><a:lstStyle/><a:p><a:pPr lvl="', k % 3, '"/><a:r><a:rPr', F.when(k % 5 == 0, ' b="1"').otherwise(""), "/><a:t>", text("c_mktsegment"), "</a:t></a:r></a:p></p:txBody></p:sp>",
    )
    box = _xml(
        '<p:sp><p:nvSpPr><p:cNvPr id="4" name="Box"/><p:cNvSpPr txBox="1"/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm rot="', k % 4 * 5400000, '" flipH="', k % 2, '"><a:off x="', k % 7 * 127000, '" y="63500"/><a:ext cx="1270000" cy="254000"/></a:xfrm><a:solidFill><a:srgbClr val="1a2B3c"><a:alpha val="50000"/></a:srgbClr></a:solidFill></p:spPr>',
        "<p:txBody><a:bodyPr/><a:p><a:r><a:t>", k, "</a:t></a:r></a:p></p:txBody></p:sp>",
    )
    slide = _xml(f'<p:sld {_NS}><p:cSld><p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/></p:nvGrpSpPr>', title, body, box, "</p:spTree></p:cSld></p:sld>")
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    numbered = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name", "c_mktsegment", n.alias("n"))  # numbered before it is XML
    rows = numbered.select(F.col("c_nationkey").cast("long").alias("deck"), "n", slide.alias("xml"))
    part = lambda name, xml: F.struct(name.alias("part"), xml.alias("xml"))
    own = F.array(part(_xml("ppt/slides/slide", F.col("n"), ".xml"), F.col("xml")), part(_xml("ppt/slides/_rels/slide", F.col("n"), ".xml.rels"), F.lit(_LINK("slideLayout", "../slideLayouts/./slideLayout1.xml"))))
    ids = F.array_join(F.transform(F.reverse(F.sequence(F.lit(1), F.col("m"))), lambda i: _xml('<p:sldId id="', i + 255, '" r:id="rId', i, '"/>')), "")
    links = F.array_join(F.transform(F.sequence(F.lit(1), F.col("m")), lambda i: _xml('<Relationship Id="rId', i, f'" Type="{_REL}/slide" Target="slides/slide', i, '.xml"/>')), "")
    deck = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("deck")).agg(F.count(F.lit(1)).cast("int").alias("m"))
    styles = '<p:defaultTextStyle><a:defPPr algn="r"/><a:lvl1pPr><a:defRPr sz="1500" i="1"/></a:lvl1pPr></p:defaultTextStyle>'
    whole = F.array(
        part(F.lit("ppt/presentation.xml"), _xml(f"<p:presentation {_NS}><p:sldIdLst>", ids, f"</p:sldIdLst>{styles}</p:presentation>")), part(F.lit("ppt/_rels/presentation.xml.rels"), _xml("<Relationships>", links, "</Relationships>")),
        *(part(F.lit(name), F.lit(xml)) for name, xml in _FIXED.items()),
    )
    return rows.select("deck", F.inline(own)).unionByName(deck.select("deck", F.inline(whole)))


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of all decks, written as packages and read back; kept, as they are looked at several times."""
    return written(S.written_and_read(_decks(spark, sf_dir), ["deck"]), "parts")


_ACCENTS = ["0A0B0C", "102030", S.THEME["accent3"], S.THEME["accent4"], S.THEME["accent5"], S.THEME["accent6"]]
_INVERSE = ["".join(f"{255 - int(c[k : k + 2], 16):02X}" for k in (0, 2, 4)) for c in _ACCENTS]
_SLIDES = "with c as (select *, c_nationkey::bigint as deck, c_custkey as k, row_number() over (partition by c_nationkey order by c_custkey desc) as slide from customer)\n"


@query(_SLIDES + f"""select deck, slide, 1::bigint as shape, 'Title' as name, false as hidden, 'title' as ph_type, case when k % 3 = 0 then k % 50 else 50 end::double as x, case when k % 3 = 0 then 10 else 20 end::double as y, case when k % 3 = 0 then 300 else 860 end::double as w, case when k % 3 = 0 then 40 else 80 end::double as h,
      0.0::double as rotation, false as flip_h, null::varchar as color, null::double as alpha, c_name as text from c
    union all select deck, slide, 2, 'Text', k % 2 = 1, 'body', 50, 120, 600, 300, 0, false, case when k % 2 = 1 then {_INVERSE}[k % 6 + 1] else {_ACCENTS}[k % 6 + 1] end, 1, c_mktsegment from c
    union all select deck, slide, 3, 'Box', false, null, k % 7 * 10, 5, 100, 20, k % 4 * 90, k % 2 = 1, '1A2B3C', 0.5, k::varchar from c""")
def slide_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of all slides with the place and fill that they have or inherit."""
    parts = _read(spark, sf_dir)
    return S.resolved_shapes(parts, S.dealt_tokens(parts, ["deck"]), ["deck"]).select("deck", F.col("slide").cast("long").alias("slide"), "shape", "name", "hidden", "ph_type", "x", "y", "w", "h", "rotation", "flip_h", "color", "alpha", "text")


@query(_SLIDES + """select deck, slide, 1::bigint as shape, 1::int as level, c_name as text, case when k % 4 = 0 then 30 + k % 5 else 44 end::double as size, true as bold, true as italic, '+mj-lt' as face, 'ctr' as align from c
    union all select deck, slide, 2, k % 3 + 1, c_mktsegment, [20, 17, 24][k % 3 + 1], k % 5 = 0, k % 3 = 0, null, 'r' from c
    union all select deck, slide, 3, 1, k::varchar, 15, false, true, null, 'r' from c""")
def slide_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all slides with the looks that they have or inherit by level."""
    parts = _read(spark, sf_dir)
    found = S.resolved_runs(parts, S.dealt_tokens(parts, ["deck"]), ["deck"])
    return found.select("deck", F.col("slide").cast("long").alias("slide"), "shape", "level", "text", "size", "bold", "italic", "face", "align")


@query("""with s as (select p_partkey, p_partkey * 7 % 256 / 255.0::double as r, p_partkey * 13 % 256 / 255.0::double as g, p_partkey * 29 % 256 / 255.0::double as b, p_partkey % 5 as t from part),
    h as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo from s), l as (select *, (hi + lo) / 2 as l0, hi - lo as d from h),
    m as (select *, least(l0 * 0.6 + 0.15, 1) as l1, case when d = 0 then 0 when l0 > 0.5 then d / (2 - hi - lo) else d / (hi + lo) end as s1,
      case when d = 0 then 0 when hi = r then (g - b) / d + case when g < b then 6 else 0 end when hi = g then (b - r) / d + 2 else (r - g) / d + 4 end / 6 as h1 from l),
    q as (select *, case when l1 < 0.5 then l1 * (1 + s1) else l1 + s1 - l1 * s1 end as q1 from m), p as (select *, 2 * l1 - q1 as p1 from q),
    c as (select p_partkey, """ + ", ".join(f"case when s1 = 0 then l1 when {t} < 1/6.0::double then p1 + (q1 - p1) * 6 * {t} when {t} < 0.5 then q1 when {t} < 2/3.0::double then p1 + (q1 - p1) * (2/3.0::double - {t}) * 6 else p1 end as {n}" for n, t in (("r", "((h1 + 4/3.0::double) % 1)"), ("g", "(h1 % 1)"), ("b", "((h1 + 2/3.0::double) % 1)"))) + """ from p)
    select p_partkey, round(r * 255, 4) as r, round(g * 255, 4) as g, round(b * 255, 4) as b, 0.4::double as alpha from c""")
def color_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of all parts after a list of transforms: darker by luminance, lifted, with half of four fifths of alpha."""
    k = F.col("p_partkey")
    mods = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).cast("double").alias("val")) for n, v in (("lumMod", 60000), ("alpha", 80000), ("lumOff", 15000), ("alphaMod", 50000), ("unknown", 1))))
    base = F.struct((k * 7 % 256).cast("double").alias("r"), (k * 13 % 256).cast("double").alias("g"), (k * 29 % 256).cast("double").alias("b"), F.lit(1.0).alias("alpha"))
    c = K.transformed(base, mods)
    return read(spark, sf_dir, "part").select("p_partkey", c.alias("c")).select("p_partkey", *(F.round(f"c.{x}", 4).alias(x) for x in "rgb"), "c.alpha")
