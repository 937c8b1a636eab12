"""Colours by brute force; presentations made by hand and damaged ones."""

import colorsys
import io
import random
import zipfile

from pyspark.sql import functions as F

from quillspark.functions import colors as K
from quillspark.sources import slides as S


def linear(x):
    return x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4


def gamma(x):
    x = min(max(x, 0), 1)
    return x * 12.92 if x <= 0.0031308 else 1.055 * x ** (1 / 2.4) - 0.055


def by_hand(color, mods):
    c, alpha = [v / 255 for v in color], 1.0
    for name, v in mods:
        f = v / 100000
        if name.startswith("alpha"):
            alpha = {"alpha": f, "alphaMod": alpha * f, "alphaOff": alpha + f}[name]
        elif name[:3] in ("lum", "sat", "hue") or name == "comp":
            h, light, s = colorsys.rgb_to_hls(*c)
            if name == "comp":
                h += 0.5
            elif name[:3] == "hue":
                h = {"hue": v / 60000 / 360, "hueMod": h * f, "hueOff": h + v / 60000 / 360}[name]
            elif name[:3] == "sat":
                s = {"sat": f, "satMod": s * f, "satOff": s + f}[name]
            else:
                light = {"lum": f, "lumMod": light * f, "lumOff": light + f}[name]
            c = list(colorsys.hls_to_rgb(h % 1, min(max(light, 0), 1), min(max(s, 0), 1)))
        elif name in ("tint", "shade"):
            c = [gamma(linear(x) * f + (1 - f if name == "tint" else 0)) for x in c]
        elif name == "inv":
            c = [1 - x for x in c]
        elif name == "gray":
            c = [0.299 * c[0] + 0.587 * c[1] + 0.114 * c[2]] * 3
        else:
            for k, long in enumerate(("red", "green", "blue")):
                if name.startswith(long):
                    c[k] = {"": f, "Mod": c[k] * f, "Off": c[k] + f}[name[len(long) :]]
    return [min(max(x * 255, 0), 255) for x in c] + [min(max(alpha, 0), 1)]


def test_colour_transforms(spark):
    r = random.Random(12)
    names = [a + b for a in ("lum", "sat", "hue", "alpha", "red", "green", "blue") for b in ("", "Mod", "Off")] + ["tint", "shade", "inv", "gray", "comp", "nothing"]
    rows = []
    for k in range(400):
        mods = [(n, float(r.randint(0, 21_600_000) if n in ("hue", "hueOff") else r.randint(0, 120_000))) for n in r.choices(names, k=r.randint(0, 4))]
        color = [float(r.randint(0, 255))] * 3 if k % 10 == 0 else [float(r.choice([0, 255, r.randint(0, 255)])) for _ in range(3)]
        if k % 9 == 0 and mods:
            mods = [m for m in mods if not m[0].startswith(("red", "green", "blue"))]
        rows.append((k, color, mods))
    df = spark.createDataFrame(rows, "k int, c array<double>, mods array<struct<name: string, val: double>>")
    base = F.struct(*(F.col("c")[i].alias(x) for i, x in enumerate("rgb")), F.lit(1.0).alias("alpha"))
    got = {x.k: [x.t[c] for c in ("r", "g", "b", "alpha")] for x in df.select("k", K.transformed(base, F.col("mods")).alias("t")).collect()}
    over = 0
    for k, color, mods in rows:
        if any(n.startswith(("red", "green", "blue")) for n, _ in mods):  # channels beyond their range have no hue
            over += 1
            continue
        assert all(abs(a - b) < 1e-6 for a, b in zip(got[k], by_hand(color, mods), strict=True)), (color, mods)
    assert over < 250
    single = [(k, [10.0, 200.0, 90.0], [(n, 50_000.0)]) for k, n in enumerate(["red", "greenMod", "blueOff", "redOff"])]
    df = spark.createDataFrame(single, df.schema)
    for x in df.select("k", K.transformed(base, F.col("mods")).alias("t")).collect():
        assert all(abs(a - b) < 1e-9 for a, b in zip([x.t[c] for c in ("r", "g", "b", "alpha")], by_hand(single[x.k][1], single[x.k][2]), strict=True))
    assert spark.range(1).select(K.hexadecimal(K.rgb(F.lit("0aFF7f")))).first()[0] == "0AFF7F"


def package(**parts):
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr("ppt/" + name.replace("__", "/"), text)
    return bytearray(blob.getvalue())


def sp(name, ph="", place="", text="", body=True):
    at = f'<a:xfrm rot="60000"><a:off x="{place[0] * 12700}" y="0"/><a:ext cx="12700" cy="12700"/></a:xfrm>' if place else ""
    return f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{name}"/><p:nvPr>{ph and f"<p:ph {ph}/>"}</p:nvPr></p:nvSpPr><p:spPr>{at}</p:spPr>' + (f"<p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody>" if body else "") + "</p:sp>"


def rels(**links):
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Type="http://x/{v[0]}" Target="{v[1]}"{v[2] if len(v) > 2 else ""}/>' for k, v in links.items()) + "</Relationships>"


DECK = {
    "presentation.xml": "<p:presentation/>", "slides__slide10.xml": f'<p:sld show="0"><p:spTree>{sp("ten", "type=\"subTitle\" idx=\"4\"", "", "a &amp; b")}<p:grpSp>{sp("in", "", (3,), "g")}</p:grpSp></p:spTree></p:sld>',
    "slides__slide2.xml": f'<p:sld><p:spTree>{sp("two", "type=\"dt\" idx=\"9\"", "", "date")}{sp("three", "type=\"title\"", (7,), "own")}</p:spTree></p:sld>',
    "slides___rels__slide10.xml.rels": rels(a=("slideLayout", "../slideLayouts/l.xml"), b=("image", "http://x", ' TargetMode="External"')), "slideLayouts__l.xml": f'<p:sldLayout>{sp("first", "type=\"obj\" idx=\"3\"", (1,))}{sp("fourth", "type=\"pic\" idx=\"4\"", (4,))}</p:sldLayout>',
    "slides___rels__slide2.xml.rels": rels(a=("slideLayout", "/ppt/slideLayouts/l.xml")), "slideLayouts___rels__l.xml.rels": rels(m=("slideMaster", "../x/../slideMasters/m.xml")), "slideMasters__m.xml": f'<p:sldMaster>{sp("m", "type=\"dt\" idx=\"2\"", (9,))}</p:sldMaster>',
}


def test_decks_without_a_list_groups_and_placeholders(spark):
    parts = S.slide_parts(spark.createDataFrame([(1, package(**DECK)), (2, bytearray(b"PK")), (3, None), (4, package(**{"x.xml": "<a/>"}))], "id int, content binary"), ["id"])
    assert sorted(r.id for r in parts.where("error is not null").collect()) == [2, 3, 4]
    assert [(r.slide, r.part, r.hidden, r.layout, r.master, r.theme) for r in S.deck_slides(parts, ["id"]).orderBy("slide").collect()] == [
        (1, "ppt/slides/slide2.xml", False, "ppt/slideLayouts/l.xml", "ppt/slideMasters/m.xml", None), (2, "ppt/slides/slide10.xml", True, "ppt/slideLayouts/l.xml", "ppt/slideMasters/m.xml", None),
    ]
    tokens = S.slide_tokens(parts, ["id"])
    got = [(r.slide, r.name, r.x, r.rotation, r.color, r.text) for r in S.resolved_shapes(parts, tokens, ["id"]).orderBy("slide", "shape").collect()]
    assert got == [(1, "two", 9.0, 1.0, None, "date"), (1, "three", 7.0, 1.0, None, "own"), (2, "ten", 4.0, 1.0, None, "a & b"), (2, "in", 3.0, 1.0, None, "g")]
    runs = [(r.text, r["size"], r.bold, r.align) for r in S.resolved_runs(parts, tokens, ["id"]).orderBy("slide", "shape").collect()]
    assert runs == [(t, 18.0, False, "l") for t in ("date", "own", "a & b", "g")]
