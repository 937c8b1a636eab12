"""Widths of characters by the metrics of faces: what every glyph takes, in thousandths of the size."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The widths of the glyphs of three standard faces, as width -> characters.
FACES = {
    "sans": {
        191: "'", 222: "ijl‘’", 260: "|", 278: " !,./:;I[\\]ft", 333: "()-`r“”", 334: "{}", 350: "•", 355: '"', 389: "*", 400: "°", 469: "^", 500: "Jckxsvyz", 556: "#$0123456789?L_abdeghnopqu£€§–",
        584: "+<=>~", 611: "FTZ", 667: "&ABEKPSVXY", 722: "CDHNRUw", 737: "©®", 778: "GOQ", 833: "Mm", 889: "%", 944: "W", 1000: "—…", 1015: "@",
    },
    "sans_bold": {
        238: "'", 278: " ,./I\\ijl‘’", 280: "|", 333: "!()-:;[]`ft", 350: "•", 389: "*r{}", 400: "°", 474: '"', 500: "z“”", 556: "#$0123456789J_aceksvxy£€§–",
        584: "+<=>^~", 611: "?FLTZbdghnopqu", 667: "EPSVXY", 722: "&ABCDHKNRU", 737: "©®", 778: "GOQw", 833: "M", 889: "%m", 944: "W", 975: "@", 1000: "—…",
    },
    "mono": {600: "".join(map(chr, range(32, 127))) + "‘’“”•°£€§–©®—…"},
}
#: Width of an i under another accent than its dot, in both proportional faces.
_DOTLESS = 278
#: Some pairs that the proportional faces set closer.  All pairs of a face come from its metrics file.
PAIRS = {"AV": -70, "VA": -80, "AT": -120, "AY": -100, "To": -120, "Te": -120, "Yo": -140, "LT": -110, "WA": -50, "PA": -120, "FA": -80}


def glyphs(face: str) -> dict[str, int]:
    """Width by character: the face's own, and those of Latin letters with an accent, which are as wide as without."""
    own = {c: w for w, chars in FACES[face].items() for c in chars}
    for code in range(0xC0, 0x180):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base in own:
            own[chr(code)] = _DOTLESS if base == "i" and face != "mono" else own[base]
    return own


def glyph_width(face: str, size: float, missing: int = 556) -> Callable[[Column], Column]:
    """The width of a character (a column) in a face; ``missing`` thousandths for characters that it does not have."""
    own = glyphs(face)
    table = F.lit([float(own.get(chr(c), missing)) for c in range(0x180)])
    other = {}
    for c, w in own.items():
        if ord(c) >= 0x180:
            other.setdefault(float(w), []).append(c)

    def width(ch: Column) -> Column:
        out = F.get(table, F.ascii(ch))
        for w, chars in other.items():
            out = F.coalesce(out, F.when(ch.isin(chars), w))
        return F.coalesce(out, F.lit(float(missing))) * (size / 1000)

    return width


def measured(text: Column | str, width: Callable[[Column], Column]) -> Column:
    """The width of a text, a sum over its characters without pairs."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0.0), lambda s, c: s + width(c))
