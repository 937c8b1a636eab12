"""Scalar functions on text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of personal data that redaction offers.
PRESETS = {
    "email": r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}",
    "phone": r"(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?)?\d{3,4}[\s.-]?\d{3,4}(?:[\s.-]?\d{2,4})?",
    "number": r"\b\d(?:[\d\s-]{6,}\d)\b",
}
# Fixed value: what opens a list item, with the white space behind it.
BULLET = r"^\s*([•◦▪▫‣⁃●○■□–—\-*·►➢✓✔]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|[ivxIVX]{1,4}[.)])\s+"


def escape_markdown(t: Column) -> Column:
    return F.regexp_replace(t, r"([\\`*_\[\]#|<>])", r"\\$1")


def escape_xml(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def unescape_xml(t: Column) -> Column:
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")):
        t = F.replace(t, F.lit(b), F.lit(a))
    return t


def comparable(t: Column) -> Column:
    """A word as comparison sees it: straight quotes, no soft hyphens."""
    return F.translate(t, "‘’“”\u00ad", "''\"\"")


def collapsed(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def dehyphenated(t: Column) -> Column:
    """Lines joined: a word cut by a hyphen becomes one, other line ends become spaces."""
    return F.regexp_replace(F.regexp_replace(t, r"([A-Za-z])-\n([a-z])", "$1$2"), "\n", " ")


# What a number in a cell looks like, and codes that stay as they are.
NUMBER = r"^\(?-?[$€£]?\d{1,3}(,\d{3})*(\.\d+)?\)?%?$|^\(?-?[$€£]?\d+(\.\d+)?\)?%?$"
CODE = r"^0\d"


def recovered_number(t: Column) -> Column:
    """The number that a cell's text shows: "1,234.50", "(300)", "45%", "$5"; null for text and for codes such as 007."""
    t = F.trim(t)
    looks = t.rlike(NUMBER) & ~t.rlike(CODE)
    n = F.regexp_replace(t, r"[^0-9.]", "").try_cast("double")
    sign = F.when(t.startswith("(") | t.startswith("-"), -1.0).otherwise(1.0)
    return F.when(looks, sign * n / F.when(t.endswith("%"), 100.0).otherwise(1.0))


def file_base(name: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(name, r"\.[^/.]+$", "")


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^/.]+)$", 1))


def clean_file_name(name: Column) -> Column:
    """Characters that file systems refuse become spaces."""
    return collapsed(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1F]+', " "))


def font_face(t: Column) -> Column:
    """The face that can show a text: by its first script that is not Latin."""
    return F.when(t.rlike(r"[\u0900-\u097F]"), "devanagari").when(t.rlike(r"[\u3040-\u30FF\u3400-\u9FFF\uAC00-\uD7AF]"), "cjk").otherwise("latin")


def western(t: Column) -> Column:
    """Whether every character is printable ASCII or in the Latin-1 supplement."""
    return ~t.rlike(r"[^\x20-\x7E\u00A0-\u00FF]")


def error_class(message: Column) -> Column:
    m = F.lower(message)
    return (
        F.when(m.rlike("password|encrypt"), "locked").when(m.rlike("not found|no longer|moved or deleted|permission"), "gone")
        .when(m.rlike("memory|allocation|too large"), "memory").when(m.rlike("invalid|corrupt|damaged|xref|parse"), "damaged").otherwise("other")
    )


def graphemes(t: Column) -> Column:
    """The characters that a reader sees; marks stay with their letters."""
    return F.regexp_extract_all(t, F.lit(r"\X"), F.lit(0))


def distinct_characters(t: Column) -> Column:
    """Every character of a text once, in order of its first place."""
    return F.array_join(F.array_distinct(F.filter(F.split(t, ""), lambda c: c != "")), "")


def ellipsized(t: Column, most: Column, width) -> Column:
    """The text, or where it is wider than ``most`` as much of it as fits before an ellipsis, one character at least.

    ``width`` gives the width of a character.
    """
    chars = F.filter(F.split(collapsed(t), ""), lambda c: c != "")
    total = lambda cs: F.aggregate(cs, F.lit(0.0), lambda s, c: s + width(c))
    start = F.struct(width(F.lit("…")).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(s: Column, c: Column) -> Column:
        used = s["used"] + width(c)
        full = s["full"] | (used > most)
        return F.struct(used.alias("used"), F.when(full, s["n"]).otherwise(s["n"] + 1).alias("n"), full.alias("full"))

    kept = F.greatest(F.aggregate(chars, start, step)["n"], F.lit(1))
    return F.when(total(chars) <= most, collapsed(t)).otherwise(F.concat(F.array_join(F.slice(chars, F.lit(1), kept), ""), F.lit("…")))
