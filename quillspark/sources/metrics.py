"""Metrics of faces as relations: widths (face, ch, width) and pairs (face, pair, kern), in thousandths of the size."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.metrics import FACES, PAIRS, glyphs

# The names of accents within names of glyphs, and the combining marks that they stand for.
_ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "ring": "̊", "cedilla": "̧", "caron": "̌", "macron": "̄", "breve": "̆", "ogonek": "̨", "dotaccent": "̇"}


def standard_metrics(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Widths and some pairs of the faces that are known without a file."""
    widths = [(face, ch, w) for face in FACES for ch, w in glyphs(face).items()]
    pairs = [(face, pair, k) for face in FACES if face != "mono" for pair, k in PAIRS.items()]
    return spark.createDataFrame(widths, "face string, ch string, width int"), spark.createDataFrame(pairs, "face string, pair string, kern int")


def _accented() -> dict[str, str]:
    """Characters by the names that letters with an accent have: Aacute, ccaron."""
    named = ((b + n, unicodedata.normalize("NFC", b + m)) for c in range(26) for b in (chr(65 + c), chr(97 + c)) for n, m in _ACCENTS.items())
    return {name: ch for name, ch in named if len(ch) == 1}


def metrics_of_files(lines: DataFrame, face: str, line: str) -> tuple[DataFrame, DataFrame]:
    """Widths and pairs from the lines of metrics files: ``C 65 ; WX 667 ; N A ;`` and ``KPX A V -70``.

    ``face`` is the column with a file's face.  Codes give the characters of ASCII but for the two curved quotes; letters
    with an accent are known by their names, others are left out.  Of several lines for a character the widest counts, of
    several for a pair the closest.  Lines of other kinds, null or broken ones among them, are passed over.
    """
    spark = lines.sparkSession
    part = lambda p: F.regexp_extract(line, p, 1)
    read = lines.where(F.col(line).rlike(r"^(C|KPX)\s")).select(
        F.col(face).alias("face"), part(r"^C\s+(-?\d+)").try_cast("int").alias("code"), part(r"WX\s+(-?\d+)").try_cast("int").alias("width"), part(r";\s*N\s+(\S+)").alias("name"),
        part(r"^KPX\s+(\S+)").alias("a"), F.regexp_extract(line, r"^KPX\s+(\S+)\s+(\S+)\s+(-?\d+)", 2).alias("b"), F.regexp_extract(line, r"^KPX\s+(\S+)\s+(\S+)\s+(-?\d+)", 3).try_cast("int").alias("kern"),
    )
    accented = F.broadcast(spark.createDataFrame(list(_accented().items()), "name string, accented string"))
    curved = F.when(F.col("code") == 39, "’").when(F.col("code") == 96, "‘")
    ch = F.coalesce(F.when(F.col("code").between(32, 126), F.coalesce(curved, F.char("code"))), F.when(F.col("name") == "quotesingle", "'").when(F.col("name") == "grave", "`"), F.col("accented"))
    known = read.where("width is not null and name <> ''").join(accented, "name", "left").select("face", "name", ch.alias("ch"), "width").where("ch is not null")
    widths = known.groupBy("face", "ch").agg(F.max("width").alias("width"))
    names = known.select("face", "name", "ch").distinct()
    side = lambda n: names.select("face", F.col("name").alias(n), F.col("ch").alias(f"ch_{n}"))
    pairs = read.where("kern is not null").join(side("a"), ["face", "a"]).join(side("b"), ["face", "b"])
    return widths, pairs.groupBy("face", F.concat("ch_a", "ch_b").alias("pair")).agg(F.min("kern").alias("kern"))
