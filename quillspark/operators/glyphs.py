"""Operators on characters: runs, scripts, widths, line ends, names of parts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from quillspark.functions.metrics import measured
from quillspark.functions.slices import lists, sliced


def characters(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, ch) of every character."""
    return df.select(key, F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("pos", "ch"))


def glyph_runs(glyphs: DataFrame, key: list[str]) -> DataFrame:
    """Glyphs (key, pos, ch, x, y, w, size, font) joined into runs: same font, size within 0.1, baseline within 0.1 sizes, gap under 0.04 sizes."""
    order = Window.partitionBy(*key).orderBy("pos")
    before = lambda c: F.lag(c).over(order)
    joined = (
        (before("font") == F.col("font")) & (F.abs(before("size") - F.col("size")) < 0.1) & (F.abs(before("y") - F.col("y")) < F.col("size") * 0.1)
        & (F.col("x") - (before("x") + before("w")) < F.col("size") * 0.04)
    )
    marked = glyphs.withColumn("new", (~F.coalesce(joined, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(order).cast("int") - 1)
    g = marked.groupBy(*key, "run").agg(F.sort_array(F.collect_list(F.struct("pos", "ch"))).alias("c"), F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max("size").alias("size"))
    return g.select(*key, "run", F.array_join(F.col("c.ch"), "").alias("text"), "x", "x1", "size")


def script_runs(chars: DataFrame, key: str) -> DataFrame:
    """Runs of one script: latin, or other letters; all that is no letter stays with the run before it."""
    latin = F.col("ch").rlike(r"[A-Za-zÀ-ɏ]")
    own = F.when(latin, "latin").when(F.col("ch").rlike(r"\p{L}"), "other")
    order = Window.partitionBy(key).orderBy("pos")
    script = F.coalesce(F.last(own, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("latin"))
    marked = chars.withColumn("script", script)
    changed = marked.withColumn("c", F.coalesce(F.lag("script").over(order) != F.col("script"), F.lit(False)).cast("int")).withColumn("run", F.sum("c").over(order).cast("int"))
    return changed.groupBy(key, "run").agg(F.first("script").alias("script"), F.count(F.lit(1)).alias("n_chars"), F.min("pos").alias("start"))


def char_width(ch: Column, size: Column) -> Column:
    """Width of a character in a proportional face, by class: narrow, wide, capital, other."""
    em = F.when(ch.rlike("[ijl.,:;|!' ]"), 0.28).when(ch.rlike("[mwMW]"), 0.86).when(ch.rlike("[A-Z]"), 0.68).otherwise(0.54)
    return em * size


def text_widths(chars: DataFrame, key: str, size: float) -> DataFrame:
    """Width of every text: its characters' widths, 0.06 sizes less for each pair that is kerned (AV, To and their like)."""
    order = Window.partitionBy(key).orderBy("pos")
    pair = F.concat("ch", F.coalesce(F.lead("ch").over(order), F.lit("")))
    kern = F.when(pair.rlike("^(AV|VA|To|Te|Yo|LT)$"), 0.06 * size).otherwise(0.0)
    return chars.withColumn("w", char_width(F.col("ch"), F.lit(size)) - kern).groupBy(key).agg(F.sum("w").alias("width"))


#: Metrics of up to so many rows are sent to all tasks; larger ones are joined by shuffle.
MOST_METRICS = 200_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_METRICS + 1).count() <= MOST_METRICS else df


_COUNTS = [("ch", pa.string()), ("pair", pa.string()), ("n", pa.int64())]
#: In place of the character behind the last one; no character has this number.
_LAST = (1 << 21) - 1


@F.arrow_udf(from_arrow_type(pa.list_(pa.struct(_COUNTS))))
@sliced
def _glyph_counts(texts: pa.Array) -> pa.Array:
    """How often every character of a text is followed by every other one; the last one has no pair."""
    out = []
    for t in texts.to_pylist():
        code = np.frombuffer((t or "").encode("utf-32-le"), "<u4").astype(np.uint64)
        found, n = np.unique(code << np.uint64(21) | np.append(code[1:], np.uint64(_LAST)), return_counts=True) if len(code) else ((), np.array([], int))
        of = ((chr(int(k) >> 21), int(k) & _LAST) for k in found)
        out.append([(c, c + chr(after) if after != _LAST else None, m) for (c, after), m in zip(of, n.tolist(), strict=True)])
    return lists(out, _COUNTS)


def metric_widths(texts: DataFrame, key: list[str], text: str, face: str, size: str, widths: DataFrame, pairs: DataFrame, missing: int = 556) -> DataFrame:
    """(key, width, n_missing): texts measured by the glyphs of their faces and by the pairs that are set closer.

    ``widths`` (face, ch, width) and ``pairs`` (face, pair, kern) are in thousandths of ``size``.  A character that the
    face does not have counts in n_missing and takes ``missing``.  Rows that share a key count as one text each after the
    other; texts that are empty or null have no width and nothing missing.  Only a text's different pairs become rows, with
    their numbers.
    """
    known = texts.select(*key, F.col(face).alias("face"), F.col(size).cast("double").alias("size"), _glyph_counts(F.col(text)).alias("a"))
    rows = known.select(*key, "face", "size", F.explode_outer("a").alias("g")).select(*key, "face", "size", "g.*")
    of = rows.join(_small(widths), ["face", "ch"], "left").join(_small(pairs), ["face", "pair"], "left")
    width = F.when(F.col("ch").isNotNull(), (F.coalesce("width", F.lit(missing)) + F.coalesce("kern", F.lit(0))) * F.col("n")).otherwise(0) * F.col("size") / 1000
    return of.groupBy(*key).agg(F.sum(width).alias("width"), F.sum(F.when(F.col("ch").isNotNull() & F.col("width").isNull(), F.col("n")).otherwise(0)).alias("n_missing"))


def measured_line_ends(lines: DataFrame, key: str, most: float, width) -> DataFrame:
    """Adds hard, as line_ends does, by the widths of glyphs: whether the next line's first word and a space would have fitted."""
    order = Window.partitionBy(key).orderBy("line_no")
    own = lines.withColumns({"__own": measured("text", width), "__word": measured(F.regexp_extract("text", r"^\s*(\S*)", 1), width)})
    return own.withColumn("hard", F.coalesce(F.col("__own") + width(F.lit(" ")) + F.lead("__word").over(order) <= most, F.lit(True))).drop("__own", "__word")


def line_ends(lines: DataFrame, key: str, width: int) -> DataFrame:
    """Adds hard: a line ends hard if the next line's first word would have fitted behind it, and at the end."""
    order = Window.partitionBy(key).orderBy("line_no")
    first = F.lead(F.regexp_extract("text", r"^\s*(\S*)", 1)).over(order)
    return lines.withColumn("hard", F.coalesce(F.length("text") + 1 + F.length(first) <= width, F.lit(True)))


def archive_names(parts: DataFrame, base: str, key: str) -> DataFrame:
    """Names of the files of an archive, base_01_label.pdf: numbers padded to the number of parts."""
    n, total = F.row_number().over(Window.partitionBy(key).orderBy("part")), F.count(F.lit(1)).over(Window.partitionBy(key))
    number = F.lpad(n.cast("string"), F.length(total.cast("string")), "0")
    return parts.withColumn("file_name", F.concat(F.lit(base + "_"), number, F.lit("_"), "label", F.lit(".pdf")))


def shade(channel: Column, lum_mod: Column, lum_off: Column, tint: Column) -> Column:
    """A colour channel (0 to 1) after luminance factor and offset, then a tint towards white; kept within 0 and 1."""
    moved = F.least(F.greatest(channel * lum_mod + lum_off, F.lit(0.0)), F.lit(1.0))
    return moved * tint + (1 - tint)


def row_style(row: Column, col: Column, rows: Column, first_row: bool = True, last_row: bool = False, first_col: bool = False, banded: bool = True) -> Column:
    """The part of a table style that a cell takes: header, total, first column, or a band."""
    style = F.when(F.lit(banded) & (F.pmod(row - int(first_row), F.lit(2)) == 0), "band1").when(F.lit(banded), "band2").otherwise("whole")
    style = F.when(F.lit(first_col) & (col == 0), "first_column").otherwise(style)
    style = F.when(F.lit(last_row) & (row == rows - 1), "last_row").otherwise(style)
    return F.when(F.lit(first_row) & (row == 0), "first_row").otherwise(style)
