"""Operators on sheets: dense rows, used columns, widths, bands and pages; charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_CELLS = 40_000_000
TOO_LARGE = "too many cells"


def dense_rows(cells: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a sheet from its cells (key, row, col, text): gaps as '', rows without any value left out.

    A sheet whose rows and columns span more than MOST_CELLS cells is refused: it gives one row that has an error only.
    """
    size = cells.groupBy(*key).agg((F.max("col") + 1).alias("cols"), (F.max("row") + 1).alias("rows"))
    size = size.withColumn("error", F.when(F.col("rows").cast("long") * F.col("cols") > MOST_CELLS, TOO_LARGE))
    refused = size.where("error is not null").select(*key, F.lit(None).cast("long").alias("row"), F.lit(None).cast("array<string>").alias("cells"), "error")
    size = size.where("error is null").drop("rows")
    by_row = cells.where("text <> ''").groupBy(*key, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda c: F.coalesce(F.element_at("m", c), F.lit("")))
    return by_row.join(size, key).select(*key, F.col("row").cast("long").alias("row"), filled.alias("cells"), "error").unionByName(refused)


def used_columns(cells: DataFrame, key: list[str]) -> DataFrame:
    """One more than the largest column with text that is not blank."""
    return cells.where(F.trim("text") != "").groupBy(*key).agg((F.max("col") + 1).alias("used"))


def column_widths(cells: DataFrame, key: list[str], char: float = 4.5, pad: float = 4.0, cap: float = 220.0, rows: int = 500) -> DataFrame:
    """Widths at 9 points from the first rows: text and padding, 24 at least, ``cap`` at most."""
    width = F.least(F.greatest(F.max(F.length("text")) * char + 2 * pad, F.lit(24.0)), F.lit(cap))
    return cells.where(F.col("row") < rows).groupBy(*key, "col").agg(width.alias("width"))


def fitted(widths: DataFrame, key: list[str], available: float) -> DataFrame:
    """Adds font_size (9, smaller where the columns are wider than the page, 6 at least) and scales the widths."""
    total = F.sum("width").over(Window.partitionBy(*key))
    size = F.when(total > available, F.greatest(F.lit(6.0), 9.0 * available / total)).otherwise(9.0)
    return widths.withColumn("font_size", size).withColumn("width", F.col("width") * F.col("font_size") / 9.0)


def column_bands(widths: DataFrame, key: list[str], available: float) -> DataFrame:
    """Adds band: columns filled greedily into bands of the available width.  A fold over the columns of a sheet."""
    rows = widths.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("col", "width"))).alias("c"))
    start = F.struct(F.lit(0).alias("band"), F.lit(0.0).alias("used"), F.array().cast("array<int>").alias("bands"))

    def step(s: Column, c: Column) -> Column:
        full = (F.size(s["bands"]) > 0) & (s["used"] > 0) & (s["used"] + c["width"] > available)
        band = F.when(full, s["band"] + 1).otherwise(s["band"])
        return F.struct(band.alias("band"), F.when(full, c["width"]).otherwise(s["used"] + c["width"]).alias("used"), F.concat(s["bands"], F.array(band)).alias("bands"))

    folded = rows.withColumn("bands", F.aggregate("c", start, step)["bands"])
    return folded.select(*key, F.inline(F.arrays_zip(F.col("c.col").alias("col"), F.col("bands").alias("band"))))


def row_pages(rows: DataFrame, key: list[str], order: str, per_page: int) -> DataFrame:
    """Adds page and place: the first row is the header of every page, ``per_page - 1`` rows of the body follow it."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1
    numbered = rows.withColumn("n", n)
    body = numbered.where("n > 0").withColumns({"page": F.floor((F.col("n") - 1) / (per_page - 1)), "place": F.pmod(F.col("n") - 1, F.lit(per_page - 1)) + 1})
    pages = numbered.groupBy(*key).agg(F.greatest(F.ceil((F.count(F.lit(1)) - 1) / (per_page - 1)), F.lit(1)).alias("pages"))
    header = numbered.where("n = 0").join(pages, key).withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1))).withColumn("place", F.lit(0)).drop("pages")
    return body.unionByName(header).drop("n")


def row_heights(cells: DataFrame, key: list[str], line: float, least: float = 24.0) -> DataFrame:
    """Height of every row: that of its tallest cell by lines."""
    return cells.groupBy(*key, "row").agg(F.greatest(F.max(F.col("lines") * line), F.lit(least)).alias("height"))


def nice_axis(low: Column, high: Column) -> tuple[Column, Column, Column]:
    """(from, to, step) of an axis: from 0 unless the data are negative, a step of 1, 2, 5 or 10 times a power of ten."""
    start = F.when(low < 0, low).otherwise(0.0)
    top = F.greatest(high, start + 1e-9)
    raw = F.greatest(top - start, F.lit(1e-9)) / 10
    size = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    n = raw / size
    step = size * F.when(n <= 1, 1.0).when(n <= 2, 2.0).when(n <= 5, 5.0).otherwise(10.0)
    begin = F.floor(start / step) * step
    return begin, F.greatest(F.ceil(top / step) * step, begin + step), step


def stacked(series: DataFrame, category: str, name: str, value: str) -> DataFrame:
    """Adds base and top of every bar on those of the series before it, and its share of the category."""
    order = Window.partitionBy(category).orderBy(name)
    top = F.sum(value).over(order)
    total = F.sum(value).over(Window.partitionBy(category))
    return series.withColumns({"base": top - F.col(value), "top": top, "share": F.when(total != 0, F.col(value) / total)})
