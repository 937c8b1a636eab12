"""Operators on page sets: ranges, parts, order, rotation, boxes.

A page relation has doc_id, page_index (from 0), rotate and a box x0, y0, x1, y1; other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.geometry import MM

# Fixed value: the pattern of one item of a list of page ranges.
RANGE = r"(?i)^(\d*)\s*(?:(-|–|to)\s*(\d*))?$"


def parse_ranges(spec: Column, n_pages: Column) -> tuple[Column, Column]:
    """(ranges array<struct<from,to>>, error) of "1-3, 5; 8-, -4, 2 to 6"; pages count from 1.

    error is null, 'empty', 'not a range', 'outside' or 'backwards': the one of the first bad token.
    """
    tokens = F.filter(F.transform(F.split(spec, "[,;]", -1), lambda t: F.trim(t)), lambda t: t != "")

    def parsed(t: Column) -> Column:
        a, dash, b = (F.regexp_extract(t, RANGE, k) for k in (1, 2, 3))
        start = F.when(a != "", a.try_cast("int")).otherwise(1)
        end = F.when(dash == "", start).when(b != "", b.try_cast("int")).otherwise(n_pages)
        bad = ~t.rlike(RANGE) | ((a == "") & (b == ""))
        outside = start.isNull() | end.isNull() | (start < 1) | (end < 1) | (start > n_pages) | (end > n_pages)
        error = F.when(bad, "not a range").when(outside, "outside").when(start > end, "backwards")
        return F.struct(start.alias("from"), end.alias("to"), error.alias("error"))

    found = F.transform(tokens, parsed)
    first = F.get(F.filter(found, lambda r: r["error"].isNotNull()), F.lit(0))["error"]
    error = F.when(F.size(tokens) == 0, "empty").otherwise(first)
    return F.when(error.isNull(), F.transform(found, lambda r: F.struct(r["from"].alias("from"), r["to"].alias("to")))), error


def range_pages(ranges: Column) -> Column:
    """Page numbers of ranges in order, repeats kept."""
    return F.flatten(F.transform(ranges, lambda r: F.sequence(r["from"], r["to"])))


def parts(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """Pages of every part: specs has doc_id, part and spec; parts whose spec is in error are left out."""
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_pages"))
    joined = specs.join(counts, "doc_id")
    ranges, error = parse_ranges(F.col("spec"), F.col("n_pages"))
    good = joined.withColumns({"ranges": ranges, "error": error}).where("error is null")
    return good.select("doc_id", "part", F.posexplode(range_pages(F.col("ranges"))).alias("ord", "page"))


def part_labels(part_pages: DataFrame) -> DataFrame:
    """p3 or p1-3 by the first and the last page of the list, and the number of pages."""
    listed = part_pages.groupBy("doc_id", "part").agg(F.min_by("page", "ord").alias("a"), F.max_by("page", "ord").alias("b"), F.count(F.lit(1)).alias("n_pages"))
    label = F.concat(F.lit("p"), F.col("a"), F.when(F.col("n_pages") > 1, F.concat(F.lit("-"), F.col("b"))).otherwise(""))
    return listed.select("doc_id", "part", label.alias("label"), "n_pages")


def part_overlaps(part_pages: DataFrame) -> DataFrame:
    """Pages that more than one part uses, with the parts."""
    used = part_pages.groupBy("doc_id", "page").agg(F.sort_array(F.collect_set("part")).alias("parts"))
    return used.where(F.size("parts") > 1).select("doc_id", "page", F.array_join("parts", ",").alias("parts"))


def left_out(pages: DataFrame, part_pages: DataFrame) -> DataFrame:
    """Pages that no part uses."""
    all_pages = pages.select("doc_id", (F.col("page_index") + 1).alias("page"))
    return all_pages.join(part_pages.select("doc_id", "page"), ["doc_id", "page"], "left_anti")


def page_set_text(pages: DataFrame) -> DataFrame:
    """Compact text such as "1-3, 5" of every document's set of pages (doc_id, page)."""
    w = Window.partitionBy("doc_id").orderBy("page")
    islands = pages.select("doc_id", "page").distinct().withColumn("island", F.col("page") - F.row_number().over(w))
    spans = islands.groupBy("doc_id", "island").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat("a", F.lit("-"), "b"))
    listed = spans.select("doc_id", F.struct("a", text.alias("t")).alias("s")).groupBy("doc_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return listed.select("doc_id", F.array_join(F.col("s.t"), ", ").alias("pages"))


def every_n(pages: DataFrame, n: int) -> DataFrame:
    """Adds part: runs of n pages."""
    return pages.withColumn("part", F.floor(F.col("page_index") / n).cast("int"))


def next_part_start(part_pages: DataFrame) -> DataFrame:
    """For every part the page with which a part that is filled in after it starts, and that of the part before."""
    ends = part_pages.groupBy("doc_id", "part").agg(F.max("page").alias("last"))
    return ends.withColumn("start", F.coalesce(F.lag("last").over(Window.partitionBy("doc_id").orderBy("part")) + 1, F.lit(1)))


def unique_names(df: DataFrame, scope: str, name: str, order: str) -> Column:
    """The name with " (2)", " (3)" for later rows that have it in the same scope, whatever the case of letters."""
    n = F.row_number().over(Window.partitionBy(scope, F.lower(name)).orderBy(order))
    return F.when(n > 1, F.concat(F.col(name), F.lit(" ("), n, F.lit(")"))).otherwise(F.col(name))


def merge(files: list[DataFrame]) -> DataFrame:
    """All pages of two or more page relations, one after the other, numbered anew by document."""
    if len(files) < 2:
        raise ValueError("Merging needs two files at least.")
    stacked = files[0].withColumn("file_no", F.lit(0))
    for k, f in enumerate(files[1:], 1):
        stacked = stacked.unionByName(f.withColumn("file_no", F.lit(k)))
    w = Window.partitionBy("doc_id").orderBy("file_no", "page_index")
    return stacked.withColumn("merged_index", F.row_number().over(w) - 1)


def organize(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """Pages in the order of specs (doc_id, ord, index, turn): repeats, omissions, blanks (null index), turns.

    Indexes outside the document go.  A blank page has the size of the next real page, else of the one before it, else
    A4.  A document of which nothing but blanks is left gives no rows.
    """
    size = F.struct((F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    have = pages.select("doc_id", F.col("page_index").alias("index"), "rotate", size.alias("size"))
    kept = specs.join(have, ["doc_id", "index"], "left").where("index is null or size is not null")
    ahead = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    behind = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("doc_id")
    a4 = F.struct(F.lit(595.28).alias("w"), F.lit(841.89).alias("h"))
    sized = kept.withColumns({
        "own": F.coalesce("size", F.first("size", True).over(ahead), F.last("size", True).over(behind), a4),
        "real": F.count("index").over(whole), "position": F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1,
    })
    turned = F.pmod(F.coalesce("rotate", F.lit(0)) + F.col("turn"), F.lit(360))
    return sized.where("real > 0").select("doc_id", "position", "index", turned.alias("rotate"), F.col("own.w").alias("w"), F.col("own.h").alias("h"))


def rotate(pages: DataFrame, turns: DataFrame, everywhere: int = 0) -> DataFrame:
    """Adds the turn of all pages and the one of (doc_id, page_index) in turns to the rotation, modulo 360."""
    joined = pages.join(turns.select("doc_id", "page_index", "turn"), ["doc_id", "page_index"], "left")
    return joined.withColumn("rotate", F.pmod(F.col("rotate") + everywhere + F.coalesce("turn", F.lit(0)), F.lit(360))).drop("turn")


def visible_box(media: tuple[Column, ...], crop: tuple[Column, ...]) -> Column:
    """Crop box within media box; the media box where less than a point is left."""
    x0, y0 = F.greatest(media[0], crop[0]), F.greatest(media[1], crop[1])
    x1, y1 = F.least(media[2], crop[2]), F.least(media[3], crop[3])
    small = (x1 - x0 < 1) | (y1 - y0 < 1)
    pick = lambda m, c: F.when(small, m).otherwise(c)
    return F.struct(*(pick(m, c).alias(n) for m, c, n in zip(media, (x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)))


def crop(pages: DataFrame, top: float, right: float, bottom: float, left: float) -> DataFrame:
    """Takes margins in millimetres, as seen on the turned page, off every box; a point is left at least."""
    t, r, b, l = (max(0.0, m) * MM for m in (top, right, bottom, left))  # noqa: E741
    sides = {0: (l, t, r, b), 90: (t, r, b, l), 180: (r, b, l, t), 270: (b, l, t, r)}
    side = lambda k: F.when(F.col("rotate") == 90, sides[90][k]).when(F.col("rotate") == 180, sides[180][k]).when(F.col("rotate") == 270, sides[270][k]).otherwise(sides[0][k])
    w = F.greatest(F.col("x1") - F.col("x0") - side(0) - side(2), F.lit(1.0))
    h = F.greatest(F.col("y1") - F.col("y0") - side(1) - side(3), F.lit(1.0))
    x, y = F.col("x0") + side(0), F.col("y0") + side(3)
    return pages.withColumns({"x0": x, "y0": y, "x1": x + w, "y1": y + h})


def place_images(images: DataFrame, margin: float = 18.0) -> DataFrame:
    """Images (w, h) on A4 pages, landscape where wider than high: scaled down to fit, never up, and centred."""
    wide = F.col("w") > F.col("h")
    pw, ph = F.when(wide, 841.89).otherwise(595.28), F.when(wide, 595.28).otherwise(841.89)
    scale = F.least(F.lit(1.0), (pw - 2 * margin) / F.col("w"), (ph - 2 * margin) / F.col("h"))
    dw, dh = F.col("w") * scale, F.col("h") * scale
    return images.withColumns({"page_w": pw, "page_h": ph, "draw_w": dw, "draw_h": dh, "x": (pw - dw) / 2, "y": (ph - dh) / 2})


#: Sizes of pages, upright.
PAGE_SIZES = {"a4": (595.28, 841.89), "letter": (612.0, 792.0)}


def place_images_by(images: DataFrame, size: Column, orientation: Column, margin: Column) -> DataFrame:
    """Images (w, h) on pages: a4, letter or fit; upright, landscape or auto (landscape where wider than high); a margin in points.

    Images are scaled down to the page, never up, and centred.  A page that fits is the image, at most as long as A4 is
    high, and its margins.  Images without an area, and sizes that are not known, give nulls.
    """
    ok = (F.col("w") > 0) & (F.col("h") > 0)
    lie = (orientation == "landscape") | ((orientation == "auto") & (F.col("w") > F.col("h")))
    side = lambda k: F.coalesce(*(F.when(size == name, box[k]) for name, box in PAGE_SIZES.items()))
    shrink = F.least(F.lit(1.0), PAGE_SIZES["a4"][1] / F.greatest("w", "h"))
    own = lambda c, k: F.when(ok, F.when(size == "fit", F.col(c) * shrink + 2 * margin).when(lie, side(1 - k)).otherwise(side(k)))
    sized = images.withColumns({"page_w": own("w", 0), "page_h": own("h", 1)})
    scale = F.least((F.col("page_w") - 2 * margin) / F.col("w"), (F.col("page_h") - 2 * margin) / F.col("h"))
    scale = F.when(size == "fit", scale).otherwise(F.least(scale, F.lit(1.0)))
    known = ok & F.col("page_w").isNotNull()
    drawn = sized.withColumns({"draw_w": F.when(known, F.col("w") * scale), "draw_h": F.when(known, F.col("h") * scale)})
    return drawn.withColumns({"x": (F.col("page_w") - F.col("draw_w")) / 2, "y": (F.col("page_h") - F.col("draw_h")) / 2})


def page_slice(pages: DataFrame, start: Column, count: Column) -> DataFrame:
    """Width, height and rotation of ``count`` pages from ``start`` on, as many as there are."""
    first = F.greatest(start, F.lit(0))
    kept = pages.where((F.col("page_index") >= first) & (F.col("page_index") < first + count))
    return kept.select("doc_id", "page_index", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), "rotate")
