"""Operators that place things on pages: page numbers, watermarks, signatures; wrapping and paging of text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from quillspark.functions.geometry import MM, anchor, mirrored, roman, turned_box


def page_numbers(pages: DataFrame, start_page: int = 1, end_page: int = 0, starting: int = 1, template: str = "{n}", position: str = "bottom-center", mirror: bool = False, size: float = 12.0, margin_mm: float = 10.0) -> DataFrame:
    """Label and place of the number on every page from start_page to end_page (0: the last)."""
    total = F.max("page_index").over(Window.partitionBy("doc_id")) + 1
    first = max(start_page, 1) - 1
    last = F.least(F.lit(end_page) if end_page > 0 else total, total) - 1
    ranged = pages.withColumns({"total": total, "last": last}).where((F.col("page_index") >= first) & (F.col("page_index") <= F.col("last")))
    offset = F.col("page_index") - first
    n, of = offset + starting, F.col("last") - first + 1 + starting - 1
    label: Column = F.lit(template)
    for mark, value in (("{n}", n.cast("string")), ("{total}", of.cast("string")), ("{roman}", roman(n))):
        label = F.replace(label, F.lit(mark), value)
    place = F.when(offset % 2 == 1, mirrored(F.lit(position))).otherwise(F.lit(position)) if mirror else F.lit(position)
    labelled = ranged.withColumns({"label": label, "position": place})
    width = F.length("label") * size * 0.5
    x, y = anchor(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), width, F.lit(size), F.col("position"), F.lit(margin_mm * MM))
    return labelled.withColumns({"x": x, "y": y}).drop("total", "last")


def tiles(pages: DataFrame, w: float, h: float, degrees: float) -> DataFrame:
    """Origins of a watermark that covers pages: a lattice of turned boxes, odd rows shifted by half a step.

    Gaps are 0.4 box widths (40 at least) and 0.8 box heights (60 at least); the lattice starts a step outside the page.
    """
    bw, bh = turned_box(F.lit(w), F.lit(h), F.lit(degrees))
    step_x, step_y = bw + F.greatest(F.lit(40.0), bw * 0.4), bh + F.greatest(F.lit(60.0), bh * 0.8)
    grid = pages.withColumns({"sx": step_x, "sy": step_y, "pw": F.col("x1") - F.col("x0"), "ph": F.col("y1") - F.col("y0")})
    rows = grid.withColumn("r", F.explode(F.sequence(F.lit(-1), F.ceil(F.col("ph") / F.col("sy")).cast("int"))))
    cells = rows.withColumn("c", F.explode(F.sequence(F.lit(-1), F.ceil(F.col("pw") / F.col("sx")).cast("int"))))
    x = F.col("c") * F.col("sx") + F.when(F.pmod("r", F.lit(2)) == 1, F.col("sx") / 2).otherwise(0.0)
    return cells.select("doc_id", "page_index", "r", "c", x.alias("x"), (F.col("r") * F.col("sy")).alias("y"))


def signatures(pages: DataFrame, placements: DataFrame) -> DataFrame:
    """Placements (doc_id, page_index, x, y, w, h; origin at the top left) that lie on pages that exist, from the bottom."""
    joined = placements.join(pages.select("doc_id", "page_index", "y0", "y1"), ["doc_id", "page_index"])
    return joined.withColumn("y", F.col("y1") - F.col("y0") - F.col("y") - F.col("h")).drop("y0", "y1")


_LINES = ArrayType(StructType([StructField("line", IntegerType()), StructField("text", StringType()), StructField("n_words", IntegerType())]))


def wrapped(paragraphs: DataFrame, key: list[str], words: str, width: int) -> DataFrame:
    """(key, line, text, n_words): an array of words put on lines of ``width`` characters as long as they fit; a long word has its own.

    The place of a word depends on those before it, so the words of a paragraph are walked once, many paragraphs in an
    Arrow batch.
    """

    @F.arrow_udf(_LINES)
    def fill(paragraphs: pa.Array) -> pa.Array:
        out = []
        for own in paragraphs.to_pylist():
            lines: list[list[str]] = []
            used = 0
            for w in own:
                if lines and used + 1 + len(w) <= width:
                    lines[-1].append(w)
                    used += 1 + len(w)
                else:
                    lines.append([w])
                    used = len(w)
            out.append([{"line": k, "text": " ".join(x), "n_words": len(x)} for k, x in enumerate(lines)])
        return pa.array(out, pa.list_(pa.struct([("line", pa.int32()), ("text", pa.string()), ("n_words", pa.int32())])))

    return paragraphs.select(*key, F.inline(fill(F.coalesce(F.col(words), F.array().cast("array<string>")))))


def paged(blocks: DataFrame, key: list[str], order: str, height: float) -> DataFrame:
    """Adds page: blocks (height h) go to the next page when they do not fit the rest of the present one."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def deal(heights: pa.Array) -> pa.Array:
        out = []
        for own in heights.to_pylist():
            page, used, pages = 0, 0.0, []
            for h in own:
                full = used > 0 and used + h > height
                page, used = (page + 1, h) if full else (page, used + h)
                pages.append(page)
            out.append(pages)
        return pa.array(out, pa.list_(pa.int32()))

    rows = blocks.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(order, "h"))).alias("b"))
    return rows.select(*key, F.inline(F.arrays_zip(F.col("b"), deal(F.col("b.h")).alias("page")))).select(*key, "page", "b.*")


def clipped(items: DataFrame, page_height: float) -> DataFrame:
    """Items (top, h) on all pages that they touch, with their place there; an interval join by generated page numbers."""
    first, last = F.floor(F.col("top") / page_height).cast("int"), F.floor((F.col("top") + F.greatest(F.col("h") - 1e-9, F.lit(0.0))) / page_height).cast("int")
    spread = items.withColumn("page", F.explode(F.sequence(first, F.greatest(first, last))))
    return spread.withColumn("page_top", F.col("top") - F.col("page") * page_height)


MOST_PAGES = 2000


def page_breaks(texts: list[tuple[float, float]], forced: list[float], bottom: float, height: float, most: int = MOST_PAGES) -> list[float]:
    """Where pages of a long column begin and the last one ends: at forced breaks, else a page further, moved above lines of text.

    A break is moved up while a line (top, bottom) crosses it, unless less than 0.3 of a page would be left.
    """
    ends, out, start = sorted({b for b in (float(half) for half in (int(f + 0.5) for f in forced)) if b > 1}), [0.0], 0.0
    while len(out) <= most and (start + height < bottom or any(f > start + 1 for f in ends)):
        target = start + height
        ahead = next((f for f in ends if f > start + 1), None)
        if ahead is not None and ahead <= target:
            target = ahead
        else:
            y = target
            while (crossing := next((t for t, b in texts if t < y - 0.5 and b > y + 0.5), None)) is not None:
                y = crossing - 0.5
            target = y if y > start + 0.3 * height else target
        out.append(target)
        start = target
    return [*out, max(bottom, start + 1)]


def paginated(columns: DataFrame, key: list[str], height: float) -> DataFrame:
    """(key, page, top, bottom) of long columns: texts array<struct<top, bottom>>, forced array<double>, bottom."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def cut(texts: pa.Array, forced: pa.Array, bottom: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), forced.to_pylist(), bottom.to_pylist(), strict=True)
        return pa.array([page_breaks([(s["top"], s["bottom"]) for s in t or []], f or [], b, height) for t, f, b in rows], pa.list_(pa.float64()))

    pages = columns.select(*key, cut("texts", "forced", "bottom").alias("at")).select(*key, "at", F.posexplode(F.slice("at", F.lit(1), F.size("at") - 1)).alias("page", "top"))
    return pages.select(*key, "page", "top", F.get("at", F.col("page") + 1).alias("bottom"))


def drawing_order(items: DataFrame, key: list[str], kind: str, order: str) -> DataFrame:
    """Adds place: rectangles are drawn first, then pictures, lines and texts, each in the given order."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("rect", "image", "line", "text"))), F.col(kind)), F.lit(0))
    return items.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(rank, order)) - 1)
