"""Text of a page as an editor sees it: chunks of glyphs, lines of chunks at any angle, blocks of lines.

Each step depends on what was accepted before it, so the sorted rows of a page, a physical unit of bounded size, are
gathered and folded, many pages in an Arrow batch and a few in Python at a time.  A fold keeps only what later rows can
still meet: the open chunk, the open line, or the blocks and lines within two sizes above.  Pages are dealt by their key
after each fold over glyphs or chunks; all grouping between is by the key first and needs no further shuffle.

Pages that have their glyphs as a list take all steps in Python at once (``pages_chunks``, ``pages_lines``,
``pages_blocks``), so that glyphs and chunks are neither rows nor shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import cache
from itertools import groupby, pairwise
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from quillspark.functions.slices import lists, sliced

#: Modes of glyphs that are not painted.
UNPAINTED = (3, 7)
LEAST_SIZE, MOST_SIZE = 0.5, 2000.0


def _offsets(pages: pa.Array) -> pa.Array:
    ends = pages.offsets.to_pylist()
    return pa.array([e - ends[0] for e in ends], pa.int32())


def _fold(pages: pa.Array, fold: Callable, kind: pa.DataType) -> pa.Array:
    """What ``fold()``, made anew for every page and called with each of its rows in order, gives."""
    out = []
    for page in pages.to_pylist():
        step = fold()
        out += [step(row) for row in page]
    return pa.ListArray.from_arrays(_offsets(pages), pa.array(out, kind))


def _rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(key, r): the rows of every key in order."""
    names = [*order, *(c for c in df.columns if c not in key and c not in order)]
    return df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("r"))


def turned(glyphs: DataFrame) -> DataFrame:
    """Painted glyphs (n: order, x, y, dx, dy, size, width, mode) with ``angle`` in whole degrees, place ``along`` it and ``across`` it."""
    painted = glyphs.where(~F.col("mode").isin(*UNPAINTED) & (F.col("size") > LEAST_SIZE) & (F.col("size") < MOST_SIZE))
    rows = painted.withColumn("angle", F.floor(F.degrees(F.atan2("dy", "dx")) + 0.5).cast("int"))
    c, s = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    return rows.withColumns({"along": F.col("x") * c + F.col("y") * s, "across": F.col("y") * c - F.col("x") * s})


@F.arrow_udf(ArrayType(LongType()))
@sliced
def _chunked(angles: pa.Array, alongs: pa.Array, acrosses: pa.Array, sizes: pa.Array, widths: pa.Array) -> pa.Array:
    offsets, out = _offsets(angles), []
    columns = [c.flatten().to_pylist() for c in (angles, alongs, acrosses, sizes, widths)]
    for lo, hi in pairwise(offsets.to_pylist()):
        n, angle, across, end, size = -1, None, 0.0, 0.0, 0.0
        for its_angle, along, its_across, its_size, width in zip(*(c[lo:hi] for c in columns), strict=True):
            if angle == its_angle:
                largest = size if size > its_size else its_size
                if abs(its_across - across) < 0.3 * largest and -0.6 * largest < along - end < largest:
                    end, size = max(end, along + width), largest
                    out.append(n)
                    continue
            n += 1
            angle, across, end, size = its_angle, its_across, along + width, its_size
            out.append(n)
    return pa.ListArray.from_arrays(offsets, pa.array(out, pa.int64()))


def glyph_chunks(glyphs: DataFrame, key: list[str]) -> DataFrame:
    """Turned glyphs with ``chunk``: one that follows on the same line, without a gap of a size, goes to the chunk before it."""
    rows = turned(glyphs)
    pages = _rows(rows, key, ["n"])
    numbered = pages.select(*key, F.col("r"), _chunked(*(F.col(f"r.{c}") for c in ("angle", "along", "across", "size", "width"))).alias("chunk"))
    # what comes from Python has lost its partitioning: whole pages are dealt once, before they are rows again
    return numbered.repartition(*key).select(*key, F.inline(F.arrays_zip("r", "chunk"))).select(*(c if c in key else f"r.{c}" for c in rows.columns), "chunk")


class _Bands:
    def __init__(self):
        self.n, self.angle = -1, None

    def __call__(self, c: dict) -> int:
        if self.angle != c["angle"] or abs(c["across"] - self.across) >= 0.35 * max(c["size"], self.size):
            self.n += 1
            self.angle, self.across, self.size = c["angle"], c["across"], c["size"]
        return self.n


class _Lines:
    def __init__(self):
        self.n, self.band = -1, None

    def __call__(self, c: dict) -> dict:
        if self.band == c["band"]:
            size = max(self.size, c["size"])
            if min(self.end, c["x1"]) > max(c["x0"], self.begin) and any(abs(x - c["x0"]) < 0.3 * size and t == c["text"] for x, t in self.own):
                return {"line": self.n, "repeated": True}
            if c["x0"] - self.end < size:
                self.own.append((c["x0"], c["text"]))
                self.end, self.size = max(self.end, c["x1"]), size
                return {"line": self.n, "repeated": False}
        self.n += 1
        self.band, self.begin, self.end, self.size, self.own = c["band"], c["x0"], c["x1"], c["size"], [(c["x0"], c["text"])]
        return {"line": self.n, "repeated": False}


@F.arrow_udf(ArrayType(LongType()))
@sliced
def _banded(pages: pa.Array) -> pa.Array:
    return _fold(pages, _Bands, pa.int64())


@F.arrow_udf(ArrayType(StructType([StructField("line", LongType()), StructField("repeated", BooleanType())])))
@sliced
def _lined(pages: pa.Array) -> pa.Array:
    return _fold(pages, _Lines, pa.struct([("line", pa.int64()), ("repeated", pa.bool_())]))


_CHUNK = ("chunk", "angle", "x0", "x1", "across", "size", "text")


def _fields(rows: str, names: tuple[str, ...]) -> Column:
    return F.transform(rows, lambda c: F.struct(*(c[n].alias(n) for n in names)))


def _lines_of(chunks: DataFrame, key: list[str]) -> DataFrame:
    """Chunks, all their columns, with band, line and repeated."""
    banded = _rows(chunks, key, ["angle", "across", "chunk"]).withColumn("b", _banded(_fields("r", ("angle", "across", "size"))))
    rest = [c for c in chunks.columns if c not in (*key, "x0", "across", "chunk")]
    ordered = F.transform(F.arrays_zip("r", "b"), lambda z: F.struct(z["b"].alias("band"), *(z["r"][c].alias(c) for c in ("x0", "across", "chunk", *rest))))
    lined = banded.select(*key, F.sort_array(ordered).alias("r")).withColumn("l", _lined(_fields("r", ("band", "x0", "x1", "size", "text"))))
    return lined.repartition(*key).select(*key, F.inline(F.arrays_zip("r", "l"))).select(*key, *(f"r.{c}" for c in chunks.columns if c not in key), "r.band", "l.line", "l.repeated")


def _chunks(chunked: DataFrame, key: list[str]) -> DataFrame:
    """Chunks (chunk, angle, x0, x1, across, size, text) with their glyphs in order."""
    glyph = F.struct("n", "text", "along", "width", "font", "bold")
    chunks = chunked.groupBy(*key, "chunk").agg(
        F.first("angle").alias("angle"), F.min("along").alias("x0"), F.max(F.col("along") + F.col("width")).alias("x1"), F.min_by("across", "n").alias("across"), F.max("size").alias("size"), F.sort_array(F.collect_list(glyph)).alias("glyphs"),
    )
    text = F.array_join(F.transform("glyphs", lambda g: F.coalesce(g["text"], F.lit(""))), "")
    return chunks.select(*key, *_CHUNK[:-1], text.alias("text"), "glyphs")


def chunk_lines(chunked: DataFrame, key: list[str]) -> DataFrame:
    """Chunks (chunk, angle, x0, x1, across, size, text) with ``line`` and ``repeated``: printed again over one like it."""
    return _lines_of(_chunks(chunked, key).drop("glyphs"), key)


def editor_lines(chunked: DataFrame, key: list[str]) -> DataFrame:
    """Lines (line, angle, x0, x1, across, size, bold, text) that have more than spaces, with spaces where glyphs leave a gap.

    Bold is as the most frequent font of the line, of equally frequent ones that which reached its number first.
    """
    of_line = Window.partitionBy(*key, "line")
    chunks = _lines_of(_chunks(chunked, key), key)
    unrepeated = lambda c: F.max(F.when(~F.col("repeated"), F.col(c)))
    chunks = chunks.select(*key, "line", "angle", "chunk", "repeated", F.col("x0").alias("at"), F.col("across").alias("at_across"), F.min("x0").over(of_line).alias("x0"), unrepeated("x1").over(of_line).alias("x1"), unrepeated("size").over(of_line).alias("size"), "glyphs")
    chunks = chunks.withColumn("g", F.explode("glyphs")).drop("glyphs")
    rows = chunks.select(*(c for c in chunks.columns if c != "g"), "g.*")
    order = of_line.orderBy("at", "at_across", "chunk", "n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    painted = ~F.col("repeated")
    space = lambda c: F.coalesce(c.rlike(r"^\s*$"), F.lit(False))
    rows = rows.withColumns({"place": F.row_number().over(order), "end": F.max(F.when(painted, F.col("along") + F.col("width"))).over(before), "last": F.last(F.when(painted, F.struct("text")), ignorenulls=True).over(before)})
    apart = F.coalesce((F.col("along") - F.col("end") > 0.17 * F.col("size")) & ~space(F.col("text")) & ~space(F.col("last.text")), F.lit(False))
    piece = F.concat(F.when(apart, " ").otherwise(""), F.coalesce("text", F.lit("�")))
    by_font = rows.withColumn("piece", piece).groupBy(*key, "line", "font").agg(
        *(F.first(c).alias(c) for c in ("angle", "x0", "x1", "size")), F.min_by("at_across", "place").alias("across"), F.min("place").alias("begin"), F.count(F.lit(1)).alias("times"), F.max("place").alias("reached"), F.min_by("bold", "place").alias("bold"),
        F.collect_list(F.when(painted, F.struct("place", "piece"))).alias("pieces"), F.bool_or(painted & ~space(F.col("text"))).alias("seen"),
    )
    lines = by_font.groupBy(*key, "line").agg(
        *(F.first(c).alias(c) for c in ("angle", "x0", "x1", "size")), F.min_by("across", "begin").alias("across"), F.max_by("bold", F.struct("times", -F.col("reached"))).alias("bold"), F.bool_or("seen").alias("seen"), F.sort_array(F.flatten(F.collect_list("pieces"))).alias("pieces"),
    )
    shown = F.trim(F.regexp_replace(F.array_join("pieces.piece", ""), r"\s+", " "))
    return lines.where("seen").select(*key, "line", "angle", "x0", "x1", "across", "size", "bold", shown.alias("text"))


class _Blocks:
    """The open blocks, each with its last line, and the lines after the first of these."""

    def __init__(self):
        self.n, self.at, self.open, self.recent = -1, -1, [], []

    def __call__(self, line: dict) -> int:
        self.at += 1
        down = lambda b: line["across"] - b["last"]["across"]
        self.open = [b for b in self.open if b["last"]["angle"] == line["angle"] and down(b) <= 2.0 * max(b["last"]["size"], line["size"])]
        since = min((b["at"] for b in self.open), default=self.at)
        self.recent = [(k, r) for k, r in self.recent if k > since]
        fitting = [b for b in reversed(self.open) if self._fits(b, line, down(b))]
        if fitting:
            block = min(fitting, key=down)  # of equally near ones the last that was opened
            block["spacing"] = down(block) if block["spacing"] is None else block["spacing"]
            block["x0"], block["x1"], block["lines"] = min(block["x0"], line["x0"]), max(block["x1"], line["x1"]), block["lines"] + 1
        else:
            self.n += 1
            block = {"n": self.n, "x0": line["x0"], "x1": line["x1"], "spacing": None, "lines": 1}
            self.open.append(block)
        block["last"], block["at"] = line, self.at
        self.recent.append((self.at, line))
        return block["n"]

    def _fits(self, block: dict, line: dict, down: float) -> bool:
        last = block["last"]
        size = max(last["size"], line["size"])
        if not 0.55 * size <= down <= 1.75 * size or not 0.83 <= line["size"] / last["size"] <= 1.2 or line["bold"] != last["bold"]:
            return False
        if block["spacing"] is not None and abs(down - block["spacing"]) > 0.25 * block["spacing"]:
            return False
        a, b, x0, x1 = block["x0"], block["x1"], line["x0"], line["x1"]
        if min(x1, b) <= max(x0, a):
            return False
        left = abs(x0 - a) < (3.0 if block["lines"] == 1 else 1.5) * size
        right, middle = abs(x1 - b) < 1.5 * size, abs((x0 + x1) / 2 - (a + b) / 2) < 1.5 * size
        if not (left or right or middle or (x0 >= a - size and x1 <= b + size)):
            return False
        return not any(
            k > block["at"] and last["across"] + 0.2 * size < o["across"] < line["across"] - 0.2 * size and min(o["x1"], x1) > max(o["x0"], x0) for k, o in self.recent
        )


@F.arrow_udf(ArrayType(LongType()))
@sliced
def _blocked(pages: pa.Array) -> pa.Array:
    return _fold(pages, _Blocks, pa.int64())


def editor_blocks(lines: DataFrame, key: list[str]) -> DataFrame:
    """Lines with ``block``: a line goes to the nearest open block above it that it fits by distance, size, weight, spacing and edges.

    A block is out of reach when a line between lies in the way, and closed two sizes below its last line.
    """
    pages = _rows(lines, key, ["angle", "across", "x0", "line"]).withColumn("block", _blocked(_fields("r", ("angle", "across", "x0", "x1", "size", "bold"))))
    return pages.select(*key, F.inline(F.arrays_zip("r", "block"))).select(*(c if c in key else f"r.{c}" for c in lines.columns), "block")


# -- pages with their glyphs as lists

#: The fields of a glyph, in the order that glyphs of one ``n`` go by.
GLYPH = ("n", "text", "x", "y", "dx", "dy", "size", "width", "mode", "font", "bold")
# A text that is white space as Java's ^\s*$ sees it, and its \s+.
_BLANK, _WHITE = re.compile("[ \t\n\x0b\f\r]*[\x85\u2028\u2029]?"), re.compile("[ \t\n\x0b\f\r]+")


@cache
def _turn(dx: float, dy: float) -> tuple[int, float, float]:
    angle = math.floor(math.degrees(math.atan2(dy, dx)) + 0.5)
    return angle, math.cos(math.radians(angle)), math.sin(math.radians(angle))


def _ordered(glyphs: list[tuple]) -> list[tuple]:
    """Glyphs by n, those of one n by their other fields; nothing comes before all else, as in Spark."""
    numbers = {g[0] for g in glyphs}
    if len(numbers) == len(glyphs) and None not in numbers:
        return sorted(glyphs, key=itemgetter(0))
    return sorted(glyphs, key=lambda g: [(False, 0) if v is None else (True, v) for v in g])


def _page_chunks(glyphs: list[tuple]) -> list[dict]:
    """The chunks of a page in order, each with its glyphs (n, text, along, width, font, bold)."""
    out, fold = [], None
    for n, text, x, y, dx, dy, size, width, mode, font, bold in _ordered(glyphs):
        if mode is None or mode in UNPAINTED or size is None or not LEAST_SIZE < size < MOST_SIZE:
            continue
        angle, c, s = _turn(dx, dy)
        along, across = x * c + y * s, y * c - x * s
        if fold is not None and fold["angle"] == angle:
            largest = max(fold["size"], size)
            if abs(across - fold["across"]) < 0.3 * largest and -0.6 * largest < along - fold["x1"] < largest:
                fold["x0"], fold["x1"], fold["size"] = min(fold["x0"], along), max(fold["x1"], along + width), largest
                fold["glyphs"].append((n, text, along, width, font, bold))
                continue
        fold = {"chunk": len(out), "angle": angle, "x0": along, "x1": along + width, "across": across, "size": size, "glyphs": [(n, text, along, width, font, bold)]}
        out.append(fold)
    for c in out:
        c["glyphs"] = _ordered(c["glyphs"])
        c["text"] = "".join([g[1] or "" for g in c["glyphs"]])
    return out


def _page_lined(glyphs: list[tuple]) -> list[dict]:
    """Chunks with band, line and repeated, by their lines."""
    chunks = sorted(_page_chunks(glyphs), key=lambda c: (c["angle"], c["across"], c["chunk"]))
    band = _Bands()
    for c in chunks:
        c["band"] = band(c)
    chunks.sort(key=lambda c: (c["band"], c["x0"], c["across"], c["chunk"]))
    line = _Lines()
    for c in chunks:
        c |= line(c)
    return chunks


def _page_lines(glyphs: list[tuple]) -> list[dict]:
    """editor_lines of a page."""
    out = []
    blank = lambda t: t is not None and _BLANK.fullmatch(t) is not None
    for n, own in groupby(_page_lined(glyphs), key=lambda c: c["line"]):
        own = sorted(own, key=lambda c: (c["x0"], c["across"], c["chunk"]))
        kept = [c for c in own if not c["repeated"]]
        size = max([c["size"] for c in kept])
        pieces, end, last, seen, place = [], None, False, False, 0
        fonts: dict[str | None, list] = {}
        for c in own:
            for _, text, along, width, font, bold in c["glyphs"]:
                place += 1
                of = fonts.setdefault(font, [0, 0, bold])
                of[0], of[1] = of[0] + 1, -place
                if not c["repeated"]:
                    void = blank(text)
                    pieces.append((" " if end is not None and along - end > 0.17 * size and not void and not last else "") + ("�" if text is None else text))
                    end, last, seen = along + width if end is None else max(end, along + width), void, seen or not void
        if seen:
            bold = max(fonts.values(), key=lambda f: f[:2])[2]
            text = _WHITE.sub(" ", "".join(pieces)).strip(" ")
            out.append({"line": n, "angle": own[0]["angle"], "x0": min([c["x0"] for c in own]), "x1": max([c["x1"] for c in kept]), "across": own[0]["across"], "size": size, "bold": bold, "text": text})
    return out


def _page_blocks(glyphs: list[tuple]) -> list[dict]:
    """editor_blocks of a page."""
    lines, block = sorted(_page_lines(glyphs), key=lambda r: (r["angle"], r["across"], r["x0"], r["line"])), _Blocks()
    return [r | {"block": block(r)} for r in lines]


_KINDS = {"angle": ("int", pa.int32()), "text": ("string", pa.string()), "bold": ("boolean", pa.bool_()), "repeated": ("boolean", pa.bool_())} | {c: ("long", pa.int64()) for c in ("chunk", "band", "line", "block")} | {c: ("double", pa.float64()) for c in ("x0", "x1", "across", "size")}


def _of_pages(pages: DataFrame, key: list[str], glyphs: Column, tell: Callable[[list[tuple]], list[dict]], names: tuple[str, ...]) -> DataFrame:
    @F.arrow_udf("array<struct<" + ", ".join(f"{n}: {_KINDS[n][0]}" for n in names) + ">>")
    @sliced
    def told(rows: pa.Array) -> pa.Array:
        ends, every = _offsets(rows).to_pylist(), list(zip(*map(_listed, rows.flatten().flatten()), strict=True))
        found = (tell(every[a:b]) for a, b in pairwise(ends))
        return lists([[tuple([r[n] for n in names]) for r in own] for own in found], [(n, _KINDS[n][1]) for n in names])

    kind = "array<struct<" + ",".join(f"{n}:{k}" for n, k in zip(GLYPH, ("bigint", "string", *["double"] * 6, "int", "string", "boolean"), strict=True)) + ">>"
    if pages.select(glyphs.alias("g")).dtypes[0][1] != kind:
        glyphs = F.transform(glyphs, lambda g: F.struct(*(g[n] for n in GLYPH))).cast(kind)
    return pages.select(*key, F.inline(told(F.coalesce(glyphs, F.array().cast(kind)))))


def _listed(column: pa.Array) -> list:
    """As to_pylist, several times faster for numbers."""
    plain = (pa.types.is_floating(column.type) or pa.types.is_integer(column.type)) and not column.null_count
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


_LINE = ("line", "angle", "x0", "x1", "across", "size", "bold", "text")


def pages_chunks(pages: DataFrame, key: list[str], glyphs: Column) -> DataFrame:
    """chunk_lines of pages that have their glyphs (GLYPH) as lists."""
    return _of_pages(pages, key, glyphs, _page_lined, (*_CHUNK, "band", "line", "repeated"))


def pages_lines(pages: DataFrame, key: list[str], glyphs: Column) -> DataFrame:
    """editor_lines of pages that have their glyphs as lists."""
    return _of_pages(pages, key, glyphs, _page_lines, _LINE)


def pages_blocks(pages: DataFrame, key: list[str], glyphs: Column) -> DataFrame:
    """editor_blocks of editor_lines of pages that have their glyphs as lists."""
    return _of_pages(pages, key, glyphs, _page_blocks, (*_LINE, "block"))
