"""Tables and text blocks of a page, found from its segments.

Both are greedy: what a line or a segment joins depends on what was joined before, so the segments of a page are
gathered and many pages are worked on in one Arrow batch.  Segments are (line, x0, x1, y, size, text).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.runs import paged
from quillspark.functions.slices import lists, records, sliced
from quillspark.functions.text import BULLET, escape_markdown
from quillspark.operators.layout import bodies, classified, classified_documents, page_segments
from quillspark.operators.order import reading_order
from quillspark.sources.shared import written

# Fixed value: the characters of cells that hold numbers only.
_NUMERIC = re.compile(r"[\s$€£¥₹%()+\-.,0-9]+")
_BULLET = re.compile(BULLET)
Spans = list[tuple[float, float]]
_start, _end = itemgetter(0), itemgetter(1)


def _united(spans: Spans) -> Spans:
    out: list[list[float]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _column_of(seg: dict, columns: Spans, tolerance: float) -> int:
    """The first column that a segment overlaps or shares an edge with; -1 without.

    Columns are sorted and apart, so that only those within two tolerances of the segment are tried.
    """
    x0, x1, n = seg["x0"], seg["x1"], len(columns)
    k = bisect_right(columns, x0 - 2 * tolerance, key=_end)
    while k < n and columns[k][0] - x1 < 2 * tolerance:
        a, b = columns[k]
        if min(x1, b) > max(x0, a) or abs(x0 - a) < tolerance or abs(x1 - b) < tolerance:
            return k
        k += 1
    return -1


def _best_column(x0: float, x1: float, columns: Spans) -> int:
    """The column that a cell overlaps most, else the nearest by centre; the first of equals."""
    lo, hi = bisect_right(columns, x0, key=_end), bisect_left(columns, x1, key=_start)
    overlap = [(min(x1, b) - max(x0, a), -k) for k, (a, b) in enumerate(columns[lo:hi], lo)]
    if overlap and max(overlap)[0] > 0:
        return -max(overlap)[1]
    beyond = lambda c: -(x0 + x1 - c[0] - c[1]) / 2
    k = bisect_left(columns, 0.0, key=beyond)
    near = bisect_left(columns, beyond(columns[k - 1]), key=beyond) if k else k
    return near if k == len(columns) or (k and -beyond(columns[near]) <= beyond(columns[k])) else k


def _is_table(rows: list[list[dict]], columns: Spans, strict: bool) -> bool:
    texts = [s["text"] for r in rows for s in r]
    words = sum(len(t.split(" ")) for t in texts) / max(1, len(texts))
    if strict:
        return len(rows) >= 3 and len(columns) >= 3 and words <= 3
    two_texts = len(columns) == 2 and words > 3 and not any(_NUMERIC.fullmatch(t) for t in texts)
    return len(rows) >= 2 and words <= 6 and not two_texts


def detect_tables(segments: list[dict], strict: bool = False) -> list[tuple[list[list[dict]], Spans]]:
    """(rows, columns) of the tables of a page: lines of two cells and more, at most three sizes apart, whose cells keep to the columns.

    ``strict`` is for finely cut lines: three cells, three columns and three rows at least.
    """
    ordered = sorted(segments, key=lambda s: (s["line"], s["x0"]))
    lines = [list(g) for _, g in groupby(ordered, key=lambda s: s["line"])]
    least, found, at = (3 if strict else 2), [], 0
    while at < len(lines):
        rows, columns = [lines[at]], _united([(s["x0"], s["x1"]) for s in lines[at]])
        for own in lines[at + 1 :] if len(lines[at]) >= least else []:
            size = own[0]["size"]
            far = own[0]["y"] - rows[-1][0]["y"] > 3 * max(size, rows[0][0]["size"])
            met = {_column_of(s, columns, 0.8 * size) for s in own} - {-1}
            if far or len(own) < least or len(met) < min(least, len(own)):
                break
            rows.append(own)
            columns = _united([*columns, *((s["x0"], s["x1"]) for s in own)])
        if len(rows[0]) >= least and _is_table(rows, columns, strict):
            found.append((rows, columns))
            at += len(rows)
        else:
            at += 1
    return found


def text_blocks(segments: list[dict]) -> list[list[dict]]:
    """Segments joined into blocks: each goes to the block whose last segment is least far above it.

    The distance is between 0.5 and 1.8 sizes, sizes differ by 18 % at most, and the narrower of both overlaps the
    other by 30 %.  Bullets join lists only; other lines join a list only if they are indented.
    """
    blocks: list[list[dict]] = []
    spans: list[tuple[float, float]] = []
    listed: list[bool] = []
    open_: list[int] = []  # blocks that segments further down can still reach
    largest = max((s["size"] for s in segments), default=0.0)
    for s in sorted(segments, key=lambda s: (s["y"], s["x0"])):
        bullet = bool(_BULLET.match(s["text"]))
        open_ = [k for k in open_ if s["y"] - blocks[k][-1]["y"] <= 1.8 * largest]

        def distance(k: int, s: dict = s, bullet: bool = bullet) -> float | None:
            last, head = blocks[k][-1], blocks[k][0]
            size, down = max(s["size"], last["size"]), s["y"] - last["y"]
            if not 0.5 * size <= down <= 1.8 * size or abs(s["size"] - last["size"]) > 0.18 * size:
                return None
            a, b = spans[k]
            under = min(s["x1"], b) - max(s["x0"], a) >= 0.3 * min(s["x1"] - s["x0"], b - a)
            fits = listed[k] if bullet else not listed[k] or s["x0"] >= head["x0"] + 0.5 * s["size"]
            return down if under and fits else None

        candidates = [(d, k) for k in open_ if (d := distance(k)) is not None]
        if candidates:
            k = min(candidates)[1]
            blocks[k].append(s)
            spans[k] = min(spans[k][0], s["x0"]), max(spans[k][1], s["x1"])
        else:
            open_.append(len(blocks))
            blocks.append([s])
            spans.append((s["x0"], s["x1"]))
            listed.append(bullet)
    return blocks


Block = tuple[int, int, str, float, bool, float, float, float, float]


def block_rows(segments: list[dict]) -> list[Block]:
    """The blocks of a page: block, n_segments, text, size, bold, x0, y0, x1, y1."""
    rows = []
    for k, b in enumerate(text_blocks(segments)):
        text = re.sub(r"([A-Za-z])-\n([a-z])", r"\1\2", "\n".join([s["text"] for s in b])).replace("\n", " ")
        size, bold = sorted([s["size"] for s in b])[len(b) // 2], all([s.get("bold") for s in b])
        rows.append((k, len(b), text, size, bold, min([s["x0"] for s in b]), b[0]["y"] - b[0]["size"], max([s["x1"] for s in b]), b[-1]["y"] + b[-1]["size"] * 0.25))
    return rows


Cell = tuple[int, int, int, int, str, float, float, float, float]


def table_cells(segments: list[dict], strict: bool) -> list[list[Cell]]:
    """The cells of every table of a page: table, row, line, column, text, x0, x1, y, size."""
    out = []
    for t, (rows, columns) in enumerate(detect_tables(segments, strict)):
        cells: dict[tuple[int, int, int], list[dict]] = {}
        for r, row in enumerate(rows):
            for s in row:
                cells.setdefault((r, s["line"], _best_column(s["x0"], s["x1"], columns)), []).append(s)
        out.append([(t, *place, " ".join([s["text"] for s in x]), min([s["x0"] for s in x]), max([s["x1"] for s in x]), x[0]["y"], x[0]["size"]) for place, x in sorted(cells.items())])
    return out


_SEGMENT = ("line", "x0", "x1", "y", "size", "text")


def _pages(segments: DataFrame, key: list[str]) -> DataFrame:
    return segments.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*_SEGMENT))).alias("s"))


def _cells(segments: Column, strict: bool) -> Column:
    @F.arrow_udf("array<struct<table: int, row: int, line: int, column: int, text: string, x0: double, x1: double, y: double, size: double>>")
    @sliced
    def find(pages: pa.Array) -> pa.Array:
        numbers, reals = ((c, pa.int32()) for c in ("table", "row", "line", "column")), ((c, pa.float64()) for c in ("x0", "x1", "y", "size"))
        return lists([[c for t in table_cells(own, strict) for c in t] for own in records(pages)], [*numbers, ("text", pa.string()), *reals])

    return F.inline(find(segments))


def tables_of(pages: DataFrame, key: list[str], segments: Column, strict: bool = False) -> DataFrame:
    """page_tables of pages that have their segments as lists, sorted by line and place."""
    return pages.select(*key, _cells(segments, strict))


def page_tables(segments: DataFrame, key: list[str], strict: bool = False) -> DataFrame:
    """(key, table, row, line, column, text): cells of all tables; cells of a column and row are joined by spaces."""
    return _pages(segments, key).select(*key, _cells(F.col("s"), strict))


def blocks_of(pages: DataFrame, key: list[str], segments: Column, bold: bool = True) -> DataFrame:
    """(key, block, n_segments, text, size, bold, x0, y0, x1, y1): text joined with hyphens at line ends undone; without ``bold`` no block is."""

    @F.arrow_udf("array<struct<block: int, n_segments: int, text: string, size: double, bold: boolean, x0: double, y0: double, x1: double, y1: double>>")
    @sliced
    def find(pages: pa.Array) -> pa.Array:
        kinds = [("block", pa.int32()), ("n_segments", pa.int32()), ("text", pa.string()), ("size", pa.float64()), ("bold", pa.bool_()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1"))]
        return lists([block_rows(own) if bold else [(*b[:4], False, *b[5:]) for b in block_rows(own)] for own in records(pages)], kinds)

    return pages.select(*key, F.inline(find(segments)))


Item = tuple[int, int | None, str | None, float | None, bool | None, list[list[str]] | None]
_ITEM = [("place", pa.int32()), ("n_segments", pa.int32()), ("text", pa.string()), ("size", pa.float64()), ("bold", pa.bool_()), ("rows", pa.list_(pa.list_(pa.string())))]


def _table_item(cells: list[Cell]) -> tuple[tuple[float, float, float, float], list[list[str]]]:
    """The box of a table and its rows, empty cells included."""
    wide, rows = 1 + max(c[3] for c in cells), [list(g) for _, g in groupby(cells, key=lambda c: c[1])]
    tops, sizes = [min(c[7] for c in r) for r in rows], [max(c[8] for c in r) for r in rows]
    texts = [{c[3]: c[4] for c in r} for r in rows]
    box = min(c[5] for c in cells), min(y - z for y, z in zip(tops, sizes, strict=True)), max(c[6] for c in cells), max(tops) + 2
    return box, [[t.get(k, "") for k in range(wide)] for t in texts]


def layout_items(segments: list[dict], fine: list[dict], unit: float) -> list[Item]:
    """Tables and blocks of a page in reading order.

    Tables of wide gaps come first, then those of the lines left over that are set tightly, found in finely cut segments.
    Lines that tables use take no part in blocks.
    """
    tables = table_cells(segments, False)
    used = {c[2] for t in tables for c in t}
    tables += table_cells([s for s in fine if s["line"] not in used], True)
    used = {c[2] for t in tables for c in t}
    items = [(box, (None, None, None, None, rows)) for box, rows in map(_table_item, tables)]
    items += [(b[5:], (*b[1:5], None)) for b in block_rows([s for s in segments if s["line"] not in used]) if b[2] != ""]
    order = reading_order([(*box, k) for k, (box, _) in enumerate(items)], unit)
    return [(place, *items[k][1]) for place, k in enumerate(order)]


def rows_markdown(rows: Column) -> Column:
    """A table, rows of as many texts, as Markdown with bars, the first row as head."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    head, rule = F.get(rows, F.lit(0)), F.transform(F.get(rows, F.lit(0)), lambda c: F.lit("---"))
    told = lambda r: line(F.transform(r, escape_markdown))
    return F.array_join(F.concat(F.array(told(head), line(rule)), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), told)), "\n")


def page_layout(segments: DataFrame, fine: DataFrame, body: DataFrame, key: list[str]) -> DataFrame:
    """(key, place, kind, level, ordered, text): headings, lists, paragraphs and tables of all pages in reading order.

    Lines that tables use take no part in blocks.  Tables come as Markdown.
    """
    cuts = segments.withColumn("cut", F.lit(0)).unionByName(fine.withColumn("cut", F.lit(1)), allowMissingColumns=True)
    segment = F.struct(*_SEGMENT, *(c for c in ("bold",) if c in cuts.columns))
    of = lambda cut: F.sort_array(F.collect_list(F.when(F.col("cut") == cut, segment)))
    return _layout(cuts.groupBy(*key).agg(of(0).alias("s"), of(1).alias("f")), body, key)


def documents_layout(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, page, place, kind, level, ordered, text) as page_layout, of documents (doc_id, pages: an array of page and its runs r).

    A document is a row until its pages are laid out, as its body's size is one of its own; neither runs nor segments are
    shuffled or joined.  Items are written, so that nothing lays pages out again, and dealt to ``parts`` partitions once.
    """
    items = ", ".join(f"{c}: {kind}" for c, kind in (("page", "int"), ("place", "int"), ("n_segments", "int"), ("text", "string"), ("size", "double"), ("bold", "boolean"), ("rows", "array<array<string>>")))

    @F.arrow_udf(f"struct<body: double, s: array<struct<{items}>>>")
    @sliced
    def find(own: pa.Array) -> pa.Array:
        of, number, runs = paged(own)
        body = bodies(of, len(own), runs)
        found: list[list[tuple]] = [[] for _ in body]
        for doc, page, wide, fine in zip(of.tolist(), number.tolist(), records(page_segments(runs)), records(page_segments(runs, 0.5)), strict=True):
            found[doc] += [(page, *item) for item in layout_items(wide, fine, 11.0 if body[doc] is None else body[doc])]
        return pa.StructArray.from_arrays([pa.array(body, pa.float64()), lists(found, [("page", pa.int32()), *_ITEM])], ["body", "s"])

    laid = written(docs.select("doc_id", find("pages").alias("d")).select("doc_id", "d.body", "d.s"), "layout")
    return _told(classified_documents(laid.repartition(parts, "doc_id"))).select("doc_id", "page", "place", "kind", "level", "ordered", "text")


def _layout(pages: DataFrame, body: DataFrame, key: list[str]) -> DataFrame:
    """Items of pages s, f are written, so that what is told of documents does not lay pages out again."""

    @F.arrow_udf("array<struct<place: int, n_segments: int, text: string, size: double, bold: boolean, rows: array<array<string>>>>")
    @sliced
    def find(wide: pa.Array, fine: pa.Array, units: pa.Array) -> pa.Array:
        return lists([layout_items(*own) for own in zip(records(wide), records(fine), units.to_pylist(), strict=True)], _ITEM)

    body = written(body, "body")  # needed for the items and for their kinds
    items = written(pages.join(body, "doc_id", "left").select(*key, F.inline(find("s", "f", F.coalesce("body", F.lit(11.0))))), "layout")
    return _told(classified(items, body)).select(*key, "place", "kind", "level", "ordered", "text")


def _told(items: DataFrame) -> DataFrame:
    """Classified items, tables as such and as Markdown."""
    table = F.col("rows").isNotNull()
    return items.withColumns({"kind": F.when(table, "table").otherwise(F.col("kind")), "text": F.when(table, rows_markdown(F.col("rows"))).otherwise(F.col("text"))})
