"""Operators that recover the structure of pages from text runs.

runs: doc_id, page, run_no, text, x, y, w, size, bold.  A page is a row, doc_id, page and the array r of its runs: what
lines, segments and styles are depends on a page alone, so that words are not shuffled or sorted as rows, and only what is
found becomes rows.  Sorts always end with run_no, so results do not depend on the order in which runs arrive.  Lines are
anchored on their first run, which a lag window cannot express.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import runs as R
from quillspark.functions.slices import sliced
from quillspark.functions.text import BULLET, escape_markdown

PAGE = ("doc_id", "page")
RUN = ("run_no", "text", "x", "y", "w", "size", "bold")


def upper_median(values: Column) -> Column:
    """The middle of a sorted array, the upper one of two."""
    return F.element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def pages(runs: DataFrame) -> DataFrame:
    """(doc_id, page, r): runs gathered by page."""
    flags = [c for c in ("bold", "italic", "mono") if c in runs.columns]
    return runs.groupBy(*PAGE).agg(F.collect_list(F.struct(*RUN[:-1], *flags)).alias("r"))


def _rows(paged: DataFrame, found: Column) -> DataFrame:
    """What an Arrow function finds on pages, as rows.  Under a generator its argument would leave Python, runs and all, and come back."""
    return paged.select(*PAGE, found.alias("found")).select(*PAGE, F.inline("found"))


def _lined(own: pa.Array) -> dict:
    """The columns of runs in order of page, line, x, run_no, with page, line, line_size, end and where lines begin."""
    page, c = R.flat(own)
    order = np.lexsort((c["run_no"], c["x"], c["y"], page))
    begins, y, size = R.line_starts(page[order], c["y"][order], c["size"][order]), c["y"][order], c["size"][order]
    line, starts = np.cumsum(begins) - 1, np.flatnonzero(begins)
    by_x = np.lexsort((c["run_no"][order], c["x"][order], line))
    found = R.taken(c, order[by_x]) | {"page": page[order], "begins": begins, "line": R.places(begins, R.changes(page[order])), "line_size": R.upper_median(size, starts)[line]}
    return found | {"end": found["x"] + found["w"]}


def _segmented(own: pa.Array, gap: float) -> dict:
    """The columns of lined runs, with segment and where segments begin: ``gap`` line sizes or more behind all runs before."""
    c = _lined(own)
    cuts = c["begins"] | (c["x"] - R.behind(c["end"], c["begins"]) >= c["line_size"] * gap)
    return c | {"cuts": cuts, "segment": R.places(cuts, c["begins"])}


_INT, _REAL, _FLAG, _TEXT = pa.int32(), pa.float64(), pa.bool_(), pa.string()


def lines(runs: DataFrame) -> DataFrame:
    """Adds line and line_size: runs within 0.4 sizes of the first run of the line before, 0.6 where one is much smaller."""

    @F.arrow_udf("array<struct<line: int, line_size: double, run_no: bigint, text: string, x: double, y: double, w: double, size: double, bold: boolean>>")
    @sliced
    def place(own: pa.Array) -> pa.Array:
        c = _lined(own)
        return R.listed(c["page"], len(own), c, {"line": _INT, "line_size": _REAL, "run_no": pa.int64(), "text": _TEXT, "x": _REAL, "y": _REAL, "w": _REAL, "size": _REAL, "bold": _FLAG})

    return pages(runs).select(*PAGE, F.inline(place("r")))


def line_boxes(paged: DataFrame) -> DataFrame:
    """One row per line: number of runs, extent, upper medians of y and size."""

    @F.arrow_udf("array<struct<line: int, n_runs: bigint, x0: double, x1: double, y: double, size: double>>")
    @sliced
    def find(own: pa.Array) -> pa.Array:
        c = _lined(own)
        at = np.flatnonzero(c["begins"])
        found = {"line": c["line"][at], "n_runs": np.diff(at, append=len(c["x"])), "y": R.upper_median(c["y"], at), "size": c["line_size"][at]}
        found |= {"x0": np.minimum.reduceat(c["x"], at), "x1": np.maximum.reduceat(c["end"], at)} if len(at) else {"x0": c["x"], "x1": c["x"]}
        return R.listed(c["page"][at], len(own), found, {"line": _INT, "n_runs": pa.int64(), "x0": _REAL, "x1": _REAL, "y": _REAL, "size": _REAL})

    return _rows(paged, find(F.col("r")))


_SEGMENT = {"line": _INT, "segment": _INT, "x0": _REAL, "x1": _REAL, "y": _REAL, "size": _REAL, "bold": _FLAG, "text": _TEXT}


def _found_segments(own: pa.Array, gap: float) -> tuple[np.ndarray, dict]:
    """The page of every segment, and the columns of _SEGMENT."""
    c = _segmented(own, gap)
    at = np.flatnonzero(c["cuts"])
    pieces = R.spaced(c["text"], c["x"], c["end"], c["size"], c["cuts"])
    found = {"line": c["line"][at], "segment": c["segment"][at], "y": R.upper_median(c["y"], at), "size": R.upper_median(c["size"], at), "text": R.collapsed(R.joined(pieces, at, ""))}
    folds = {"x0": (np.minimum, c["x"]), "x1": (np.maximum, c["end"]), "bold": (np.logical_and, c["bold"].astype(bool))}
    return c["page"][at], found | {name: f.reduceat(values, at) if len(at) else values for name, (f, values) in folds.items()}


def page_segments(own: pa.Array, gap: float = 1.6) -> pa.Array:
    """The segments of pages, lists of runs, as lists (see segment_lists)."""
    page, found = _found_segments(own, gap)
    return R.listed(page, len(own), found, _SEGMENT)


def segment_lists(runs: Column, gap: float = 1.6) -> Column:
    """A page's segments (line, segment, x0, x1, y, size, bold, text), an array: a line is cut ``gap`` sizes behind all runs before.

    Texts have spaces where runs are more than 0.15 sizes apart; a segment is bold where all its runs are.
    """

    @F.arrow_udf("array<struct<line: int, segment: int, x0: double, x1: double, y: double, size: double, bold: boolean, text: string>>")
    @sliced
    def find(own: pa.Array) -> pa.Array:
        return page_segments(own, gap)

    return find(runs)


def segments(paged: DataFrame, gap: float = 1.6) -> DataFrame:
    """One row per segment (see segment_lists)."""
    return _rows(paged, segment_lists(F.col("r"), gap))


def style_runs(paged: DataFrame) -> DataFrame:
    """Neighbouring runs of a segment with the same weight and nearly the same size as one styled run."""

    @F.arrow_udf("array<struct<line: int, segment: int, style: int, bold: boolean, text: string>>")
    @sliced
    def find(own: pa.Array) -> pa.Array:
        c = _segmented(own, 1.6)
        begins = c["cuts"] | R.changes(c["bold"]) | (np.abs(np.diff(c["size"], prepend=0.0)) >= 0.5)
        at = np.flatnonzero(begins)
        found = {"style": R.places(begins, c["cuts"])[at], "text": R.joined(c["text"], at, " ")} | {name: c[name][at] for name in ("line", "segment", "bold")}
        return R.listed(c["page"][at], len(own), found, {"line": _INT, "segment": _INT, "style": _INT, "bold": _FLAG, "text": _TEXT})

    return _rows(paged, find(F.col("r")))


def emphasis(text: Column, bold: Column, italic: Column, mono: Column) -> Column:
    """A run as Markdown: code, or escaped with stars for italic and bold; white space at its ends stays outside."""
    core = F.regexp_replace(text, r"^\s+|\s+$", "")
    starred = F.concat(F.when(bold, "**").otherwise(""), F.when(italic, "*").otherwise(""))
    shown = F.when(mono, F.concat(F.lit("`"), F.replace(core, F.lit("`"), F.lit("")), F.lit("`"))).otherwise(F.concat(starred, escape_markdown(core), F.reverse(starred)))
    return F.when(core == "", text).otherwise(F.concat(F.regexp_extract(text, r"^\s*", 0), shown, F.regexp_extract(text, r"\s*$", 0)))


def emphasized(paged: DataFrame, styles: tuple[str, ...] = ("bold", "italic", "mono")) -> DataFrame:
    """(doc_id, page, line, segment, text): segments as Markdown, neighbouring runs of one emphasis as one.

    Runs are bold, italic or set in a face of equal widths where they have such fields; ``styles`` names those that count.
    """

    @F.arrow_udf("array<struct<line: int, segment: int, text: string>>")
    @sliced
    def find(own: pa.Array) -> pa.Array:
        c = _segmented(own, 1.6)
        flags = [c[s].astype(bool) if s in c and s in styles else np.zeros(len(c["x"]), bool) for s in ("bold", "italic", "mono")]
        begins = c["cuts"] | R.changes(*flags)
        at, cut = np.flatnonzero(begins), np.flatnonzero(c["cuts"])
        text = R.joined(R.spaced(c["text"], c["x"], c["end"], c["size"], c["cuts"]), at, "")
        told = R.joined(R.emphasis(text, *(f[at] for f in flags)), np.flatnonzero(c["cuts"][at]), "")
        return R.listed(c["page"][cut], len(own), {"line": c["line"][cut], "segment": c["segment"][cut], "text": R.collapsed(told)}, {"line": _INT, "segment": _INT, "text": _TEXT})

    return _rows(paged, find(F.col("r")))


def merged_spans(spans: DataFrame, key: list[str]) -> DataFrame:
    """Spans x0..x1 that overlap as one; spans that only touch stay apart."""
    order = Window.partitionBy(*key).orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.coalesce(F.col("x0") >= reach, F.lit(False)).cast("int")).withColumn("column", F.sum("new").over(order).cast("int"))
    return rows.groupBy(*key, "column").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def cell_columns(cells: DataFrame, columns: DataFrame, key: list[str]) -> DataFrame:
    """The column that each cell (key, line, segment, x0, x1, text) overlaps most, else the nearest by centre, first of equals."""
    c = columns.select(*key, "column", F.col("x0").alias("c0"), F.col("x1").alias("c1"))
    overlap = F.least("x1", "c1") - F.greatest("x0", "c0")
    score = F.when(overlap > 0, overlap).otherwise(-F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("c0") + F.col("c1")) / 2))
    joined = cells.join(c, key).withColumn("score", score)
    return joined.groupBy(*key, "line", "segment").agg(F.max_by("column", F.struct("score", -F.col("column"))).alias("column"), F.first("text").alias("text"))


def table_rows(placed: DataFrame, key: list[str]) -> DataFrame:
    """Cells of the same line and column joined by spaces, in order of segments."""
    g = placed.groupBy(*key, "line", "column").agg(F.sort_array(F.collect_list(F.struct("segment", "text"))).alias("t"))
    return g.select(*key, "line", "column", F.array_join(F.col("t.text"), " ").alias("text"))


def _weighed(group: np.ndarray, n: int, c: dict) -> pa.Array:
    """The sizes of runs to the half point with their weights, for each of ``n`` groups."""
    size, weight = np.floor(c["size"] * 2 + 0.5) / 2, np.minimum(pc.fill_null(pc.utf8_length(c["text"]), 0).to_numpy(zero_copy_only=False), 20)
    order = np.lexsort((size, group))
    at = np.flatnonzero(R.changes(group[order], size[order]))
    total = np.add.reduceat(weight[order].astype(np.int64), at) if len(at) else weight
    return R.listed(group[order][at], n, {"size": size[order][at], "weight": total}, {"size": _REAL, "weight": pa.int64()})


def bodies(of: np.ndarray, n: int, runs: pa.Array) -> list[float | None]:
    """As body_size, for each of ``n`` documents; ``of`` is the document of every page of runs."""
    page, c = R.flat(runs)
    out = []
    for own in _weighed(of[page], n, c).to_pylist():
        middle, upto = sum(w["weight"] for w in own) // 2, accumulate(w["weight"] for w in own)
        out.append(next((w["size"] for w, reached in zip(own, upto, strict=True) if reached > middle), None))
    return out


def weight_lists(runs: Column) -> Column:
    """The sizes of a page to the half point with their weights, an array of (size, weight): a run counts for up to 20 characters."""

    @F.arrow_udf("array<struct<size: double, weight: bigint>>")
    @sliced
    def weigh(own: pa.Array) -> pa.Array:
        page, c = R.flat(own)
        return _weighed(page, len(own), c)

    return weigh(runs)


def size_weights(paged: DataFrame) -> DataFrame:
    """(doc_id, size, weight) of every page (see weight_lists)."""
    return paged.select("doc_id", F.inline(weight_lists(F.col("r"))))


def body_size(weights: DataFrame) -> DataFrame:
    """The size of most text of a document: upper median of the sizes of its characters."""
    by_size = weights.groupBy("doc_id", "size").agg(F.sum("weight").alias("weight"))
    w = Window.partitionBy("doc_id").orderBy("size")
    total = F.sum("weight").over(Window.partitionBy("doc_id"))
    reached = by_size.withColumns({"before": F.sum("weight").over(w) - F.col("weight"), "upto": F.sum("weight").over(w), "middle": F.floor(total / 2)})
    return reached.where("before <= middle and middle < upto").select("doc_id", F.col("size").alias("body"))


def _half(size: Column) -> Column:
    return F.floor(size * 2 + 0.5) / 2


def heading_sizes(blocks: DataFrame, body: DataFrame) -> DataFrame:
    """(doc_id, body, sizes): the distinct sizes, to the half point, of 1.15 bodies and more, largest first; bodies of 11 where unknown."""
    rows = blocks.select("doc_id", _half(F.col("size")).alias("size")).distinct().join(body, "doc_id", "left").withColumn("body", F.coalesce("body", F.lit(11.0)))
    large = F.collect_set(F.when(F.col("size") >= F.col("body") * 1.15, F.col("size")))
    return rows.groupBy("doc_id").agg(F.first("body").alias("body"), F.sort_array(large, asc=False).alias("sizes"))


def heading_level(size: Column, sizes: Column) -> Column:
    """1 to 3: the place of the first size less than 0.6 away, 1 where there is none."""
    return F.least(F.greatest(F.array_position(F.transform(sizes, lambda s: F.abs(s - size) < 0.6), True), F.lit(1)), F.lit(3))


def heading_levels(blocks: DataFrame, body: DataFrame) -> DataFrame:
    """(doc_id, size, level) of the sizes of headings."""
    found = heading_sizes(blocks, body)
    return found.select("doc_id", "sizes", F.explode("sizes").alias("size")).select("doc_id", "size", heading_level(F.col("size"), F.col("sizes")).alias("level"))


def classified(blocks: DataFrame, body: DataFrame) -> DataFrame:
    """Adds kind (heading, list, paragraph), level, marker and ordered to blocks of text, size, bold and n_segments."""
    joined = blocks.join(body, "doc_id", "left").withColumn("body", _known_body())
    half = _half(F.col("size"))
    sizes = F.collect_set(F.when(half >= F.col("body") * 1.15, half)).over(Window.partitionBy("doc_id"))  # as heading_sizes, without a second look at the blocks
    return _kinds(joined.withColumn("sizes", F.sort_array(sizes, asc=False)))


def _known_body() -> Column:
    """Bodies of 11 where unknown; rows without a document have none."""
    return F.when(F.col("doc_id").isNotNull(), F.coalesce("body", F.lit(11.0)))


def classified_segments(docs: DataFrame, gap: float = 1.6) -> DataFrame:
    """Segments of documents (doc_id, pages: an array of page and its runs r) as classified blocks: as ``classified``, with page, line and segment.

    A document is a row until it is known which size is its body's, so that neither segments nor weights of sizes are shuffled or written.
    """
    kinds = ", ".join(f"{c}: {kind}" for c, kind in (("page", "int"), ("line", "int"), ("segment", "int"), ("size", "double"), ("bold", "boolean"), ("text", "string")))

    @F.arrow_udf(f"struct<s: array<struct<{kinds}>>, w: array<struct<size: double, weight: bigint>>>")
    @sliced
    def find(own: pa.Array) -> pa.Array:
        of, number, runs = R.paged(own)
        page, found = _found_segments(runs, gap)
        segs = R.listed(of[page], len(own), found | {"page": number[page]}, {"page": _INT} | {c: _SEGMENT[c] for c in ("line", "segment", "size", "bold", "text")})
        run_page, c = R.flat(runs)
        return pa.StructArray.from_arrays([segs, _weighed(of[run_page], len(own), c)], ["s", "w"])

    weight = lambda of: F.aggregate("w", F.lit(0).cast("bigint"), lambda total, e: total + of(e))
    upto = lambda size: weight(lambda e: F.when(e["size"] <= size, e["weight"]).otherwise(0))
    found = docs.select("doc_id", find("pages").alias("d")).select("doc_id", F.col("d.s").alias("s"), F.col("d.w").alias("w"))
    middle = F.floor(weight(lambda e: e["weight"]) / 2)
    sized = found.withColumn("middle", middle).withColumn("body", F.array_min(F.filter("w.size", lambda size: upto(size) > F.col("middle"))))
    return _kinds(_of_documents(sized).withColumn("n_segments", F.lit(1)))


def classified_documents(docs: DataFrame) -> DataFrame:
    """``classified`` blocks of documents (doc_id, body, s: an array of blocks): no row looks at others for the sizes of its document."""
    return _kinds(_of_documents(docs))


def _of_documents(docs: DataFrame) -> DataFrame:
    """The blocks s of documents as rows, with body and sizes of headings."""
    known = docs.select("doc_id", "s", _known_body().alias("body"))
    large = F.filter(F.transform("s.size", _half), lambda size: size >= F.col("body") * 1.15)
    return known.select("doc_id", "body", F.sort_array(F.array_distinct(large), asc=False).alias("sizes"), "s").select("doc_id", "body", "sizes", F.inline("s"))


def _kinds(joined: DataFrame) -> DataFrame:
    base = F.col("body")
    listed = F.col("text").rlike(BULLET)
    large = F.col("size") >= base * 1.15
    short = (F.col("n_segments") <= 3) & (F.length("text") < 160) & ~F.col("text").rlike("[.:;,]$")
    heading = short & (large | (F.col("bold") & (F.col("size") >= base * 0.95) & (F.length("text") < 90) & (F.col("n_segments") <= 2)))
    kind = F.when(listed, "list").when(heading, "heading").otherwise("paragraph")
    marker = F.when(listed, F.trim(F.regexp_extract("text", BULLET, 1)))
    bare = F.regexp_replace(marker, "[.()]", "")
    return joined.withColumns({
        "kind": kind, "level": F.when(kind == "heading", F.when(large, heading_level(F.col("size"), F.col("sizes"))).otherwise(3)), "marker": marker,
        "ordered": F.when(listed, bare.rlike("[0-9]|^[a-zA-Z]$|^[ivxIVX]+$")), "text": F.when(listed, F.regexp_replace("text", BULLET, "")).otherwise(F.col("text")),
    }).drop("body", "sizes")


def alignment(segs: DataFrame, key: list[str], page_width: float) -> DataFrame:
    """left, center, right or justify by the edges of a block's segments (order: line)."""
    first, last = Window.partitionBy(*key).orderBy("line", "segment"), Window.partitionBy(*key).orderBy(F.desc("line"), F.desc("segment"))
    rows = segs.withColumns({"left": F.when(F.row_number().over(first) > 1, F.col("x0")), "right": F.when(F.row_number().over(last) > 1, F.col("x1")), "mid": (F.col("x0") + F.col("x1")) / 2})
    g = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), upper_median(F.collect_list("size")).alias("size"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        *((F.max(c) - F.min(c)).alias(f"spread_{c}") for c in ("left", "right", "mid")),
    )
    centre = (F.col("x0") + F.col("x1")) / 2
    many = F.when((F.col("spread_left") < F.col("size")) & (F.col("spread_right") < F.col("size")), "justify").when((F.col("spread_mid") < F.col("size")) & (F.col("spread_left") > F.col("size")), "center").otherwise("left")
    one = F.when((F.abs(centre - page_width / 2) < page_width * 0.05) & (F.col("x0") > page_width * 0.2), "center").when((F.col("x1") > page_width * 0.85) & (F.col("x0") > page_width * 0.5), "right").otherwise("left")
    return g.select(*key, "n", F.when(F.col("n") > 2, many).when(F.col("n") == 1, one).otherwise("left").alias("align"))


def dominant(df: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones that which reached its number first."""
    counted = df.withColumn("nth", F.count(F.lit(1)).over(Window.partitionBy(*key, value).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return counted.groupBy(*key).agg(F.max_by(value, F.struct("nth", -F.col(order))).alias("dominant"))


def chained_pages(paged: DataFrame, band: float = 0.6) -> DataFrame:
    """Lines chained on the run before (by y): a new line where y moves by ``band`` sizes or more.  Mean y, largest size, least x."""

    @F.arrow_udf("array<struct<line: int, y: double, size: double, x: double, text: string>>")
    @sliced
    def find(own: pa.Array) -> pa.Array:
        page, c = R.flat(own)
        order = np.lexsort((c["run_no"], c["x"], c["y"], page))
        new = R.changes(page[order])
        begins = new | (np.abs(np.diff(c["y"][order], prepend=0.0)) >= c["size"][order] * band)
        by_x = np.lexsort((c["run_no"][order], c["x"][order], np.cumsum(begins)))
        at, c, page = np.flatnonzero(begins), R.taken(c, order[by_x]), page[order]
        found = {"line": R.places(begins, new)[at], "text": R.joined(c["text"], at, " ")}
        folds = {"y": np.add, "size": np.maximum, "x": np.minimum}
        found |= {name: f.reduceat(c[name], at) if len(at) else c[name] for name, f in folds.items()}
        found["y"] = found["y"] / np.diff(at, append=len(page))
        return R.listed(page[at], len(own), found, {"line": _INT, "y": _REAL, "size": _REAL, "x": _REAL, "text": _TEXT})

    return _rows(paged, find(F.col("r")))


def chained_lines(runs: DataFrame, band: float = 0.6) -> DataFrame:
    """chained_pages of runs that are rows."""
    return chained_pages(pages(runs), band)


def distinct_boxes(boxes: DataFrame, key: list[str], order: str, least: float = 24.0, near: float = 1.0) -> DataFrame:
    """Boxes of ``least`` points both ways, in order, without those within ``near`` of a kept one on all sides.

    What is kept depends on what was kept before, so the boxes of a page, a unit of bounded size, are folded.
    """
    sides = ("x0", "y0", "x1", "y1")
    large = boxes.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))
    pages = large.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(order, *sides))).alias("all"))

    def step(kept: Column, b: Column) -> Column:
        close = F.exists(kept, lambda k: reduce(Column.__and__, (F.abs(k[s] - b[s]) < near for s in sides)))
        return F.when(close, kept).otherwise(F.concat(kept, F.array(b)))

    return pages.select(*key, F.inline(F.aggregate("all", F.slice("all", 1, 0), step)))


def markdown(blocks: DataFrame, key: str, order: list[str], page: str | None = None) -> DataFrame:
    """Markdown of classified blocks in order: #-headings, lists, paragraphs, tables as they are; a list ends with an empty line.

    With ``page``, a column of numbers from 0 that is the first of the order, a comment names every page before its first
    block, and lists end with their page.
    """
    w = Window.partitionBy(key).orderBy(*order)
    same = lambda other: other.eqNullSafe(F.col(page)) if page else F.lit(True)
    in_list = F.when(F.col("kind") == "list", 1).otherwise(0)
    at, opens_list = F.row_number().over(w), ~((in_list == 1) & (F.lag(in_list, 1, 0).over(w) == 1) & same(F.lag(page or key).over(w)))
    opened = blocks.withColumns({"at": at, "opened": F.when(F.coalesce(opens_list, F.lit(True)), at)})
    numbered = opened.withColumns({"nth": F.col("at") - F.max("opened").over(w) + 1, "goes_on": (F.lead("kind").over(w) == "list") & (F.col("kind") == "list") & same(F.lead(page or key).over(w))})
    if page:
        opens = F.coalesce(F.lag(page).over(w) != F.col(page), F.lit(True))
        numbered = numbered.withColumn("head", F.when(opens, F.concat(F.lit("<!-- Page "), (F.col(page) + 1).cast("string"), F.lit(" -->\n\n"))).otherwise(""))
    text = escape_markdown(F.col("text"))
    mark = F.when(F.col("ordered"), F.concat(F.col("nth").cast("string"), F.lit(". "))).otherwise("- ")
    piece = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(3)).cast("int")), F.lit(" "), text)).when(F.col("kind") == "list", F.concat(mark, text)).when(F.col("kind") == "table", F.col("text")).otherwise(text)
    ended = F.concat(F.col("head") if page else F.lit(""), piece, F.when(F.coalesce("goes_on", F.lit(False)), "\n").otherwise("\n\n"))
    rows = numbered.select(key, F.struct(*order, ended.alias("t")).alias("s")).groupBy(key).agg(F.sort_array(F.collect_list("s")).alias("s"))
    whole = F.concat(F.rtrim(F.regexp_replace(F.array_join(F.col("s.t"), ""), "\n{3,}", "\n\n"), F.lit("\n")), F.lit("\n"))
    return rows.select(key, whole.alias("markdown"))
