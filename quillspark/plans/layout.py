"""Queries on layout recovery over the words of documents placed on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import editor as E
from quillspark.operators import layout as L
from quillspark.operators.tables import blocks_of, documents_layout, tables_of
from quillspark.plans.registry import query
from quillspark.sources.tables import DEALT_BYTES, doc_lines, document_runs, page_runs, partitions, read

_RUNS = r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
w as (select doc_id, line_no, case when line_no % 7 = 0 then 16.0 else 11.0 end::double as size, list_filter(string_split(t, ' '), lambda x: x <> '') as ws from l where t <> ''),
k as (select doc_id, line_no, size, unnest(ws) as text, generate_subscripts(ws, 1) - 1 as k from w),
b as (select *, coalesce(sum(length(text) + 1 + case when k % 9 = 8 then 6 else 0 end) over (partition by doc_id, line_no order by k rows between unbounded preceding and 1 preceding), 0) as before from k),
runs as (select doc_id, (line_no // 50)::int as page, line_no, k, text, (before * 0.5 * size)::double as x, (line_no % 50 + 1) * 20.0 + case when k % 5 = 4 then 1.5 else 0.0 end as y, length(text) * 0.5 * size as w, size, k % 4 = 0 as bold from b),
lined as (select *, dense_rank() over (partition by doc_id, page order by line_no) - 1 as line from runs),
g as (select *, x - max(x + w) over (partition by doc_id, page, line order by k rows between unbounded preceding and 1 preceding) >= 1.6 * size as s from lined),
segs as (select *, sum(case when s then 1 else 0 end) over (partition by doc_id, page, line order by k) as segment from g),
seg as (select doc_id, page, line, segment, string_agg(text, ' ' order by k) as text, min(x) as x0, max(x + w) as x1, size, bool_and(bold) as bold, list_sort(list(y))[len(list(y)) // 2 + 1] as y from segs group by doc_id, page, line, segment, size)
"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_runs(spark, sf_dir, partitions(read(spark, sf_dir, "documents"), "text"))


def _dealt(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of pages, dealt by document for what looks at whole documents or pages: fewer partitions, as these are not words."""
    return rows.repartition(partitions(read(spark, sf_dir, "documents"), "text", DEALT_BYTES), "doc_id")


@query(_RUNS + "select doc_id, page, line, count(*) as n_runs, round(min(x), 3) as x0, round(max(x + w), 3) as x1, list_sort(list(y))[len(list(y)) // 2 + 1]::double as y, any_value(size) as size from lined group by 1, 2, 3")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines anchored on their first run."""
    found = L.line_boxes(_pages(spark, sf_dir))
    return found.select("doc_id", "page", F.col("line").cast("long").alias("line"), "n_runs", F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1"), "y", "size")


@query(_RUNS + "select doc_id, page, line, segment::bigint as segment, text, round(x0, 3) as x0, round(x1, 3) as x1, size, bold from seg")
def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of lines with their text."""
    s = L.segments(_pages(spark, sf_dir))
    return s.select("doc_id", "page", F.col("line").cast("long").alias("line"), F.col("segment").cast("long").alias("segment"), "text", F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1"), "size", "bold")


@query(_RUNS + """, c as (select *, case when lag(bold) over (partition by doc_id, page, line, segment order by k) <> bold then 1 else 0 end as c from segs),
    t as (select *, sum(c) over (partition by doc_id, page, line, segment order by k) as style from c)
    select doc_id, page, line, segment::bigint as segment, style::bigint as style, any_value(bold) as bold, string_agg(text, ' ' order by k) as text from t group by 1, 2, 3, 4, 5""")
def styled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one style within segments."""
    s = L.style_runs(_pages(spark, sf_dir))
    return s.select("doc_id", "page", *(F.col(c).cast("long").alias(c) for c in ("line", "segment", "style")), "bold", "text")


_COLUMNS = _RUNS + """, o as (select *, case when x0 >= max(x1) over (partition by doc_id, page order by x0, x1 rows between unbounded preceding and 1 preceding) then 1 else 0 end as n from seg),
m as (select *, sum(n) over (partition by doc_id, page order by x0, x1 range between unbounded preceding and current row) as col from o),
cols as (select doc_id, page, col::bigint as col, min(x0) as c0, max(x1) as c1 from m group by 1, 2, 3)
"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(L.segments(_pages(spark, sf_dir)), spark, sf_dir)


@query(_COLUMNS + 'select doc_id, page, col as "column", round(c0, 3) as x0, round(c1, 3) as x1 from cols')
def merged_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns: the merged spans of a page's segments."""
    c = L.merged_spans(_cells(spark, sf_dir), ["doc_id", "page"])
    return c.select("doc_id", "page", F.col("column").cast("long").alias("column"), F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1"))


@query(_COLUMNS + """, f as (select c.doc_id, c.page, line, segment, text, col, case when least(x1, c1) - greatest(x0, c0) > 0 then least(x1, c1) - greatest(x0, c0) else -abs((x0 + x1) / 2 - (c0 + c1) / 2) end as score
      from seg c join cols on c.doc_id = cols.doc_id and c.page = cols.page),
    p as (select *, row_number() over (partition by doc_id, page, line, segment order by score desc, col) as r from f)
    select doc_id, page, line, col as "column", string_agg(text, ' ' order by segment) as text from p where r = 1 group by 1, 2, 3, 4""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells placed in the columns they overlap most, joined by line."""
    cells = _cells(spark, sf_dir)
    placed = L.cell_columns(cells, L.merged_spans(cells, ["doc_id", "page"]), ["doc_id", "page"])
    rows = L.table_rows(placed, ["doc_id", "page"])
    return rows.select("doc_id", "page", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column"), "text")


_BODY = """, ws as (select doc_id, size, unnest(range(0, least(length(text), 20))) from runs), body as (select doc_id, list_sort(list(size))[len(list(size)) // 2 + 1] as body from ws group by 1)
"""


@query(_RUNS + _BODY + "select doc_id, body from body")
def body_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of most text of every document."""
    return L.body_size(L.size_weights(_pages(spark, sf_dir)))


_ITEM = r"^\s*([•◦▪▫‣⁃●○■□–—\-*·►➢✓✔]|\(?[0-9]{1,3}[.)]|\(?[a-zA-Z][.)]|[ivxIVX]{1,4}[.)])\s+"
_SIZES = """, sizes as (select doc_id, list_reverse_sort(list(distinct floor(size * 2 + 0.5) / 2)) as sizes from seg join body using (doc_id) where size >= body * 1.15 group by 1)
"""
_BLOCKS = _RUNS + _BODY + _SIZES + """, j as (select s.*, body, greatest(1, least(3, coalesce(list_position(list_transform(sizes, lambda x: abs(x - size) < 0.6), true), 1))) as level, size >= body * 1.15 as large, regexp_matches(text, '{b}') as listed
  from seg s left join body using (doc_id) left join sizes using (doc_id)),
c as (select *, case when listed then 'list' when length(text) < 160 and not regexp_matches(text, '[.:;,]$') and (large or (bold and size >= body * 0.95 and length(text) < 90)) then 'heading' else 'paragraph' end as kind from j),
blocks as (select doc_id, page, line, segment, kind, case when kind = 'heading' then case when large then level else 3 end end as level, case when listed then regexp_replace(text, '{b}', '') else text end as text,
  case when listed then regexp_matches(regexp_replace(trim(regexp_extract(text, '{b}', 1)), '[.()]', '', 'g'), '[0-9]|^[a-zA-Z]$|^[ivxIVX]+$') end as ordered from c)
""".replace("{b}", _ITEM)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as blocks, classified."""
    return L.classified_segments(document_runs(spark, sf_dir, partitions(read(spark, sf_dir, "documents"), "text")))


@query(_RUNS + _BODY + _SIZES + "select doc_id, s.size, least(3, list_position(list_transform(sizes, lambda x: abs(x - s.size) < 0.6), true))::bigint as level from sizes, unnest(sizes) s(size)")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the sizes above the body's."""
    sizes = L.size_weights(_pages(spark, sf_dir))
    return L.heading_levels(sizes, L.body_size(sizes)).withColumn("level", F.col("level").cast("long"))


@query(_BLOCKS + "select doc_id, page, line, segment::bigint as segment, kind, level::bigint as level, ordered, md5(text) as digest from blocks")
def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with levels, list items and paragraphs."""
    b = _blocks(spark, sf_dir)
    return b.select("doc_id", "page", F.col("line").cast("long").alias("line"), F.col("segment").cast("long").alias("segment"), "kind", F.col("level").cast("long").alias("level"), "ordered", F.md5("text").alias("digest"))


@query(_BLOCKS + r""", o as (select *, row_number() over w as n, lag(kind = 'list', 1, false) over w as was, lead(kind = 'list', 1, false) over w as will from blocks window w as (partition by doc_id order by page, line, segment)),
    i as (select *, sum(case when kind = 'list' and was then 0 else 1 end) over (partition by doc_id order by n) as island from o),
    r as (select *, row_number() over (partition by doc_id, island order by n) as nth, regexp_replace(text, '([\\`*_\[\]#|<>])', '\\\1', 'g') as t from i),
    p as (select doc_id, n, case kind when 'heading' then repeat('#', level::int) || ' ' || t when 'list' then case when ordered then nth || '. ' else '- ' end || t else t end || case when kind = 'list' and will then chr(10) else chr(10) || chr(10) end as piece from r)
    select doc_id, md5(rtrim(regexp_replace(string_agg(piece, '' order by n), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) || chr(10)) as digest from p group by 1""")
def documents_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of every document."""
    md = L.markdown(_dealt(_blocks(spark, sf_dir), spark, sf_dir), "doc_id", ["page", "line", "segment"])
    return md.select("doc_id", F.md5("markdown").alias("digest"))


@query(_RUNS + """, e as (select *, row_number() over (partition by doc_id, page, line order by segment) as a, row_number() over (partition by doc_id, page, line order by segment desc) as z from seg),
    h as (select doc_id, page, line, count(*) as n, any_value(size) as size, min(x0) as x0, max(x1) as x1, max(case when a > 1 then x0 end) - min(case when a > 1 then x0 end) as l, max(case when z > 1 then x1 end) - min(case when z > 1 then x1 end) as r,
        max((x0 + x1) / 2) - min((x0 + x1) / 2) as m from e group by 1, 2, 3)
    select doc_id, page, line, n, case when n > 2 then case when l < size and r < size then 'justify' when m < size and l > size then 'center' else 'left' end
        when n = 1 then case when abs((x0 + x1) / 2 - 306) < 30.6 and x0 > 122.4 then 'center' when x1 > 520.2 and x0 > 306 then 'right' else 'left' end else 'left' end as align from h""")
def block_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of lines by the edges of their segments."""
    segs = _dealt(L.segments(_pages(spark, sf_dir)).drop("text", "bold"), spark, sf_dir)
    return L.alignment(segs.withColumn("own", F.col("line")), ["doc_id", "page", "own"], 612.0).select("doc_id", "page", F.col("own").cast("long").alias("line"), "n", "align")


@query("""with e as (select user_id, event_id, event_type, row_number() over (partition by user_id, event_type order by event_id) as nth from events),
    r as (select *, row_number() over (partition by user_id order by nth desc, event_id) as k from e) select user_id, event_type as dominant from r where k = 1""")
def dominant_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event type that first reaches a user's largest number."""
    return L.dominant(read(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query(_RUNS + """, c as (select *, case when abs(y - lag(y) over w) >= size * 0.6 then 1 else 0 end as m from runs window w as (partition by doc_id, page order by y, x, line_no * 1000 + k)),
    i as (select *, sum(m) over (partition by doc_id, page order by y, x, line_no * 1000 + k) as ln from c)
    select doc_id, page, ln::bigint as line, md5(string_agg(text, ' ' order by x, line_no * 1000 + k)) as digest, round(avg(y), 3)::double as y, max(size) as size, round(min(x), 3) as x from i group by 1, 2, 3""")
def chained_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines chained on the run before."""
    c = L.chained_pages(_pages(spark, sf_dir))
    return c.select("doc_id", "page", F.col("line").cast("long").alias("line"), F.md5("text").alias("digest"), F.round("y", 3).alias("y"), "size", F.round("x", 3).alias("x"))


@query("""with recursive b as (select l_orderkey, l_linenumber, (l_suppkey % 2) * 30.0 as x0, (l_linenumber % 7) * 0.4 as y0, (l_suppkey % 2) * 30.0 + 30 + l_linenumber * 0.3 as x1, 10 + (l_quantity::int % 3 + 2) * 10.0 as y1 from lineitem),
    n as (select *, row_number() over (partition by l_orderkey order by l_linenumber, x0, y0, x1, y1) as n from b where x1 - x0 >= 24 and y1 - y0 >= 24),
    f as (select l_orderkey, 0::bigint as n, []::struct(x0 double, y0 double, x1 double, y1 double)[] as kept, true as is_new from (select distinct l_orderkey from n)
      union all select o.l_orderkey, o.n, case when o.is_new then list_append(o.kept, o.box) else o.kept end, o.is_new from (select f.l_orderkey, n.n, f.kept, {'x0': n.x0::double, 'y0': n.y0::double, 'x1': n.x1::double, 'y1': n.y1::double} as box,
        len(list_filter(f.kept, lambda k: abs(k.x0 - n.x0) < 1 and abs(k.y0 - n.y0) < 1 and abs(k.x1 - n.x1) < 1 and abs(k.y1 - n.y1) < 1)) = 0 as is_new from f join n on n.l_orderkey = f.l_orderkey and n.n = f.n + 1) o)
    select l_orderkey, l_linenumber, x0::double as x0, x1::double as x1 from n join f using (l_orderkey, n) where is_new""")
def distinct_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes large enough that repeat no kept box of their order."""
    left, top = (F.col("l_suppkey") % 2) * 30.0, (F.col("l_linenumber") % 7) * 0.4
    b = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", left.alias("x0"), top.alias("y0"), (left + 30 + F.col("l_linenumber") * 0.3).alias("x1"), (F.lit(10) + (F.col("l_quantity").cast("int") % 3 + 2) * 10.0).alias("y1")
    )
    return L.distinct_boxes(b, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "x0", "x1")


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
    c as (select doc_id, line_no, list_transform(string_split(t, '|'), lambda x: trim(x)) as cells, t like '%|%' as is_row from l), h as (select doc_id, bool_or(is_row) as has from c group by 1)
    select doc_id, line_no, case when has then cells else [t2] end as cells from (select c.*, has, array_to_string(cells, '|') as t2 from c join h using (doc_id)) where is_row or not has""")
def page_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for a sheet: the table rows of documents that have any, else all lines."""
    lines = doc_lines(spark, sf_dir)
    cells = F.transform(F.split("text", r"\|", -1), lambda x: F.trim(x))
    rows = lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), cells.alias("cells"), F.col("text").contains("|").alias("is_row"))
    has = rows.groupBy("doc_id").agg(F.bool_or("is_row").alias("has"))
    kept = rows.join(has, "doc_id").where("is_row or not has")
    return kept.select("doc_id", "line_no", F.when(F.col("has"), F.col("cells")).otherwise(F.array(F.array_join("cells", "|"))).alias("cells"))


@query()
def detected_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the tables found on all pages."""
    return tables_of(_pages(spark, sf_dir), ["doc_id", "page"], L.segment_lists(F.col("r")))


@query()
def built_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of all pages."""
    return blocks_of(_pages(spark, sf_dir), ["doc_id", "page"], L.segment_lists(F.col("r")), bold=False)


_FINE = _RUNS.replace(">= 1.6 * size", ">= 0.5 * size")


def _fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.segments(_pages(spark, sf_dir), 0.5)


@query(_FINE + "select doc_id, page, line, segment::bigint as segment, text, round(x0, 3) as x0, round(x1, 3) as x1 from seg")
def fine_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut at every gap of half a size: the cells of tables that are set tightly."""
    s = _fine(spark, sf_dir)
    return s.select("doc_id", "page", F.col("line").cast("long").alias("line"), F.col("segment").cast("long").alias("segment"), "text", F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1"))


@query()
def tight_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the tables that only finely cut lines show."""
    return tables_of(_pages(spark, sf_dir), ["doc_id", "page"], L.segment_lists(F.col("r"), 0.5), strict=True)


@query(_RUNS + r""", c as (select *, case when lag(bold) over (partition by doc_id, page, line, segment order by k) <> bold then 1 else 0 end as c from segs),
    t as (select *, sum(c) over (partition by doc_id, page, line, segment order by k) as style, case when lag(text) over (partition by doc_id, page, line, segment order by k) is null then '' else ' ' end || text as piece from c),
    r as (select doc_id, page, line, segment, style, any_value(bold) as bold, string_agg(piece, '' order by k) as text from t group by 1, 2, 3, 4, 5),
    m as (select *, case when style > 0 then ' ' else '' end as lead, regexp_replace(trim(text), '([\\`*_\[\]#|<>])', '\\\1', 'g') as core from r)
    select doc_id, page, line, segment::bigint as segment, md5(string_agg(lead || case when bold then '**' || core || '**' else core end, '' order by style)) as digest from m group by 1, 2, 3, 4""")
def emphasized_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as Markdown with bold runs marked."""
    e = L.emphasized(_pages(spark, sf_dir), ("bold",))
    return e.select("doc_id", "page", F.col("line").cast("long").alias("line"), F.col("segment").cast("long").alias("segment"), F.md5("text").alias("digest"))


@query(_RUNS + r""", f as (select *, k % 3 = 1 as italic, k % 7 = 5 as mono from segs), c as (select *, case when lag(bold) over w <> bold or lag(italic) over w <> italic or lag(mono) over w <> mono then 1 else 0 end as c from f window w as (partition by doc_id, page, line, segment order by k)),
    t as (select *, sum(c) over (partition by doc_id, page, line, segment order by k) as style, case when lag(text) over (partition by doc_id, page, line, segment order by k) is null then '' else ' ' end || text as piece from c),
    r as (select doc_id, page, line, segment, style, any_value(bold) as bold, any_value(italic) as italic, any_value(mono) as mono, string_agg(piece, '' order by k) as text from t group by 1, 2, 3, 4, 5),
    m as (select *, case when style > 0 then ' ' else '' end as lead, trim(text) as bare, regexp_replace(trim(text), '([\\`*_\[\]#|<>])', '\\\1', 'g') as core from r),
    e as (select *, case when mono then '`' || replace(bare, '`', '') || '`' when bold and italic then '***' || core || '***' when bold then '**' || core || '**' when italic then '*' || core || '*' else core end as t from m)
    select doc_id, page, line, segment::bigint as segment, md5(string_agg(lead || t, '' order by style)) as digest from e group by 1, 2, 3, 4""")
def styled_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as Markdown with runs that are bold, italic, both, or code."""
    e = L.emphasized(_pages(spark, sf_dir))
    return e.select("doc_id", "page", F.col("line").cast("long").alias("line"), F.col("segment").cast("long").alias("segment"), F.md5("text").alias("digest"))


@query()
def layout_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of all documents by pages: tables with bars, headings, lists and paragraphs in reading order."""
    parts = partitions(read(spark, sf_dir, "documents"), "text")
    placed = documents_layout(document_runs(spark, sf_dir, parts), parts)
    return L.markdown(placed, "doc_id", ["page", "place"])


def _glyphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], Column]:
    """Pages, their key and their words as glyphs; every ninth line of a page stands upright, and every thirteenth word is printed twice, a little aside."""

    def glyph(r: Column) -> Column:
        upright = (r["y"] / 20).cast("int") % 9 == 0
        values = {
            "n": r["run_no"] * 2, "text": r["text"], "x": F.when(upright, r["y"]).otherwise(r["x"]), "y": F.when(upright, r["x"]).otherwise(r["y"]), "dx": F.when(upright, 0.0).otherwise(1.0), "dy": F.when(upright, 1.0).otherwise(0.0),
            "size": r["size"], "width": r["w"], "mode": F.when(r["run_no"] % 17 == 0, 3).otherwise(0), "font": F.when(r["bold"], "B").otherwise("R"), "bold": r["bold"],
        }
        own = lambda **other: F.struct(*((values | other)[c].alias(c) for c in E.GLYPH))
        return F.when(r["run_no"] % 13 == 0, F.array(own(), own(n=values["n"] + 1, x=values["x"] + 0.4))).otherwise(F.array(own()))

    return _pages(spark, sf_dir), ["doc_id", "page"], F.flatten(F.transform("r", glyph))


@query()
def editor_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all pages' glyphs, with lines and what is printed twice."""
    return E.pages_chunks(*_glyphs(spark, sf_dir))


@query()
def editor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all pages at any angle."""
    return E.pages_lines(*_glyphs(spark, sf_dir))


@query()
def editor_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of lines of all pages."""
    return E.pages_blocks(*_glyphs(spark, sf_dir))
