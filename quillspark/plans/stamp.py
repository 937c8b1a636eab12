"""Queries that place things on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import geometry as G
from quillspark.operators import stamp as O
from quillspark.plans.registry import query
from quillspark.sources.tables import doc_pages, read, sheet_lines

_PAGES = """with pages as (select conv_id as doc_id, turn as page_index, 612.0::double + turn as w, 792.0::double as h, count(*) over (partition by conv_id) as total from conversations)
"""


@query(_PAGES + """, n as (select *, page_index - 1 as o from pages where page_index >= 1), l as (select *, (o + 5) || ' of ' || (total - 1 - 1 + 1 + 4) as label, case when o % 2 = 1 then 'bottom-left' else 'bottom-right' end as position from n)
    select doc_id, page_index, label, position, round(case position when 'bottom-left' then 28.346456692913385 else w - length(label) * 6.0 - 28.346456692913385 end, 3)::double as x, 28.346::double as y from l""")
def page_number_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers from the second page on, mirrored on facing pages."""
    s = O.page_numbers(doc_pages(spark, sf_dir), start_page=2, starting=5, template="{n} of {total}", position="bottom-right", mirror=True)
    return s.select("doc_id", F.col("page_index").cast("long").alias("page_index"), "label", "position", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("""with n as (select p_partkey, (p_partkey % 3999 + 1)::int as n from part)
    select p_partkey, n, repeat('m', n // 1000) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1]
    || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] as roman from n""")
def roman_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roman numerals."""
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 3999 + 1).cast("int").alias("n"))
    return p.withColumn("roman", G.roman(F.col("n")))


_POSITIONS = ("top-left", "top-center", "top-right", "center-left", "center", "center-right", "bottom-left", "bottom-center", "bottom-right")


@query(f"""with b as (select o_orderkey, {list(_POSITIONS)}[o_orderkey % 9 + 1] as position, 50.0 + o_custkey % 200 as w, 20.0 + o_orderkey % 60 as h, (o_orderkey * 15 % 360)::double as deg from orders),
    t as (select *, abs(w * cos(radians(deg))) + abs(h * sin(radians(deg))) as bw, abs(w * sin(radians(deg))) + abs(h * cos(radians(deg))) as bh from b),
    a as (select *, case when position like '%left' then 18 when position like '%right' then 612 - bw - 18 else (612 - bw) / 2 end as ax, case when position like 'top%' then 792 - bh - 18 when position like 'bottom%' then 18 else (792 - bh) / 2 end as ay from t)
    select o_orderkey, position, round(ax + bw / 2 - (w / 2 * cos(radians(deg)) - h / 2 * sin(radians(deg))), 3)::double as x, round(ay + bh / 2 - (w / 2 * sin(radians(deg)) + h / 2 * cos(radians(deg))), 3)::double as y from a""")
def watermark_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turned boxes at nine positions."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.element_at(F.array(*map(F.lit, _POSITIONS)), (k % 9 + 1).cast("int")).alias("position"), (F.lit(50.0) + F.col("o_custkey") % 200).alias("w"), (F.lit(20.0) + k % 60).alias("h"), (k * 15 % 360).cast("double").alias("deg")
    )
    x, y = G.turned_placement(F.lit(612.0), F.lit(792.0), F.col("w"), F.col("h"), F.col("deg"), F.col("position"), F.lit(18.0))
    return o.select("o_orderkey", "position", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(_PAGES + """, s as (select doc_id, page_index, w, h, abs(200 * cos(radians(30))) + abs(40 * sin(radians(30))) as bw, abs(200 * sin(radians(30))) + abs(40 * cos(radians(30))) as bh from pages),
    z as (select *, bw + greatest(40, bw * 0.4) as sx, bh + greatest(60, bh * 0.8) as sy from s), r as (select *, unnest(range(-1, ceil(h / sy)::int + 1)) as r from z), c as (select *, unnest(range(-1, ceil(w / sx)::int + 1)) as c from r)
    select doc_id, page_index, r, c, round(c * sx + case when abs(r) % 2 = 1 then sx / 2 else 0 end, 3)::double as x, round(r * sy, 3)::double as y from c""")
def watermark_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of a watermark over every page."""
    t = O.tiles(doc_pages(spark, sf_dir), 200.0, 40.0, 30.0)
    return t.select("doc_id", F.col("page_index").cast("long").alias("page_index"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(_PAGES + """, s as (select distinct doc_id, 0::bigint as page_index from pages union all select distinct doc_id, 2 from pages union all select distinct doc_id, 90 from pages)
    select s.doc_id, s.page_index, 100.0::double as x, h - 50 - 30 as y from s join pages p using (doc_id, page_index)""")
def signature_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures on pages that exist."""
    pages = doc_pages(spark, sf_dir)
    rows = F.array(*[F.struct(F.lit(p).alias("page_index"), F.lit(100.0).alias("x"), F.lit(50.0).alias("y"), F.lit(80.0).alias("w"), F.lit(30.0).alias("h")) for p in (0, 2, 90)])
    placements = pages.select("doc_id").distinct().select("doc_id", F.inline(rows))
    return O.signatures(pages, placements).select("doc_id", F.col("page_index").cast("long").alias("page_index"), "x", "y")


@query("""with c as (select c_custkey, '#' || lpad(format('{:x}', c_custkey * 7919 % 16777216), 6, '0') as color from customer)
    select c_custkey, color, round(('0x' || color[2:3])::int / 255.0, 6)::double as r, round(('0x' || color[4:5])::int / 255.0, 6)::double as g, round(('0x' || color[6:7])::int / 255.0, 6)::double as b from c""")
def hex_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours as numbers."""
    c = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("c_custkey") * 7919 % 16777216), 6, "0")))
    return read(spark, sf_dir, "customer").select("c_custkey", c.alias("color")).withColumn("v", G.rgb(F.col("color"))).select("c_custkey", "color", *(F.round(f"v.{p}", 6).alias(p) for p in "rgb"))


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+", -1), lambda w: w != "")
    return O.wrapped(read(spark, sf_dir, "documents").select("doc_id", found.alias("words")), ["doc_id"], "words", 72)


@query()
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts wrapped to 72 characters."""
    return _wrapped(spark, sf_dir).select("doc_id", "line", F.col("n_words").cast("long").alias("n_words"), F.md5("text").alias("digest"))


@query("""with recursive i as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as k, 10 + l_quantity * 4 as h from lineitem), s as (select *, k + 1 as n from i),
    r as (select l_orderkey, k, n, h, 0 as page, h as used from s where n = 1 union all select s.l_orderkey, s.k, s.n, s.h, case when r.used > 0 and r.used + s.h > 300 then r.page + 1 else r.page end, case when r.used > 0 and r.used + s.h > 300 then s.h else r.used + s.h end
      from r join s on s.l_orderkey = r.l_orderkey and s.n = r.n + 1)
    select l_orderkey, page, k, h from r""")
def paged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of orders on pages of 300 points."""
    b = sheet_lines(spark, sf_dir).select("l_orderkey", F.col("row").alias("k"), (F.lit(10) + F.col("l_quantity") * 4).alias("h"))
    return O.paged(b, ["l_orderkey"], "k", 300.0)


@query("""with i as (select l_orderkey, l_linenumber, l_suppkey % 400 * 7.5 as top, l_quantity * 3 as h from lineitem)
    select l_orderkey, l_linenumber, p as page, (top - p * 250)::double as page_top from i, unnest(range(floor(top / 250)::bigint, greatest(floor(top / 250), floor((top + greatest(h - 1e-9, 0)) / 250))::bigint + 1)) u(p)""")
def clipped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items on all pages that they touch."""
    i = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 400 * 7.5).alias("top"), (F.col("l_quantity") * 3).alias("h"))
    return O.clipped(i, 250.0).select("l_orderkey", "l_linenumber", F.col("page").cast("long").alias("page"), "page_top")


@query("""with p as (select conv_id as doc_id, turn as page_index, (turn * 90 % 360)::int as r, 5.0::double as x0, 10.0::double as y0, 612.0::double + turn as x1, 792.0::double as y1 from conversations)
    select doc_id, page_index, case r when 0 then 1.0 when 180 then -1.0 else 0.0 end::double as a, case r when 90 then 1.0 when 270 then -1.0 else 0.0 end::double as b, case r when 90 then -1.0 when 270 then 1.0 else 0.0 end::double as c,
    case r when 0 then 1.0 when 180 then -1.0 else 0.0 end::double as d, case when r in (90, 180) then x1 else x0 end as e, case when r in (180, 270) then y1 else y0 end as f, case when r in (90, 270) then y1 - y0 else x1 - x0 end as width, case when r in (90, 270) then x1 - x0 else y1 - y0 end as height from p""")
def viewer_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices from pages as they are seen to their own space."""
    p = doc_pages(spark, sf_dir)
    m = G.viewer_matrix(F.lit(5.0), F.lit(10.0), F.col("x1"), F.col("y1"), F.col("rotate"))
    return p.select("doc_id", F.col("page_index").cast("long").alias("page_index"), m.alias("m")).select("doc_id", "page_index", "m.*")


@query("""select l_orderkey, l_linenumber, least(greatest(floor((l_suppkey % 90 * 9.25 - 40) * 2.5), 0), 1530)::bigint as x0, least(greatest(floor(l_partkey % 80 * 11.75 * 2.5), 0), 1980)::bigint as y0,
    least(greatest(ceil((l_suppkey % 90 * 9.25 - 40 + l_quantity) * 2.5), 0), 1530)::bigint as x1, least(greatest(ceil((l_partkey % 80 * 11.75 + 13.25) * 2.5), 0), 1980)::bigint as y1 from lineitem""")
def burnt_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that boxes blacken on pages of 612 by 792 points."""
    box = G.burnt_box(F.col("l_suppkey") % 90 * 9.25 - 40, F.col("l_partkey") % 80 * 11.75, F.col("l_quantity"), F.lit(13.25), F.lit(612.0), F.lit(792.0))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@query("""with i as (select l_orderkey, l_linenumber, l_partkey, case l_suppkey % 5 when 0 then 'text' when 1 then 'rect' when 2 then 'line' when 3 then 'image' else 'text' end as kind from lineitem)
    select l_orderkey, l_linenumber, kind, row_number() over (partition by l_orderkey order by case kind when 'rect' then 1 when 'image' then 2 when 'line' then 3 else 4 end, l_linenumber) - 1 as place from i""")
def drawing_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which items of a page are drawn."""
    k = F.col("l_suppkey") % 5
    kind = F.when(k == 1, "rect").when(k == 2, "line").when(k == 3, "image").otherwise("text")
    i = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"))
    return O.drawing_order(i, ["l_orderkey"], "kind", "l_linenumber").withColumn("place", F.col("place").cast("long"))


@query()
def paginated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as long columns, their lines wrapped at 80 characters, cut into pages between lines; a line of bars forces a break."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    high = F.transform(lines, lambda x: F.ceil(F.length(x) / 80.0) * 14.0)
    docs = read(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"), high.alias("high"))
    placed = docs.select("doc_id", F.posexplode(F.arrays_zip("lines", "high")).alias("k", "l")).select("doc_id", "k", "l.*")
    below = F.sum("high").over(Window.partitionBy("doc_id").orderBy("k"))
    spans = placed.withColumn("bottom", below).withColumn("top", F.col("bottom") - F.col("high"))
    g = spans.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("top", "bottom"))).alias("texts"), F.sort_array(F.collect_list(F.when(F.col("lines").startswith("|"), F.col("top")))).alias("forced"), F.max("bottom").alias("bottom"),
    )
    return O.paginated(g, ["doc_id"], 700.0)
