"""Queries on page sets over conversations read as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import pages as P
from quillspark.plans.registry import query
from quillspark.sources.tables import doc_pages, page_counts, read

SPECS = ("1-2, 4-", "2 to 3", "-2; 3", "4-", "1, 1-2", "3-1", "9 - 12", "x")
_SPEC_ROWS = ", ".join(f"({k}, '{s}')" for k, s in enumerate(SPECS))


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two or three parts for each document, their specs chosen by its id."""
    counts = page_counts(doc_pages(spark, sf_dir))
    rows = counts.select("doc_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("part"))
    at = F.pmod(F.col("doc_id") + F.col("part") * 3, F.lit(len(SPECS))) + 1
    return rows.select("doc_id", "part", F.element_at(F.array(*map(F.lit, SPECS)), at.cast("int")).alias("spec"))


_BASE = f"""
with recursive pages as (select conv_id as doc_id, turn as page_index, cast(turn * 90 % 360 as int) as rotate, 0.0::double as x0, 0.0::double as y0,
    612.0 + turn as x1, 792.0::double as y1, text from conversations),
counts as (select doc_id, count(*)::int as n from pages group by 1),
lists as (select * from (values {_SPEC_ROWS}) t(k, spec)),
specs as (select doc_id, part, spec, n from counts, (select unnest([1, 2, 3]) as part), lists where k = (doc_id + part * 3) % {len(SPECS)}),
tokens as (select doc_id, part, spec, n, i, trim(string_split_regex(spec, '[,;]')[i]) as t from specs, unnest(range(1, 9)) u(i) where i <= len(string_split_regex(spec, '[,;]'))),
bits as (select *, regexp_matches(t, '(?i)^(\\d*)\\s*(?:(-|–|to)\\s*(\\d*))?$') as ok,
    regexp_extract(t, '(?i)^(\\d*)\\s*(?:(-|–|to)\\s*(\\d*))?$', 1) as a, regexp_extract(t, '(?i)^(\\d*)\\s*(?:(-|–|to)\\s*(\\d*))?$', 2) as d,
    regexp_extract(t, '(?i)^(\\d*)\\s*(?:(-|–|to)\\s*(\\d*))?$', 3) as b from tokens where t <> ''),
ends as (select *, coalesce(try_cast(a as int), 1) as f, case when d = '' then coalesce(try_cast(a as int), 1) when b = '' then n else try_cast(b as int) end as g from bits),
judged as (select *, case when not ok or (a = '' and b = '') then 'not a range' when f < 1 or g < 1 or f > n or g > n then 'outside' when f > g then 'backwards' end as error from ends),
errors as (select doc_id, part, any_value(spec) as spec, arg_min(error, i) filter (error is not null) as error from judged group by 1, 2),
listed as (select j.doc_id, j.part, j.i, p.page from judged j join errors e on j.doc_id = e.doc_id and j.part = e.part and e.error is null, unnest(range(j.f, j.g + 1)) p(page)),
parts as (select doc_id, part, row_number() over (partition by doc_id, part order by i, page) - 1 as ord, page from listed)
"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parts(doc_pages(spark, sf_dir), _specs(spark, sf_dir))


@query(_BASE + """select doc_id, part, 'p' || arg_min(page, ord) || case when count(*) > 1 then '-' || arg_max(page, ord) else '' end as label,
    count(*) as n_pages, sum(length(text))::bigint as n_chars from parts join pages using (doc_id) where page_index = page - 1 group by 1, 2""")
def split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split into parts by range expressions: label, pages and characters of every part."""
    part_pages = _parts(spark, sf_dir)
    pages = doc_pages(spark, sf_dir).select("doc_id", (F.col("page_index") + 1).alias("page"), "text")
    chars = part_pages.join(pages, ["doc_id", "page"]).groupBy("doc_id", "part").agg(F.sum(F.length("text")).alias("n_chars"))
    return P.part_labels(part_pages).join(chars, ["doc_id", "part"])


@query(_BASE + "select doc_id, part, spec, error from errors where error is not null")
def range_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range expressions that are refused, and why."""
    joined = _specs(spark, sf_dir).join(page_counts(doc_pages(spark, sf_dir)), "doc_id")
    _, error = P.parse_ranges(F.col("spec"), F.col("n_pages"))
    return joined.select("doc_id", "part", "spec", error.alias("error")).where("error is not null")


@query(_BASE + "select doc_id, part, ord, page from parts")
def range_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page list of every part, repeats kept."""
    return _parts(spark, sf_dir).withColumn("ord", F.col("ord").cast("long")).withColumn("page", F.col("page").cast("long"))


@query(_BASE + """select doc_id, page, string_agg(part, ',' order by part) as parts
    from (select distinct doc_id, page, part from parts) group by 1, 2 having count(*) > 1""")
def part_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are in more than one part."""
    return P.part_overlaps(_parts(spark, sf_dir)).withColumn("page", F.col("page").cast("long"))


@query(_BASE + """select p.doc_id, p.page_index + 1 as page from pages p
    where not exists (select 1 from parts q where q.doc_id = p.doc_id and q.page = p.page_index + 1)""")
def left_out_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are in no part."""
    return P.left_out(doc_pages(spark, sf_dir), _parts(spark, sf_dir)).withColumn("page", F.col("page").cast("long"))


@query(_BASE + """, u as (select distinct doc_id, page from parts), g as (select doc_id, page, page - row_number() over (partition by doc_id order by page) as k from u),
    s as (select doc_id, k, min(page) as a, max(page) as b from g group by 1, 2)
    select doc_id, string_agg(case when a = b then a::varchar else a || '-' || b end, ', ' order by a) as pages from s group by 1""")
def page_set_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages used by a document's parts as compact text."""
    return P.page_set_text(_parts(spark, sf_dir))


@query(_BASE + """, l as (select doc_id, part, max(page) as last from parts group by 1, 2)
    select doc_id, part, last, coalesce(lag(last) over (partition by doc_id order by part) + 1, 1) as start from l""")
def next_part_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a part that is filled in by itself starts."""
    return P.next_part_start(_parts(spark, sf_dir)).select("doc_id", "part", F.col("last").cast("long").alias("last"), F.col("start").cast("long").alias("start"))


@query("""with n as (select doc_id, source, case when doc_id % 3 = 0 then upper(source) else source end as stem from documents)
    select doc_id, source, case when k > 1 then stem || ' (' || k || ')' else stem end as file_name
    from (select *, row_number() over (partition by source, lower(stem) order by doc_id) as k from n)""")
def unique_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names made unique without regard to the case of letters."""
    stem = F.when(F.col("doc_id") % 3 == 0, F.upper("source")).otherwise(F.col("source"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", stem.alias("stem"))
    return docs.select("doc_id", "source", P.unique_names(docs, "source", "stem", "doc_id").alias("file_name"))


@query(_BASE + "select doc_id, page_index // 3 as part, count(*) as n_pages, min(page_index) as first_page, sum(length(text))::bigint as n_chars from pages group by 1, 2")
def split_every_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of three pages."""
    parts = P.every_n(doc_pages(spark, sf_dir), 3).groupBy("doc_id", "part")
    found = parts.agg(F.count(F.lit(1)).alias("n_pages"), F.min("page_index").cast("long").alias("first_page"), F.sum(F.length("text")).alias("n_chars"))
    return found.withColumn("part", F.col("part").cast("long"))


@query(_BASE + "select doc_id, page_index as part, 'p' || (page_index + 1) as label, length(text) as n_chars from pages")
def split_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part for each page."""
    return doc_pages(spark, sf_dir).select("doc_id", F.col("page_index").cast("long").alias("part"), F.concat(F.lit("p"), F.col("page_index") + 1).alias("label"), F.length("text").cast("long").alias("n_chars"))


@query(_BASE + """, m as (select doc_id, 0 as f, page_index, text from pages union all select doc_id, 1, page_index, text from pages where page_index % 2 = 0)
    select doc_id, f as file_no, page_index, row_number() over (partition by doc_id order by f, page_index) - 1 as merged_index, md5(text) as digest from m""")
def merge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document merged with its even pages."""
    pages = doc_pages(spark, sf_dir)
    merged = P.merge([pages, pages.where("page_index % 2 = 0")])
    return merged.select("doc_id", "file_no", F.col("page_index").cast("long").alias("page_index"), F.col("merged_index").cast("long").alias("merged_index"), F.md5("text").alias("digest"))


_ORDER = [(3, 0), (0, 0), (None, 0), (0, 90), (8, 0), (1, 180), (None, 0)]
_ORDER_ROWS = ", ".join(f"({k}, {'null' if i is None else i}, {t})" for k, (i, t) in enumerate(_ORDER))


@query(_BASE + f""", w as (select * from (values {_ORDER_ROWS}) t(ord, idx, turn)),
    s as (select c.doc_id, ord, idx, turn from counts c, w),
    j as (select s.*, p.rotate, case when p.doc_id is not null then p.x1 - p.x0 end as w, case when p.doc_id is not null then p.y1 - p.y0 end as h
          from s left join pages p on p.doc_id = s.doc_id and p.page_index = s.idx where s.idx is null or p.doc_id is not null),
    z as (select *, first_value(w ignore nulls) over a as wa, last_value(w ignore nulls) over b as wb, first_value(h ignore nulls) over a as ha, last_value(h ignore nulls) over b as hb,
          count(idx) over (partition by doc_id) as real, row_number() over (partition by doc_id order by ord) - 1 as position from j
          window a as (partition by doc_id order by ord rows between 1 following and unbounded following), b as (partition by doc_id order by ord rows between unbounded preceding and 1 preceding))
    select doc_id, position, idx::bigint as index, (coalesce(rotate, 0) + turn) % 360 as rotate, coalesce(w, wa, wb, 595.28) as w, coalesce(h, ha, hb, 841.89) as h from z where real > 0""")
def organize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages reordered, repeated, left out, turned, and blanks put in."""
    pages = doc_pages(spark, sf_dir)
    rows = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(i).cast("int").alias("index"), F.lit(t).alias("turn")) for k, (i, t) in enumerate(_ORDER)])
    specs = page_counts(pages).select("doc_id", F.inline(rows))
    done = P.organize(pages, specs)
    return done.select("doc_id", F.col("position").cast("long").alias("position"), F.col("index").cast("long").alias("index"), "rotate", "w", "h")


@query(_BASE + "select doc_id, page_index, (rotate + 90 + case when page_index % 3 = 0 then -180 else 0 end + 720) % 360 as rotate from pages")
def rotate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages turned by 90, every third one by -180 more."""
    pages = doc_pages(spark, sf_dir)
    turns = pages.where("page_index % 3 = 0").select("doc_id", "page_index", F.lit(-180).alias("turn"))
    return P.rotate(pages, turns, 90).select("doc_id", F.col("page_index").cast("long").alias("page_index"), "rotate")


@query(_BASE + """, s as (select *, case rotate when 90 then 28.346456692913385 when 180 then 56.69291338582677 when 270 then 85.03937007874016 else 113.38582677165354 end as l,
    case rotate when 90 then 56.69291338582677 when 180 then 85.03937007874016 when 270 then 113.38582677165354 else 28.346456692913385 end as t,
    case rotate when 90 then 85.03937007874016 when 180 then 113.38582677165354 when 270 then 28.346456692913385 else 56.69291338582677 end as r,
    case rotate when 90 then 113.38582677165354 when 180 then 28.346456692913385 when 270 then 56.69291338582677 else 85.03937007874016 end as b from pages)
    select doc_id, page_index, round(x0 + l, 4) as x0, round(y0 + b, 4) as y0, round(x0 + l + greatest(x1 - x0 - l - r, 1.0), 4) as x1, round(y0 + b + greatest(y1 - y0 - t - b, 1.0), 4) as y1 from s""")
def crop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10, 20, 30 and 40 mm cut off the top, right, bottom and left as displayed."""
    done = P.crop(doc_pages(spark, sf_dir), 10, 20, 30, 40)
    return done.select("doc_id", F.col("page_index").cast("long").alias("page_index"), *(F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("""with b as (select o_orderkey, 0.0::double as mx0, 0.0::double as my0, 612.0::double as mx1, 792.0::double as my1, (o_orderkey % 700)::double as cx0, (o_custkey % 400)::double as cy0,
        (o_orderkey % 700 + o_custkey % 50)::double as cx1, 900.0::double as cy1 from orders),
    c as (select *, greatest(mx0, cx0) as a, greatest(my0, cy0) as b, least(mx1, cx1) as c, least(my1, cy1) as d from b)
    select o_orderkey, case when s then mx0 else a end as x0, case when s then my0 else b end as y0, case when s then mx1 else c end as x1, case when s then my1 else d end as y1
    from (select *, c - a < 1 or d - b < 1 as s from c)""")
def visible_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible part of boxes cut at all sides, by order."""
    o = read(spark, sf_dir, "orders")
    media = tuple(F.lit(v) for v in (0.0, 0.0, 612.0, 792.0))
    left = (F.col("o_orderkey") % 700).cast("double")
    crop = (left, (F.col("o_custkey") % 400).cast("double"), (F.col("o_orderkey") % 700 + F.col("o_custkey") % 50).cast("double"), F.lit(900.0))
    return o.select("o_orderkey", P.visible_box(media, crop).alias("box")).select("o_orderkey", "box.*")


@query("""with i as (select p_partkey, p_size * 40.0 as w, p_retailprice as h from part),
    g as (select *, case when w > h then 841.89 else 595.28 end as page_w, case when w > h then 595.28 else 841.89 end as page_h from i),
    s as (select *, least(1.0, (page_w - 36) / w, (page_h - 36) / h) as k from g)
    select p_partkey, page_w::double as page_w, page_h::double as page_h, round(w * k, 2)::double as draw_w, round(h * k, 2)::double as draw_h, round((page_w - w * k) / 2, 2)::double as x, round((page_h - h * k) / 2, 2)::double as y from s""")
def images_to_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images on A4 pages."""
    images = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40.0).alias("w"), F.col("p_retailprice").alias("h"))
    placed = P.place_images(images)
    return placed.select("p_partkey", "page_w", "page_h", *(F.round(c, 2).alias(c) for c in ("draw_w", "draw_h", "x", "y")))


@query("""with i as (select p_partkey, p_size * 40.0::double as w, p_retailprice as h, case p_partkey % 3 when 0 then 'a4' when 1 then 'letter' else 'fit' end as s, case p_partkey // 3 % 3 when 0 then 'upright' when 1 then 'landscape' else 'auto' end as o, case p_partkey // 9 % 3 when 0 then 0.0 when 1 then 18.0 else 54.0 end::double as m from part),
    l as (select *, o = 'landscape' or o = 'auto' and w > h as lie, case s when 'a4' then 595.28 else 612.0 end::double as a, case s when 'a4' then 841.89 else 792.0 end::double as b, least(1.0, 841.89::double / greatest(w, h)) as k from i),
    g as (select *, case when s = 'fit' then w * k + 2 * m when lie then b else a end as page_w, case when s = 'fit' then h * k + 2 * m when lie then a else b end as page_h from l),
    z as (select *, least((page_w - 2 * m) / w, (page_h - 2 * m) / h) as f from g), d as (select *, case when s = 'fit' then f else least(f, 1.0) end as r from z)
    select p_partkey, round(page_w, 2) as page_w, round(page_h, 2) as page_h, round(w * r, 2) as draw_w, round(h * r, 2) as draw_h, round((page_w - w * r) / 2, 2) + 0.0::double as x, round((page_h - h * r) / 2, 2) + 0.0::double as y from d""")
def image_pages_by_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images on pages of three sizes, three orientations and three margins."""
    key = F.col("p_partkey")
    choice = lambda k, *of: F.element_at(F.array(*map(F.lit, of)), (F.floor(k) % len(of) + 1).cast("int"))
    images = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40.0).alias("w"), F.col("p_retailprice").alias("h"))
    placed = P.place_images_by(images, choice(key, "a4", "letter", "fit"), choice(key / 3, "upright", "landscape", "auto"), choice(key / 9, 0.0, 18.0, 54.0))
    return placed.select("p_partkey", *((F.round(c, 2) + 0.0).alias(c) for c in ("page_w", "page_h", "draw_w", "draw_h", "x", "y")))


@query("""with p as (select conv_id as doc_id, turn as page_index, 612.0::double + turn as w, 792.0::double as h, (turn * 90 % 360)::int as rotate from conversations)
    select doc_id, page_index, w, h, rotate from p where page_index >= doc_id % 3 and page_index < doc_id % 3 + 2""")
def page_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and rotation of two pages of every document, from one that its id chooses."""
    found = P.page_slice(doc_pages(spark, sf_dir), F.col("doc_id") % 3, F.lit(2))
    return found.select("doc_id", F.col("page_index").cast("long").alias("page_index"), "w", "h", "rotate")
