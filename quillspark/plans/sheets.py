"""Queries on sheets, number formats and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import sheets as N
from quillspark.operators import sheets as O
from quillspark.plans.registry import query
from quillspark.sources.tables import read, sheet_lines


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sheets: a row per line, seven columns, some of them empty."""
    values = [F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_returnflag")), F.lit(""), F.col("l_linestatus"),
              F.when(F.col("l_orderkey") % 2 == 0, F.repeat(F.lit("w"), F.col("l_quantity").cast("int"))).otherwise(""), F.lit(" ")]
    return sheet_lines(spark, sf_dir).select("sheet", "row", F.posexplode(F.array(*values)).alias("col", "text"))


_CELLS = """with cells as (select sheet, row, unnest(range(0, 7)) as col, unnest([l_partkey::varchar, l_quantity::int::varchar, case when l_linenumber % 3 = 0 then '' else l_returnflag end, '', l_linestatus,
    case when l_orderkey % 2 = 0 then repeat('w', l_quantity::int) else '' end, ' ']) as text from (select *, l_orderkey as sheet, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as row from lineitem))
"""


@query(_CELLS + "select sheet, row::bigint as row, list(text order by col) as cells, null::varchar as error from cells group by 1, 2")
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense rows of all sheets."""
    return O.dense_rows(_cells(spark, sf_dir), ["sheet"])


@query(_CELLS + "select sheet, max(col) + 1 as used from cells where trim(text) <> '' group by 1")
def sheet_used_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in use."""
    return O.used_columns(_cells(spark, sf_dir), ["sheet"]).withColumn("used", F.col("used").cast("long"))


_WIDTHS = _CELLS + """, w as (select sheet, col, least(greatest(max(length(text)) * 4.5 + 8, 24.0), 220.0)::double as width from cells group by 1, 2),
    f as (select *, case when sum(width) over (partition by sheet) > 250 then greatest(6.0, 9.0 * 250 / sum(width) over (partition by sheet)) else 9.0 end::double as font_size from w),
    s as (select sheet, col, width * font_size / 9.0 as width, font_size from f)
"""


def _widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.fitted(O.column_widths(_cells(spark, sf_dir), ["sheet"]), ["sheet"], 250.0)


@query(_WIDTHS + "select sheet, col, round(width, 4) as width, round(font_size, 4) as font_size from s")
def sheet_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of columns and the font size that fits them to the page."""
    return _widths(spark, sf_dir).select("sheet", F.col("col").cast("long").alias("col"), F.round("width", 4).alias("width"), F.round("font_size", 4).alias("font_size"))


@query(_WIDTHS.replace("with cells", "with recursive cells") + """, b as (select sheet, 0::bigint as col, 0 as band, (select width from s s0 where s0.sheet = g.sheet and s0.col = 0) as used from (select distinct sheet from s) g
      union all select s.sheet, s.col, case when b.used > 0 and b.used + s.width > 120 then b.band + 1 else b.band end, case when b.used > 0 and b.used + s.width > 120 then s.width else b.used + s.width end from b join s on s.sheet = b.sheet and s.col = b.col + 1)
    select sheet, col, band from b""")
def sheet_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of columns that fit the page."""
    return O.column_bands(_widths(spark, sf_dir), ["sheet"], 120.0).select("sheet", F.col("col").cast("long").alias("col"), "band")


@query("""with n as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as n from orders),
    p as (select o_custkey, greatest(ceil((count(*) - 1) / 4.0), 1)::bigint as pages from n group by 1)
    select o_custkey, o_orderkey, (n - 1) // 4 as page, (n - 1) % 4 + 1 as place from n where n > 0
    union all select n.o_custkey, o_orderkey, unnest(range(0, pages)), 0 from n join p using (o_custkey) where n = 0""")
def sheet_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers on pages of five rows, the header repeated."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return O.row_pages(o, ["o_custkey"], "o_orderkey", 5).select("o_custkey", "o_orderkey", F.col("page").cast("long").alias("page"), F.col("place").cast("long").alias("place"))


@query(_CELLS + "select sheet, row::bigint as row, greatest(max(ceil(length(text) / 10.0)) * 11.0, 24.0)::double as height from cells group by 1, 2")
def table_row_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of rows by their tallest cell."""
    c = _cells(spark, sf_dir).withColumn("lines", F.ceil(F.length("text") / 10))
    return O.row_heights(c, ["sheet"], 11.0).select("sheet", F.col("row").cast("long").alias("row"), "height")


@query("""select l_orderkey, l_linenumber, format('{:.2f}', floor(l_extendedprice * 100 + 0.5) / 100) as plain, format('{:,.1f}', floor(l_extendedprice * 10 + 0.5) / 10) as thousands,
    format('{:.0f}', floor(l_discount * 100 + 0.5)) || '%' as percent, case when l_linenumber % 2 = 0 then '($' || format('{:.0f}', floor(l_extendedprice + 0.5)) || ')' else '$' || format('{:.0f}', floor(l_extendedprice + 0.5)) end as accounting from lineitem""")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in common formats."""
    p = F.col("l_extendedprice")
    signed = F.when(F.col("l_linenumber") % 2 == 0, -p).otherwise(p)
    money = N.number_format(F.abs(signed), 0, prefix="$")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", N.number_format(p, 2).alias("plain"), N.number_format(p, 1, thousands=True).alias("thousands"), N.number_format(F.col("l_discount"), 0, percent=True).alias("percent"),
        N.sectioned(signed, money, F.concat(F.lit("("), money, F.lit(")")), F.lit("-")).alias("accounting"),
    )


@query()
def exact_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two and no decimals of the exact binary values."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.fixed(2)("l_extendedprice").alias("two"), N.fixed(0)("l_extendedprice").alias("none"))


@query("""with k as (select event_id, (event_id * 7 % 18278)::int as k from events)
    select event_id, case when k >= 702 then chr(65 + ((k - 702) // 676)::int) else '' end || case when k >= 26 then chr(65 + ((k // 26 - 1) % 26)::int) else '' end || chr(65 + k % 26) as letters, k::bigint as back from k""")
def column_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of columns, and back."""
    e = read(spark, sf_dir, "events").withColumn("k", F.col("event_id") * 7 % 18278).withColumn("letters", N.column_letters(F.col("k")))
    return e.select("event_id", "letters", N.column_number(F.col("letters")).cast("long").alias("back"))


@query("""with s as (select l_orderkey, l_linenumber, l_partkey * 37 % 60000 + case when l_linenumber = 7 then 0.9999999999 else l_linenumber / 8.0 end::double as serial from lineitem),
    f as (select *, floor(serial)::bigint as whole, (serial - floor(serial)) * 86400 as sec from s), r as (select *, case when sec - floor(sec) > 0.9999 then floor(sec) + 1 else floor(sec) end::int as up from f),
    d as (select *, (whole + up // 86400)::int as d, up % 86400 as t from r)
    select l_orderkey, l_linenumber, case when d = 60 then '1900-02-29' when d = 0 then '1900-01-00' when d > 60 then strftime(date '1899-12-30' + d, '%Y-%m-%d') else strftime(date '1899-12-31' + d, '%Y-%m-%d') end as day,
    format('{:02d}:{:02d}:{:02d}', t // 3600, t % 3600 // 60, t % 60) as time from d""")
def serial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and times of serial numbers."""
    serial = F.col("l_partkey") * 37 % 60000 + F.when(F.col("l_linenumber") == 7, 0.9999999999).otherwise(F.col("l_linenumber") / 8)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.serial_date(serial).alias("day"), N.serial_time(serial).alias("time"))


@query("""with c as (select p_partkey, case p_partkey % 6 when 0 then 'yyyy-mm-dd' when 1 then '0.00' when 2 then '#,##0 "days"' when 3 then '[h]:mm:ss' when 4 then '[Red]0' else 'General' end as code from part)
    select p_partkey, code, code in ('yyyy-mm-dd', '[h]:mm:ss') as is_date from c""")
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which number formats show dates."""
    k = F.col("p_partkey") % 6
    code = F.when(k == 0, "yyyy-mm-dd").when(k == 1, "0.00").when(k == 2, '#,##0 "days"').when(k == 3, "[h]:mm:ss").when(k == 4, "[Red]0").otherwise("General")
    return read(spark, sf_dir, "part").select("p_partkey", code.alias("code")).withColumn("is_date", N.is_date_format(F.col("code")))


@query("select c_custkey, regexp_matches(trim(t), '^[-+(]?[$€£]?[0-9][0-9,. ]*%?\\)?$') as right_aligned from (select c_custkey, case when c_custkey % 3 = 0 then c_name else c_acctbal::varchar end as t from customer)")
def numeric_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells set to the right."""
    t = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.col("c_acctbal").cast("string"))
    return read(spark, sf_dir, "customer").select("c_custkey", N.looks_numeric(t).alias("right_aligned"))


@query("""with m as (select o_custkey, min(o_totalprice) - 200000 as lo, max(o_totalprice) as hi from orders group by 1), s as (select *, case when lo < 0 then lo else 0 end as a, greatest(hi, case when lo < 0 then lo else 0 end + 1e-9) as b from m),
    r as (select *, (b - a) / 10 as raw, pow(10, floor(log10((b - a) / 10))) as mag from s), t as (select *, mag * case when raw / mag <= 1 then 1 when raw / mag <= 2 then 2 when raw / mag <= 5 then 5 else 10 end as step from r)
    select o_custkey, round(floor(a / step) * step, 4)::double as axis_from, round(greatest(ceil(b / step) * step, floor(a / step) * step + step), 4)::double as axis_to, round(step, 4)::double as step from t""")
def chart_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of charts of customers' orders."""
    m = read(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.min("o_totalprice") - 200000).alias("lo"), F.max("o_totalprice").alias("hi"))
    a, b, step = O.nice_axis(F.col("lo"), F.col("hi"))
    return m.select("o_custkey", F.round(a, 4).alias("axis_from"), F.round(b, 4).alias("axis_to"), F.round(step, 4).alias("step"))


@query("""with s as (select l_returnflag, l_linestatus || l_linenumber as series, sum(l_quantity) as v from lineitem group by 1, 2)
    select l_returnflag, series, v, sum(v) over (partition by l_returnflag order by series) - v as base, sum(v) over (partition by l_returnflag order by series) as top, v / sum(v) over (partition by l_returnflag) as share from s""")
def stacked_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked bars, and stacked to a hundred percent."""
    s = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.concat("l_linestatus", "l_linenumber").alias("series")).agg(F.sum("l_quantity").alias("v"))
    return O.stacked(s, "l_returnflag", "series", "v")


@query("""with t as (select o_orderkey, o_totalprice as v from orders) select o_orderkey, regexp_replace(regexp_replace(format('{:.2f}', floor(v / 10 + 0.5) / 100), '0+$', ''), '\\.$', '') as plain,
    case when v >= 1000 then format('{:,d}', trunc(v)::bigint) else regexp_replace(regexp_replace(format('{:.2f}', v), '0+$', ''), '\\.$', '') end as thousands from t""")
def chart_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of axis values."""
    v = F.col("o_totalprice")
    return read(spark, sf_dir, "orders").select("o_orderkey", N.tick(F.floor(v / 10 + 0.5) / 100, "0").alias("plain"), N.tick(v, "#,##0").alias("thousands"))


@query("""with k as (select c_custkey, case c_custkey % 5 when 0 then 'arabicPeriod' when 1 then 'arabicParenBoth' when 2 then 'alphaUcPeriod' when 3 then 'alphaLcParenR' else 'arabicPlain' end as kind, (c_custkey % 300 + 1)::int as n from customer),
    a as (select *, case when n - 1 >= 26 then chr(97 + ((n - 1) // 26 - 1) % 26) else '' end || chr(97 + (n - 1) % 26) as al from k)
    select c_custkey, kind, case kind when 'arabicPeriod' then n || '.' when 'arabicParenBoth' then '(' || n || ')' when 'alphaUcPeriod' then upper(al) || '.' when 'alphaLcParenR' then al || ')' else n::varchar end as text from a""")
def list_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of lists by kind."""
    k = F.col("c_custkey") % 5
    kind = F.when(k == 0, "arabicPeriod").when(k == 1, "arabicParenBoth").when(k == 2, "alphaUcPeriod").when(k == 3, "alphaLcParenR").otherwise("arabicPlain")
    return read(spark, sf_dir, "customer").select("c_custkey", kind.alias("kind"), (F.col("c_custkey") % 300 + 1).alias("n")).select("c_custkey", "kind", N.list_number(F.col("kind"), F.col("n")).alias("text"))
