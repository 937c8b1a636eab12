"""Queries on Word documents: written from all documents' lines and orders, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.plans.registry import query
from quillspark.sources import word as W
from quillspark.sources.shared import shared_dir
from quillspark.sources.tables import doc_lines, partitions, read


def _blocks(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """Lines as blocks: by turns a heading, a paragraph, a bullet, a numbered item, a table of two rows, a paragraph."""
    n, k = F.col("line_no"), F.col("line_no") % 6
    turn = F.floor(n / 6).cast("int")
    first = F.regexp_extract("text", "^[^ ]* ?", 0)
    size = F.when(k == 0, 16.0).otherwise(11.0)
    run = lambda text, bold, italic: F.struct(text.alias("text"), F.lit(bold).alias("bold"), italic.alias("italic"), F.lit(False).alias("mono"), (turn % 2 == 1).alias("serif"), size.alias("size"))
    return doc_lines(spark, sf_dir, parts).where("text <> ''").select(
        "doc_id", "line_no", F.when(k == 0, "heading").when(k.isin(2, 3), "list").when(k == 4, "table").otherwise("paragraph").alias("kind"), (turn % 3 + 1).alias("level"),
        F.element_at(F.array(*map(F.lit, ("left", "right", "center", "justify"))), turn % 4 + 1).alias("align"), (k == 3).alias("ordered"), F.concat((n + 1).cast("string"), F.lit(".")).alias("marker"),
        F.array(run(first, True, F.lit(False)), run(F.expr("substring(text, length(regexp_extract(text, '^[^ ]* ?', 0)) + 1)"), False, n % 2 == 0)).alias("runs"),
        F.array(F.array(F.lit("no"), F.lit("text")), F.array(n.cast("string"), F.col("text"))).alias("rows"),
    )


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and texts of all documents written as Word files and read back.

    Documents are dealt twice, as texts and as XML, by the bytes of their texts: a file is some fifteen times its text and
    its tags many times that, so that a partition must not hold more of them as the table grows.
    """
    parts = partitions(read(spark, sf_dir, "documents"), "text")
    files = W.word_files(_blocks(spark, sf_dir, parts), ["doc_id"], "line_no")
    return W.word_tokens(W.word_parts(files, ["doc_id"], parts=parts), ["doc_id"])


_LINES = """with s as (select doc_id, string_split(text, chr(10)) as t from documents), every as (select doc_id, unnest(t) as text, unnest(range(0, len(t))) as line_no from s),
    l as (select *, line_no % 6 as k, line_no // 6 as turn, row_number() over w - 1 as n, count(*) filter (line_no % 6 = 4) over (w rows between unbounded preceding and 1 preceding) as nt,
      coalesce(sum(case line_no % 6 when 3 then 3 when 4 then 4 else 2 end) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as nr from every where text <> '' window w as (partition by doc_id order by line_no)),
    p as (select *, 1 as j from l where k <> 4 union all select l.*, j from l, (select unnest(range(1, 6)) as j) where k = 4)
"""


@query(_LINES + """select doc_id, (n + 4 * nt + j)::bigint as p, (n + nt + case when j = 5 then 1 else 0 end)::bigint as block, k = 4 and j < 5 as in_table, case when k = 4 and j < 5 then nt * 2 + (j + 1) // 2 end::bigint as row, case when k = 4 and j < 5 then nt * 4 + j end::bigint as cell,
    case when k = 0 then 'Heading' || (turn % 3 + 1) else '' end as style, case when k = 0 then turn % 3 + 1 end::int as level, case when k in (1, 5) then ['left', 'right', 'center', 'justify'][turn % 4 + 1] else 'left' end as align, 0.0::double as before, case when k in (2, 3) then 3.0 else 6.0 end::double as after,
    md5(case when k = 4 then case j when 1 then 'no' when 2 then 'text' when 3 then line_no::varchar when 4 then text else '' end when k = 3 then (line_no + 1) || '.' || chr(9) || text else text end) as digest from p""")
def word_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, also those in cells, of all documents written as Word files and read back."""
    found = W.word_paragraphs(_tokens(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", "p", "block", "in_table", "row", "cell", "style", "level", "align", "before", "after", F.md5("text").alias("digest"))


@query(_LINES + """, f as (select *, length(regexp_extract(text, '^[^ ]* ?')) as cut from p),
    r as (select doc_id, n + 4 * nt + j as p, nr + 1 as run, (line_no + 1) || '.' || chr(9) as text, false as bold, false as italic, 11.0 as size, null as color from f where k = 3
      union all select doc_id, n + 4 * nt + j, nr + case when k = 3 then 2 else 1 end, text[:cut], true, false, case when k = 0 then 16.0 else 11.0 end, case when k = 0 then '0F172A' end from f where k <> 4
      union all select doc_id, n + 4 * nt + j, nr + case when k = 3 then 3 else 2 end, text[cut + 1:], false, line_no % 2 = 0, case when k = 0 then 16.0 else 11.0 end, case when k = 0 then '0F172A' end from f where k <> 4
      union all select doc_id, n + 4 * nt + j, nr + j, case j when 1 then 'no' when 2 then 'text' when 3 then line_no::varchar else text end, j < 3, false, 10.0, null from f where k = 4 and j < 5)
    select doc_id, p::bigint as p, run::bigint as run, md5(text) as digest, bold, italic, size::double as size, color from r where text <> ''""")
def word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents written as Word files and read back."""
    return W.word_runs(_tokens(spark, sf_dir), ["doc_id"]).select("doc_id", "p", "run", F.md5("text").alias("digest"), "bold", "italic", "size", "color")


@query(_LINES + """select doc_id, (n + nt)::bigint as block, (nt * 2 + (j + 1) // 2)::bigint as row, (nt * 4 + j)::bigint as cell, null::varchar as fill, 'BFBFBF' as border, 0.5::double as border_width from p where k = 4 and j < 5""")
def word_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the tables of all documents written as Word files and read back."""
    return W.word_cells(_tokens(spark, sf_dir), ["doc_id"])


@query("""with o as (select o_custkey, o_orderkey, case when o_orderkey % 3 = 0 then o_orderkey % 30 + 6.0 + 0.5 * (o_orderkey % 2) end as size, case o_orderkey % 4 when 0 then true when 1 then false end as bold from orders)
    select o_custkey as book, 'S' || o_orderkey as style_id, last_value(size ignore nulls) over w::double as size, last_value(bold ignore nulls) over w as bold from o window w as (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row)""")
def word_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles of Word files, one for each of a customer's orders and based on the one before, with what they inherit."""
    shared_dir(spark)
    k = F.col("o_orderkey")
    name = F.concat(F.lit("S"), k.cast("string"))
    styles = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("book"), name.alias("style_id"), F.lag(name).over(Window.partitionBy("o_custkey").orderBy(k)).alias("based_on"),
        F.when(k % 3 == 0, k % 30 + 6.0 + 0.5 * (k % 2)).alias("size"), F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("bold"),
    )
    run = F.struct(F.lit("text").alias("text"), *(F.lit(False).alias(c) for c in ("bold", "italic", "mono", "serif")), F.lit(11.0).alias("size"))
    blocks = styles.select("book").distinct().select("book", F.lit(0).alias("place"), F.lit("paragraph").alias("kind"), F.lit(1).alias("level"), F.lit("left").alias("align"), F.lit(False).alias("ordered"), F.lit("").alias("marker"), F.array(run).alias("runs"), F.array(F.array(F.lit(""))).alias("rows"))
    parts = W.word_parts(W.word_files(blocks, ["book"], "place", styles=styles), ["book"])
    return W.inherited(W.word_styles(parts, ["book"]), ["book"], ["size", "bold"]).select("book", "style_id", "size", "bold")
