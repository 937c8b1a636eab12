"""Queries on files: ingest checks, folders, HTML pages, reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.layout import markdown
from quillspark.operators.order import ordered
from quillspark.plans.registry import query
from quillspark.sources.files import accepted, folder_size, html_blocks
from quillspark.sources.tables import read


@query("""with f as (select doc_id, case when doc_id % 3 = 0 then '%PDF-1.7 ' || text when doc_id % 3 = 1 then text || '%PDF' else text end as t from documents)
    select doc_id, case when strlen(t) = 0 then 'empty' when strlen(t) > 8000 then 'too large' when instr(hex(t[1:1024]), '25504446') = 0 or (doc_id % 3 = 1 and strlen(left(t, length(t) - 4)) > 1020) then 'not a document' end as reason from f""")
def ingest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files that are accepted or refused."""
    k = F.col("doc_id") % 3
    t = F.when(k == 0, F.concat(F.lit("%PDF-1.7 "), "text")).when(k == 1, F.concat("text", F.lit("%PDF"))).otherwise(F.col("text"))
    files = read(spark, sf_dir, "documents").select("doc_id", F.encode(t, "UTF-8").alias("content"))
    return accepted(files, "content", 8000).select("doc_id", "reason")


@query("""with u as (select array_to_string(string_split(url, '/')[1:3], '/') as folder, strlen(html) as n from pages) select folder, count(*) as files, sum(n)::bigint as bytes from u group by 1""")
def folder_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and bytes by site."""
    pages = read(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("length"))
    return folder_size(pages, "path", 3)


@query()
def html_to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, paragraphs, list items and cells of all pages."""
    return html_blocks(read(spark, sf_dir, "pages"), "page_id", "html")


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of all pages."""
    b = html_blocks(read(spark, sf_dir, "pages"), "page_id", "html")
    kind = F.when(F.col("kind") == "item", "list").otherwise(F.col("kind"))
    return markdown(b.withColumns({"kind": kind, "ordered": F.lit(False)}), "page_id", ["block"])


@query()
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as boxes of a page in reading order."""
    left, top = (F.col("l_suppkey") % 3) * 200.0, (F.col("l_partkey") % 40) * 18.0
    boxes = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("box"), left.alias("x0"), top.alias("y0"), (left + 40 + F.col("l_quantity") * 2).alias("x1"), (top + 11).alias("y1"), F.lit(11.0).alias("body")
    )
    return ordered(boxes, ["l_orderkey"], "box", "body")
