"""Queries on content streams and character maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import content as C
from quillspark.plans.registry import query
from quillspark.sources.tables import doc_lines, read


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as content streams: every line is a text object with a font, a place and a string, literal or hexadecimal."""
    n = F.col("line_no")
    escaped = F.regexp_replace("text", r"([\\()])", r"\\$1")
    shown = F.when(n % 2 == 0, F.concat(F.lit("("), escaped, F.lit(")"))).otherwise(F.concat(F.lit("<"), F.hex(F.encode("text", "UTF-8")), F.lit(">")))
    line = F.concat(F.lit("BT /F"), (n % 3).cast("string"), F.lit(" 11 Tf "), (n * 7 % 500).cast("string"), F.lit(" -"), (n % 90).cast("string"), F.lit(".5 Td "), shown, F.lit(" Tj ET\n"))
    return doc_lines(spark, sf_dir).groupBy("doc_id").agg(F.encode(F.array_join(F.sort_array(F.collect_list(F.struct("line_no", line.alias("x"))))["x"], ""), "UTF-8").alias("content"))


@query(r"""with s as (select doc_id, string_split(text, chr(10)) as t from documents), l as (select doc_id, unnest(t) as text, unnest(range(0, len(t))) as n from s),
    p as (select *, '/F' || n % 3 as font, n * 7 % 500 || '' as x, '-' || n % 90 || '.5' as y, case when n % 2 = 0 then '(' || regexp_replace(text, '([\\()])', '\\\1', 'g') || ')' else '<' || hex(encode(text)) || '>' end as shown from l),
    b as (select *, 3 + octet_length(encode(font)) + 6 as f, 3 + octet_length(encode(font)) + 7 as g from p), c as (select *, g + length(x) + 1 + length(y) + 3 as h from b), d as (select *, h + 1 + octet_length(encode(shown)) + 3 as i from c),
    o as (select *, coalesce(sum(i + 4) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0)::bigint as base from d)
    select doc_id, (n * 5 + j)::int as n, ['BT', 'Tf', 'Td', 'Tj', 'ET'][j + 1] as op, base + [0, 3, g, h + 1, i + 1][j + 1] as "start", base + [2, f, h, i, i + 3][j + 1] as "end",
      md5(case j when 1 then '"' || font || '", 11' when 2 then x || ', ' || (-(n % 90) - 0.5)::double when 3 then '{"s": "' || lower(hex(encode(text))) || '"}' else '' end) as digest from o, (select unnest(range(0, 5)) as j)""")
def content_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of all documents' content streams with their places."""
    rows = C.operations(_streams(spark, sf_dir), ["doc_id"], "content")
    return rows.select("doc_id", "n", "op", "start", "end", F.md5(F.array_join("args", ", ")).alias("digest"))


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A character map for each nation: letters moved on by its key, listed targets, a ligature, and codes of two bytes."""
    k = F.col("n_nationkey")
    moved = lambda a, b, by: F.concat(F.lit(f"<{a:02X}> <{b:02X}> <"), F.lpad(F.hex(F.lit(a) + by), 4, "0"), F.lit(">\n"))
    text = F.concat(
        F.lit("/CMapName /Made def % <00> no entry\n2 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange\n3 beginbfrange\n"), moved(0x20, 0x7E, k), moved(0x61, 0x7A, k * 0 + 0), F.lit("<8020> <807E> <0020>\n<30> <32> [<005A> <0058> <0059>]\nendbfrange\n"),
        F.lit("2 beginbfchar <43> <00660069> <8041> /alpha endbfchar\n1 begincidrange <00> <7F> 100 endcidrange"),
    )
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("map"), text.alias("text"))


def _strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names in codes of one byte, then their segments in codes of two."""
    wide = F.array_join(F.transform(F.split("c_mktsegment", ""), lambda c: F.concat(F.lit("80"), F.lpad(F.hex(F.ascii(c)), 2, "0"))), "")
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("map"), "c_custkey", F.unhex(F.concat(F.hex(F.encode("c_name", "UTF-8")), wide)).alias("content"))


@query("""with s as (select c_nationkey::bigint as map, c_custkey, string_split(c_name, '') as a, string_split(c_mktsegment, '') as b from customer),
    c as (select map, c_custkey, unnest(list_concat(list_transform(a, lambda c: ascii(c)), list_transform(b, lambda c: ascii(c) + 32768))) as code, unnest(range(0, len(a) + len(b))) as pos from s),
    r as (select n_nationkey::bigint as map, code, chr((code + case when code between 97 and 122 then 0 else n_nationkey end)::int) as t from nation, (select unnest(range(32, 127)) as code) where code not in (48, 49, 50, 67)
      union all select n_nationkey, 32768 + code, chr(code::int) from nation, (select unnest(range(32, 127)) as code) where code <> 65 union all select n_nationkey, 32833, 'alpha' from nation
      union all select n_nationkey, unnest([48, 49, 50, 67]), unnest(['Z', 'X', 'Y', 'fi']) from nation)
    select c.map, c.c_custkey, string_agg(coalesce(r.t, chr(65533)), '' order by pos) as text, count(*) as n_codes from c left join r on r.map = c.map and r.code = c.code group by 1, 2""")
def decoded_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of all customers as text, each by the character map of its nation."""
    return C.decoded(_strings(spark, sf_dir), _maps(spark, sf_dir), ["map"], "c_custkey", "content", "text")
