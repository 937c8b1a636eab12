"""Queries on images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import images as I
from quillspark.plans.registry import query
from quillspark.sources.tables import read


@query("""select p_partkey, case p_partkey % 4 when 0 then 'png' when 3 then null else 'jpeg' end as format, case when p_partkey % 4 = 3 or p_partkey % 20 = 1 then null else p_size * 100 + 7 end::bigint as width,
    case when p_partkey % 4 = 3 or p_partkey % 20 = 1 then null else p_partkey % 5000 + 1 end::bigint as height, case when p_partkey % 4 in (1, 2) then p_partkey % 8 + 1 else 1 end::int as orientation from part""")
def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and turns of an image for each part: PNG, JPEG in both byte orders, some of them cut off, and other data."""
    k, hex_ = F.col("p_partkey"), lambda v, n: F.lpad(F.hex(v), n, "0")
    w, h, turn = F.col("p_size") * 100 + 7, k % 5000 + 1, F.lpad(F.hex(k % 8 + 1), 2, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hex_(w, 8), hex_(h, 8), F.lit("0802000000"))
    little = F.concat(F.lit("49492A000800000001001201030001000000"), turn, F.lit("00000000000000"))
    big = F.concat(F.lit("4D4D002A00000008000101120003000000010"), F.lit("0"), turn, F.lit("000000000000"))
    exif = F.concat(F.lit("FFE10022457869660000"), F.when(k % 4 == 1, little).otherwise(big))
    frame = F.concat(F.when(k % 8 > 4, "FFC2").otherwise("FFC0"), F.lit("001108"), hex_(h, 4), hex_(w, 4), F.lit("03011100021101031101"))
    jpeg = F.concat(F.lit("FFD8"), exif, F.lit("FFDB0043" + "00" * 65), F.when(k % 20 == 1, "").otherwise(frame))
    data = F.when(k % 4 == 0, png).when(k % 4 == 3, F.hex(F.encode("p_name", "UTF-8"))).otherwise(jpeg)
    return I.image_headers(read(spark, sf_dir, "part").select("p_partkey", F.unhex(data).alias("content")), ["p_partkey"], "content")


@query("""with t as (select doc_id, string_split(hex(encode(text)), '') as x from documents), l as (select doc_id, x, len(x) // 2 as n, (len(x) // 2 + 63) // 64 as h from t),
    p as (select doc_id, h, unnest(range(0, h * 64)) as i, unnest(list_transform(range(0, h * 64), lambda i: case when i < n then 17 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) else 34 end)) as v from l),
    d as (select doc_id, i, 3 * abs(v - lag(v) over (partition by doc_id order by i)) as d from p where (i // 64) % greatest(h // 400, 1) = 0)
    select l.doc_id, coalesce(any_value(s.flat >= 0.6 and s.edges >= 0.003), false) as graphic, false as many_colors, true as grey from l left join (select doc_id, avg((d <= 8)::int) as flat, avg((d >= 150)::int) as edges from d where i % 64 > 0 group by 1) s on s.doc_id = l.doc_id group by 1""")
def image_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the bytes of documents, as grey images of 64 columns and sixteen shades, are drawings."""
    shades = F.regexp_replace(F.hex(F.encode("text", "UTF-8")), "(.).", "$1$1")
    filled = F.unhex(F.rpad(shades, (F.ceil(F.length(shades) / 128) * 128).cast("int"), "2"))
    images = read(spark, sf_dir, "documents").select("doc_id", F.lit(64).alias("w"), F.lit(1).alias("c"), filled.alias("px"))
    return I.image_kinds(images, ["doc_id"], "w", "c", "px")
