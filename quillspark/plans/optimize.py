"""Queries on equal streams, references, image sizes and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import optimize as O
from quillspark.operators import salvage as S
from quillspark.plans.registry import query
from quillspark.sources.shared import shared_dir
from quillspark.sources.tables import doc_lines, read, streams


@query("select doc_id, min(doc_id) over (partition by text) as canonical, count(*) over (partition by text) as copies, strlen(text) as n_bytes from documents")
def same_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the same bytes."""
    return O.same_streams(streams(spark, sf_dir), "doc_id", "content")


@query("""with recursive e as (select conv_id, turn as a, (turn * 3 + 1) % 7 as b from conversations union all select conv_id, turn, (turn + conv_id) % 5 from conversations where turn % 2 = 0),
    r as (select conv_id, 0::bigint as id from conversations group by 1 union select e.conv_id, e.b from r join e on r.conv_id = e.conv_id and r.id = e.a)
    select c.conv_id, c.turn as id from conversations c join r on c.conv_id = r.conv_id and c.turn = r.id""")
def reachable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that references lead to from the first one; references may be cyclic."""
    shared_dir(spark)
    c = read(spark, sf_dir, "conversations")
    a = c.select("conv_id", F.col("turn").alias("a"), ((F.col("turn") * 3 + 1) % 7).alias("b"))
    b = c.where("turn % 2 = 0").select("conv_id", F.col("turn").alias("a"), ((F.col("turn") + F.col("conv_id")) % 5).alias("b"))
    nodes = c.select("conv_id", F.col("turn").alias("id"))
    return O.reachable(nodes, a.unionByName(b), c.select("conv_id", F.lit(0).cast("long").alias("id")), ["conv_id"])


@query("select l_partkey, max(l_quantity) as shown_w, max(l_extendedprice / l_quantity) as shown_h, count(*) as uses from lineitem group by 1")
def shown_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest size at which each image is drawn."""
    g = read(spark, sf_dir, "lineitem").groupBy("l_partkey")
    return g.agg(F.max("l_quantity").alias("shown_w"), F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("shown_h"), F.count(F.lit(1)).alias("uses"))


_IMAGES = """with i as (select p_partkey as image_id, p_partkey - 1 as owner_id, p_size * 60 as w, (p_partkey % 90) * 20 as h, case when p_partkey % 3 = 0 then p_size * 9.0 end as shown_w,
    case when p_partkey % 3 = 0 then (p_partkey % 90) * 5.0 end as shown_h, p_size * 900 + p_partkey as n_bytes, p_partkey % 11 = 0 as stencil, p_partkey % 13 = 0 as color_key, p_partkey % 5 = 0 as graphic from part)
"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    own = k % 3 == 0
    return read(spark, sf_dir, "part").select(
        k.alias("image_id"), (k - 1).alias("owner_id"), (F.col("p_size") * 60).alias("w"), ((k % 90) * 20).alias("h"), F.when(own, F.col("p_size") * 9.0).alias("shown_w"), F.when(own, (k % 90) * 5.0).alias("shown_h"),
        (F.col("p_size") * 900 + k).alias("n_bytes"), (k % 11 == 0).alias("stencil"), (k % 13 == 0).alias("color_key"), (k % 5 == 0).alias("graphic"),
    )


@query(_IMAGES + """select i.image_id, i.n_bytes, coalesce(i.shown_w, o.shown_w)::double as shown_w, coalesce(i.shown_h, o.shown_h)::double as shown_h from i left join i o on o.image_id = i.owner_id
    where not i.stencil and not i.color_key and i.w >= 32 and i.h >= 32 and i.n_bytes >= 8000""")
def image_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images worth encoding anew."""
    return O.image_jobs(_images(spark, sf_dir)).select("image_id", "n_bytes", "shown_w", "shown_h")


@query(_IMAGES + """, d as (select *, case when graphic then greatest(150.0, least(210.0, 300.0)) else 150.0 end as dpi from i where h > 0),
    s as (select *, least(case when shown_w > 1 and shown_h > 1 then greatest(shown_w / 72 * dpi / w, shown_h / 72 * dpi / h) else 11.7 * dpi / greatest(w, h) end, 1.0)::double as k from d)
    select image_id, greatest(floor(w * k + 0.5), 16)::bigint as target_w, greatest(floor(h * k + 0.5), 16)::bigint as target_h from s""")
def image_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of images at the recommended resolution."""
    i = _images(spark, sf_dir).where("h > 0")
    w, h = O.target_dims(F.col("w").cast("double"), F.col("h").cast("double"), F.col("shown_w"), F.col("shown_h"), F.lit(O.PRESETS["recommended"][0]), F.col("graphic"))
    return i.select("image_id", w.cast("long").alias("target_w"), h.cast("long").alias("target_h"))


@query(_IMAGES + """, e as (select *, (image_id - 1) // 40 as file_id, (n_bytes * (85 + image_id % 30)) // 100 as e from i), k as (select *, case when e < n_bytes * 0.97 then e else n_bytes end as kept from e),
    f as (select file_id, sum(kept) < sum(n_bytes) as smaller from k group by 1)
    select image_id, file_id, n_bytes, e as encoded, kept, case when smaller then 'smaller' else 'unchanged' end as file from k join f using (file_id)""")
def keep_if_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded images kept below 97 % of the original, and files (of forty images) that did not get smaller."""
    i = _images(spark, sf_dir).withColumn("file_id", F.expr("(image_id - 1) div 40")).withColumn("encoded", F.expr("(n_bytes * (85 + image_id % 30)) div 100"))
    return O.kept_if_smaller(i, "file_id").select("image_id", "file_id", "n_bytes", "encoded", "kept", "file")


_RUNGS = ", ".join(f"({2 * k}, {d}::double, {q}::double)" for k, (d, q) in enumerate(O.COARSE)) + ", " + ", ".join(
    f"({2 * k + 1}, {float(int((d + O.COARSE[k + 1][0]) / 2 + 0.5))}::double, {int((q + O.COARSE[k + 1][1]) / 2 * 100 + 0.5) / 100}::double)" for k, (d, q) in enumerate(O.COARSE[:-1])
)


@query(f"""with r as (select * from (values {_RUNGS}) t(rung, dpi, quality)), i as (select l_orderkey, l_quantity * 20000 as n_bytes, l_extendedprice * 40 as pixels, 5000 as other_bytes from lineitem),
    e as (select l_orderkey, rung, floor(pixels * (dpi / 300) * (dpi / 300) * quality / 2) as size, n_bytes, other_bytes from i, r),
    t as (select l_orderkey, rung, sum(case when size < n_bytes * 0.97 then size else n_bytes end) + max(other_bytes) as total, 60000 + l_orderkey % 100 * 20000 as target from e group by l_orderkey, rung),
    f as (select l_orderkey, min(case when total <= target then rung end) as fit, max(rung) as last from t group by 1)
    select t.l_orderkey, t.rung, total::bigint as n_bytes, fit is not null as reached from t join f on t.l_orderkey = f.l_orderkey and t.rung = coalesce(fit, last)""")
def custom_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rung of the ladder with which every order, as a document of images, fits its target."""
    i = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") * 20000).alias("n_bytes"), (F.col("l_extendedprice") * 40).alias("pixels"), F.lit(5000).alias("other_bytes"))
    return O.custom_level(i, O.ladder(), "l_orderkey", 60000 + F.col("l_orderkey") % 100 * 20000)


@query("""select doc_id, case when n >= 1048576 then format('{:.2f}', floor(n * 100 / 1048576 + 0.5) / 100) || ' MB' else floor(n / 1024 + 0.5)::bigint || ' KB' end as size from (select doc_id, strlen(text) * 100 as n from documents)""")
def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as text."""
    return read(spark, sf_dir, "documents").select("doc_id", O.size_text(F.octet_length("text") * 100).alias("size"))


@query("""with p as (select c_custkey, c_custkey % 2 = 0 as a, c_custkey % 3 = 0 as b, c_custkey % 5 = 0 as c, c_custkey % 7 = 0 as d from customer),
    m as (select *, case when a then 4095 else 4095 - 4 - 2048 end as x, case when b then 4095 else 4095 - 8 - 1024 end as y, case when c then 4095 else 4095 - 16 - 512 end as z, case when d then 4095 else 4095 - 32 - 256 end as w from p)
    select c_custkey, ((-4::int) & ((-4096::int) | (x & y & z & w)))::int as bits from m""")
def permission_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permissions as bits."""
    k = F.col("c_custkey")
    allowed = {n: k % d == 0 for n, d in zip(O.PERMISSION_BITS, (2, 3, 5, 7), strict=True)}
    return read(spark, sf_dir, "customer").select("c_custkey", O.permission_bits(allowed).alias("bits"))


@query(_IMAGES + """, p as (select i.*, unnest([{'n': 'low', 'd': 220.0, 'q': 0.85}, {'n': 'recommended', 'd': 150.0, 'q': 0.72}, {'n': 'extreme', 'd': 96.0, 'q': 0.5}]) as p from i where h > 0),
    d as (select *, case when graphic then greatest(p.d::double, least(p.d::double * 1.4::double, 300.0::double)) else p.d::double end as dpi from p), s as (select *, least(case when shown_w > 1 and shown_h > 1 then greatest(shown_w / 72 * dpi / w, shown_h / 72 * dpi / h) else 11.7::double * dpi / greatest(w, h) end, 1.0)::double as k from d)
    select image_id, p.n as preset, p.q::double as quality, greatest(floor(w * k + 0.5), 16)::bigint as target_w, greatest(floor(h * k + 0.5), 16)::bigint as target_h from s""")
def preset_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels and quality of images by the three presets."""
    return O.preset_targets(_images(spark, sf_dir).where("h > 0"), "image_id")


@query("""with b as (select doc_id, coalesce(text, '') as t, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') as x from documents), n as (select *, len(x) as n from b),
    s as (select doc_id, n, x[1:65536] || x[greatest(n // 2 - 32768, 0) + 1:greatest(n // 2 - 32768, 0) + 65536] || x[greatest(n - 65536, 0) + 1:n] as x from n)
    select doc_id, n::bigint as n_bytes, list_reduce(list_prepend(2166136261::bigint, list_transform(x, lambda h: ('0x' || h)::bigint)), lambda a, b: (xor(a, b) * 16777619) & 4294967295::bigint) as sample from s""")
def sample_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the starts, middles and ends of documents, with their sizes: what tells most streams apart."""
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return read(spark, sf_dir, "documents").select("doc_id", F.octet_length(content).cast("long").alias("n_bytes"), O.sample_hash(content).alias("sample"))


@query("select doc_id, md5(text) as md5, sha256(text) as sha256 from documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from documents),
    g as (select doc_id, n, t, regexp_matches(t, '^[A-ZÀ-Þ][^|!*%]*[.]$') as good from l)
    select doc_id, n as object_no, row_number() over (partition by doc_id order by n) - 1 as page_index, md5(t) as digest from g where good""")
def salvaged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page trees rebuilt from the objects that are sound, in order of their numbers."""

    sound = doc_lines(spark, sf_dir).where(F.col("text").rlike("^[A-ZÀ-Þ][^|!*%]*[.]$"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
    return sound.select("doc_id", F.col("line_no").cast("long").alias("object_no"), place.cast("long").alias("page_index"), F.md5("text").alias("digest"))


@query("""with f as (select c_custkey, c_name as name, case c_custkey % 4 when 0 then 'text' when 1 then 'checkbox' when 2 then 'dropdown' else 'unsupported' end as kind, 1 + c_custkey % 20 as max_length from customer),
    v as (select c_custkey, case when c_custkey % 3 = 0 then c_mktsegment when c_custkey % 3 = 1 then 'true' else 'BUILDING' end as value from customer)
    select f.c_custkey, kind, case kind when 'text' then left(value, max_length) when 'checkbox' then case when value = 'true' then 'on' else 'off' end when 'dropdown' then case when value in ('BUILDING', 'MACHINERY', 'AUTOMOBILE') then value end end as filled,
    kind = 'unsupported' or (kind = 'dropdown' and value not in ('BUILDING', 'MACHINERY', 'AUTOMOBILE')) as failed from f join v using (c_custkey)""")
def form_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form fields filled by kind: texts cut to their length, choices checked, failures marked."""
    c = read(spark, sf_dir, "customer")
    m = F.col("c_custkey") % 4
    kind = F.when(m == 0, "text").when(m == 1, "checkbox").when(m == 2, "dropdown").otherwise("unsupported")
    fields = c.select("c_custkey", kind.alias("kind"), (1 + F.col("c_custkey") % 20).cast("int").alias("max_length"))
    v = F.col("c_custkey") % 3
    values = c.select("c_custkey", F.when(v == 0, F.col("c_mktsegment")).when(v == 1, "true").otherwise("BUILDING").alias("value"))
    listed = F.col("value").isin("BUILDING", "MACHINERY", "AUTOMOBILE")
    filled = F.when(F.col("kind") == "text", F.left("value", F.col("max_length"))).when(F.col("kind") == "checkbox", F.when(F.col("value") == "true", "on").otherwise("off")).when((F.col("kind") == "dropdown") & listed, F.col("value"))
    failed = (F.col("kind") == "unsupported") | ((F.col("kind") == "dropdown") & ~listed)
    return fields.join(values, "c_custkey").select("c_custkey", "kind", filled.alias("filled"), failed.alias("failed"))


@query("""with c as (select conv_id, turn, row_number() over w - 1 as i, count(*) over (partition by conv_id) as n from conversations window w as (partition by conv_id order by turn)),
    p as (select conv_id, 10 + i as number, i, i % 5 = 4 as lost from c where i % 7 <> 3)
    select conv_id, (row_number() over (partition by conv_id order by lost, i) - 1)::int as page_index, number::bigint as number, lost as attached from p""")
def rebuilt_page_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of damaged files, one for each conversation: a page for each turn, some cut off, some defined twice, some in no tree, a node without pages."""
    shared_dir(spark)
    w = Window.partitionBy("conv_id").orderBy("turn")
    i, text = F.row_number().over(w) - 1, F.regexp_replace("text", r"[^A-Za-z ]", "")
    page = lambda end: F.concat(F.lit("\n"), (F.col("i") + 10).cast("string"), F.lit(" 0 obj\n<< /Type /Page /Parent 2 0 R /T ("), F.col("t"), F.lit(f") >>{end}"))
    body = F.when(F.col("i") % 7 == 3, page("")).when(F.col("i") % 4 == 0, F.concat(page(" >> \nendobj"), page("\nendobj"), page(" ]\nendobj"))).otherwise(page("\nendobj"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", i.alias("i"), text.alias("t")).select("conv_id", "i", body.alias("body"))
    kid = F.concat((F.col("i") + 10).cast("string"), F.lit(" 0 R"))
    files = rows.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("i", "body")))["body"], "").alias("body"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("i") % 5 != 4, F.struct("i", kid.alias("k")))))["k"], " ").alias("kids"))
    head = F.concat(F.lit("%PDF-1.7\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R "), F.col("kids"), F.lit(" 999 0 R 2 0 R] >> endobj\n3 0 obj << /Type /Pages /Parent 2 0 R /Kids [4 0 R] >> endobj"))
    content = F.encode(F.concat(head, F.col("body"), F.lit("\n5 0 obj << /Length 9 >> stream\nq 1 0 0 1")), "ISO-8859-1")
    return S.rebuilt_pages(S.scanned_objects(files.select("conv_id", content.alias("content")), ["conv_id"], "content"), ["conv_id"])
