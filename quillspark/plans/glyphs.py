"""Queries on characters and their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import metrics as M
from quillspark.functions import text as T
from quillspark.operators import glyphs as O
from quillspark.operators import pages as P
from quillspark.plans.registry import query
from quillspark.sources.metrics import standard_metrics
from quillspark.sources.tables import doc_lines, doc_pages, read, sheet_lines

_CHARS = "with c as (select item_id, unnest(string_split(text, '')) as ch, generate_subscripts(string_split(text, ''), 1) - 1 as pos from benchmark)\n"


def _chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.characters(read(spark, sf_dir, "benchmark"), "item_id", "text")


@query(_CHARS + """, g as (select *, pos * 6.0 + case when ch = ' ' then 1 else 0 end as x, case when ch = ' ' then 4.0 else 6.0 end as w, case when pos % 97 = 0 then 'b' else 'a' end as font from c),
    n as (select *, case when lag(font) over o = font and x - (lag(x) over o + lag(w) over o) < 0.4 then 0 else 1 end as n from g window o as (partition by item_id order by pos)),
    r as (select *, sum(n) over (partition by item_id order by pos) - 1 as run from n)
    select item_id, run::bigint as run, string_agg(ch, '' order by pos) as text, min(x)::double as x, max(x + w)::double as x1 from r group by item_id, run""")
def glyph_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters joined into runs; a space leaves a gap behind it."""
    space = F.col("ch") == " "
    g = _chars(spark, sf_dir).withColumns({
        "x": F.col("pos") * 6.0 + F.when(space, 1).otherwise(0), "w": F.when(space, 4.0).otherwise(6.0), "y": F.lit(100.0), "size": F.lit(10.0), "font": F.when(F.col("pos") % 97 == 0, "b").otherwise("a"),
    })
    return O.glyph_runs(g, ["item_id"]).select("item_id", F.col("run").cast("long").alias("run"), "text", "x", "x1")


@query(_CHARS + r""", s as (select *, case when regexp_matches(ch, '[A-Za-z\x{00C0}-\x{024F}]') then 'latin' when regexp_matches(ch, '\p{L}') then 'other' end as own from (select item_id, pos, case when pos % 50 > 44 then 'я' else ch end as ch from c)),
    f as (select *, coalesce(last_value(own ignore nulls) over (partition by item_id order by pos rows between unbounded preceding and current row), 'latin') as script from s),
    k as (select *, case when lag(script) over (partition by item_id order by pos) <> script then 1 else 0 end as k from f), r as (select *, sum(k) over (partition by item_id order by pos) as run from k)
    select item_id, run::bigint as run, any_value(script) as script, count(*) as n_chars, min(pos) as start from r group by item_id, run""")
def script_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one script."""
    mixed = _chars(spark, sf_dir).withColumn("ch", F.when(F.col("pos") % 50 > 44, "я").otherwise(F.col("ch")))
    return O.script_runs(mixed, "item_id").select("item_id", F.col("run").cast("long").alias("run"), "script", "n_chars", F.col("start").cast("long").alias("start"))


@query(_CHARS + """, p as (select *, ch || coalesce(lead(ch) over (partition by item_id order by pos), '') as pair from c)
    select item_id, round(sum(case when regexp_matches(ch, '[ijl.,:;|!'' ]') then 0.28 when regexp_matches(ch, '[mwMW]') then 0.86 when regexp_matches(ch, '[A-Z]') then 0.68 else 0.54 end * 11 - case when pair in ('AV', 'VA', 'To', 'Te', 'Yo', 'LT') then 0.66 else 0 end), 3)::double as width from p group by 1""")
def text_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of texts at 11 points."""
    return O.text_widths(_chars(spark, sf_dir), "item_id", 11.0).withColumn("width", F.round("width", 3))


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
    f as (select *, lead(regexp_extract(t, '^\s*(\S*)', 1)) over (partition by doc_id order by line_no) as w from l)
    select doc_id, line_no, coalesce(length(t) + 1 + length(w) <= 400, true) as hard from f""")
def line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that end hard."""
    return O.line_ends(doc_lines(spark, sf_dir), "doc_id", 400).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "hard")


@query("""with p as (select conv_id, turn // 2 as part, 'p' || (min(turn) + 1) || case when count(*) > 1 then '-' || (max(turn) + 1) else '' end as label from conversations group by 1, 2),
    n as (select *, row_number() over (partition by conv_id order by part) as n, count(*) over (partition by conv_id) as total from p)
    select conv_id as doc_id, part, 'journal_' || lpad(n::varchar, length(total::varchar)::int, '0') || '_' || label || '.pdf' as file_name from n""")
def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of two-page parts in an archive."""
    parts = P.every_n(doc_pages(spark, sf_dir), 2).select("doc_id", "part", F.col("page_index").alias("ord"), (F.col("page_index") + 1).alias("page"))
    named = O.archive_names(P.part_labels(parts), "journal", "doc_id")
    return named.select("doc_id", F.col("part").cast("long").alias("part"), "file_name")


@query("""select p_partkey, round(least(greatest(p_size / 60.0 * 0.75 + p_partkey % 5 / 10.0, 0), 1) * 0.8 + 0.2, 6)::double as channel from part""")
def colour_shades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour channels with luminance and tint."""
    c = O.shade(F.col("p_size") / 60.0, F.lit(0.75), F.col("p_partkey") % 5 / 10.0, F.lit(0.8))
    return read(spark, sf_dir, "part").select("p_partkey", F.round(c, 6).alias("channel"))


@query("""with s as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as row, count(*) over (partition by l_orderkey) as n from lineitem)
    select l_orderkey, row, case when row = 0 then 'first_row' when row = n - 1 then 'last_row' when (row - 1) % 2 = 0 then 'band1' else 'band2' end as style from s""")
def table_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles of the rows of orders as tables."""
    from pyspark.sql import Window

    rows = sheet_lines(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")))
    return rows.select("l_orderkey", "row", O.row_style(F.col("row"), F.lit(1), F.col("n"), last_row=True).alias("style"))


_QUOTED = lambda t: "'" + t.replace("'", "''") + "'"
_GLYPHS = ", ".join(f"('{face}', {_QUOTED(ch)}, {w})" for face in M.FACES for ch, w in M.glyphs(face).items())
_KERNS = ", ".join(f"('{face}', '{pair}', {k})" for face in M.FACES if face != "mono" for pair, k in M.PAIRS.items())
_METRICS = f"g(face, ch, width) as (values {_GLYPHS}), k(face, pair, kern) as (values {_KERNS})"


@query(f"""with {_METRICS}, t as (select doc_id, case doc_id % 3 when 0 then 'sans' when 1 then 'sans_bold' else 'mono' end as face, 9 + doc_id % 4 as size, string_split(text, '') as a from documents where text <> ''),
    c as (select doc_id, face, size, unnest(a) as ch, unnest(list_zip(a, a[2:])) as z from t), p as (select doc_id, face, size, ch, ch || z[2] as pair from c)
    select doc_id, round(sum((coalesce(g.width, 556) + coalesce(k.kern, 0)) * size) / 1000.0::double, 4) as width, count(*) filter (where g.width is null) as n_missing from p left join g using (face, ch) left join k using (face, pair) group by 1
    union all select doc_id, 0.0, 0 from documents where coalesce(text, '') = ''""")
def metric_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of texts in three faces and four sizes, and how many characters the faces do not have."""
    face = F.when(F.col("doc_id") % 3 == 0, "sans").when(F.col("doc_id") % 3 == 1, "sans_bold").otherwise("mono")
    texts = read(spark, sf_dir, "documents").select("doc_id", "text", face.alias("face"), (9 + F.col("doc_id") % 4).alias("size"))
    return O.metric_widths(texts, ["doc_id"], "text", "face", "size", *standard_metrics(spark)).withColumn("width", F.round("width", 4))


@query(f"""with {_METRICS}, c as (select page_id, trim(regexp_replace(url, '\\s+', ' ', 'g')) as t from pages), e as (select page_id, t, unnest(range(1, len(t) + 1)) as n, unnest(string_split(t, '')) as ch from c),
    w as (select page_id, t, n, sum(coalesce(width, 556)) over (partition by page_id order by n) as used from e left join g on g.face = 'sans' and g.ch = e.ch),
    f as (select page_id, any_value(t) as t, max(used) as total, max(n) filter (where used + 1000 <= 16000) as n from w group by 1)
    select page_id, case when total <= 16000 then t else t[1:greatest(coalesce(n, 1), 1)] || '…' end as shown from f""")
def metric_ellipses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses cut to a column 144 points wide, at 9 points."""
    return read(spark, sf_dir, "pages").select("page_id", T.ellipsized(F.col("url"), F.lit(144.0 + 1e-9), M.glyph_width("sans", 9.0)).alias("shown"))


@query(f"""with {_METRICS}, l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
    e as (select doc_id, line_no, t, unnest(string_split(t, '')) as ch, unnest(range(1, greatest(len(t), 1) + 1)) as n from l), x as (select e.*, case when e.ch = '' then 0 else coalesce(width, 556) end as width, length(regexp_extract(t, '^\\s*', 0)) as s, length(regexp_extract(t, '^\\s*\\S*', 0)) as z from e left join g on g.face = 'sans_bold' and g.ch = e.ch),
    w as (select doc_id, line_no, sum(width) as own, coalesce(sum(width) filter (where n > s and n <= z), 0) as word from x group by 1, 2)
    select doc_id, line_no::bigint as line_no, coalesce(own + 278 + lead(word) over (partition by doc_id order by line_no) <= 40000, true) as hard from w""")
def measured_line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that end hard in a column 400 points wide, at 10 points."""
    lines = doc_lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text")
    return O.measured_line_ends(lines, "doc_id", 400.0 + 1e-9, M.glyph_width("sans_bold", 10.0)).select("doc_id", "line_no", "hard")
