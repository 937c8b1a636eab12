"""Queries on text: words, search, redaction, comparison, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import text as O
from quillspark.plans.registry import query
from quillspark.sources.tables import doc_lines, read
from quillspark.sources.tables import words as all_words

_GAP = r"[ \t\n\x0B\f\r]+"
_WORDS = f"list_filter(string_split_regex(text, '{_GAP}'), lambda x: x <> '')"
_PHONE, _NUMBER = T.PRESETS["phone"], T.PRESETS["number"]
_EMAIL = T.PRESETS["email"]


@query("select doc_id, md5(regexp_replace(text, '([\\\\`*_\\[\\]#|<>])', '\\\\\\1', 'g')) as digest from documents")
def escape_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with the characters of Markdown escaped."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.escape_markdown(F.col("text"))).alias("digest"))


@query("select page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) as digest, true as round_trip from pages")
def escape_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages escaped for XML, and whether unescaping gives them back."""
    escaped = read(spark, sf_dir, "pages").withColumn("e", T.escape_xml(F.col("html")))
    return escaped.select("page_id", F.md5("e").alias("digest"), (T.unescape_xml(F.col("e")) == F.col("html")).alias("round_trip"))


@query(f"select doc_id, len(w) as n_words, len(list_distinct(w)) as n_distinct, list_max(list_transform(w, lambda x: length(x))) as longest from (select doc_id, {_WORDS} as w from documents)")
def word_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document."""
    w = all_words(spark, sf_dir).groupBy("doc_id")
    return w.agg(F.count(F.lit(1)).alias("n_words"), F.countDistinct("text").alias("n_distinct"), F.max(F.length("text")).cast("long").alias("longest"))


@query("""with w as (select unnest(list_filter(string_split_regex(replace(replace(text, 'th', '’'), 'on', '“'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) as t from documents),
    n as (select translate(t, '‘’“”' || chr(173), '''''""') as word from w)
    select word, count(*) as n from n group by 1""")
def comparable_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words after normalisation of quotes, with their numbers."""
    text = F.replace(F.replace(F.col("text"), F.lit("th"), F.lit("’")), F.lit("on"), F.lit("“"))
    split = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+", -1), lambda x: x != "")
    words = read(spark, sf_dir, "documents").select(F.explode(split).alias("t")).select(T.comparable(F.col("t")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _versions(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    """Neighbouring turns of conversations as two versions of a text (columns a and b)."""
    c = read(spark, sf_dir, "conversations")
    prepared = F.filter(F.split("text", _GAP, -1), lambda x: x != "") if split else F.col("text")
    a = c.select("conv_id", "turn", prepared.alias("a"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), prepared.alias("b"))
    return a.join(b, ["conv_id", "turn"])


@query(f"""with w as (select conv_id, turn, {_WORDS} as w from conversations),
    p as (select a.conv_id, a.turn, a.w as a, b.w as b, least(len(a.w), len(b.w)) as m from w a join w b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
    q as (select *, coalesce(list_filter(range(1, m + 1), lambda i: a[i] <> b[i])[1] - 1, m) as prefix from p)
    select conv_id, turn, prefix, coalesce(list_filter(range(1, m - prefix + 1), lambda i: a[-i] <> b[-i])[1] - 1, m - prefix) as suffix from q""")
def common_affixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that two versions have in common at the start and at the end."""
    v = _versions(spark, sf_dir, split=True)
    found = O.common_affixes(v.select("conv_id", "turn", "a"), v.select("conv_id", "turn", "b"), ["conv_id", "turn"])
    return found.select("conv_id", "turn", F.col("prefix").cast("long").alias("prefix"), F.col("suffix").cast("long").alias("suffix"))


@query()
def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest word differences of neighbouring turns."""
    return O.word_diff(_versions(spark, sf_dir), ["conv_id", "turn"])


@query()
def word_diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes, words inserted and deleted of every pair of versions."""
    return O.diff_stats(O.word_diff(_versions(spark, sf_dir), ["conv_id", "turn"], texts=False), ["conv_id", "turn"])


@query()
def word_diff_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differences with long equal runs folded."""
    return O.diff_context(O.word_diff(_versions(spark, sf_dir), ["conv_id", "turn"]))


@query(f"""with c as (select doc_id, unnest([struct_pack(preset := 'email', n := len(regexp_extract_all(text, '{_EMAIL}'))), struct_pack(preset := 'phone', n := len(regexp_extract_all(text, '{_PHONE}'))),
    struct_pack(preset := 'number', n := len(regexp_extract_all(text, '{_NUMBER}')))]) as s from documents) select doc_id, s.preset, s.n from c where s.n > 0""")
def redaction_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the three presets by document."""
    return O.search_counts(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{_EMAIL}', '█', 'g'), '{_PHONE}', '█', 'g'), '{_NUMBER}', '█', 'g')) as digest from documents")
def redaction_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with all matches masked."""
    return O.masked(read(spark, sf_dir, "documents"), "text").select("doc_id", F.md5("text").alias("digest"))


@query(f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
    m as (select doc_id, line_no, t, regexp_extract_all(t, '{_EMAIL}') as f, string_split_regex(t, '{_EMAIL}') as r from l),
    s as (select doc_id, line_no, length(t) as n, unnest(range(1, len(f) + 1)) as k, f, r from m),
    e as (select doc_id, line_no, n, list_sum(list_transform(r[1:k], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(f[1:k - 1], lambda x: length(x)))::bigint, 0) as a, length(f[k]) as z from s)
    select doc_id, line_no, a as start, a + z as end, round(5.5 * a - 1, 3) as box_x, round(line_no * 20.0 - 11, 3)::double as box_y, round(5.5 * z + 2, 3)::double as box_w, 13.2::double as box_h from e""")
def redaction_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes over the e-mail addresses of lines set at 11 points, half a size for each character."""
    lines = doc_lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text")
    spans = O.match_spans(lines.withColumn("key", F.struct("doc_id", "line_no")), "key", "text", _EMAIL).select("key.*", "start", "end")
    runs = lines.select("doc_id", "line_no", F.lit(0.0).alias("x"), (F.col("line_no") * 20.0).alias("y"), (F.length("text") * 5.5).alias("w"), F.length("text").alias("n_chars"), F.lit(11.0).alias("size"))
    boxes = O.match_boxes(spans, runs.where("n_chars > 0"), ["doc_id", "line_no"])
    return boxes.select("doc_id", "line_no", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), *(F.round(c, 3).alias(c) for c in ("box_x", "box_y", "box_w", "box_h")))


@query(f"""with c as (select *, conv_id % 4 <> 1 and (turn + conv_id) % 2 = 0 as marked from conversations), r as (select *, bool_or(marked) over (partition by conv_id) as ok from c)
    select conv_id, turn, case when ok then md5(case when marked then regexp_replace(regexp_replace(regexp_replace(text, '{_EMAIL}', '█', 'g'), '{_PHONE}', '█', 'g'), '{_NUMBER}', '█', 'g') else text end) end as digest, case when ok then null else 'nothing marked' end as error from r""")
def redacted_marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with every other turn marked for redaction, a quarter of them without any mark."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    marks = c.where((F.col("conv_id") % 4 != 1) & ((F.col("turn") + F.col("conv_id")) % 2 == 0))
    return O.redacted(c, "conv_id", "turn", "text", marks).select("conv_id", "turn", F.md5("text").alias("digest"), "error")


@query("""select doc_id, a::bigint as with_case, b::bigint as without_case from (select doc_id, (length(text) - length(replace(text, 'The.', ''))) // 4 as a, (length(text) - length(replace(replace(lower(text), chr(775), ''), 'the.', ''))) // 4 as b from documents) where b > 0""")
def literal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of words that are typed in, marks meant as they are, with and without regard to case."""
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")
    found = read(spark, sf_dir, "documents").select("doc_id", count(O.literal(" The. ", True)).alias("with_case"), count(O.literal("The.")).alias("without_case"))
    return found.where("without_case > 0")


@query(f"select distinct conv_id, turn from conversations where regexp_matches(text, '{_NUMBER}')")
def redacted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that have anything to redact."""
    return read(spark, sf_dir, "conversations").where(F.col("text").rlike(_NUMBER)).select("conv_id", "turn").distinct()


_CELL = """case l_orderkey % 8 when 0 then '(' || l_quantity::int || ')' when 1 then l_quantity::int || '%' when 2 then '$' || l_quantity::int || '.5' when 3 then '00' || l_linenumber
    when 4 then '1,' || (100 + l_quantity::int) || '.25' when 5 then '-' || l_quantity::int when 6 then l_returnflag || l_linenumber else ' ' || l_quantity::int || ' ' end"""


@query(f"""with c as (select l_orderkey, l_linenumber, {_CELL} as cell from lineitem), t as (select *, trim(cell) as t from c)
    select l_orderkey, l_linenumber, cell, case when regexp_matches(t, '{T.NUMBER}') and not regexp_matches(t, '{T.CODE}') then
        case when t like '(%' or t like '-%' then -1.0 else 1.0 end::double * try_cast(regexp_replace(t, '[^0-9.]', '', 'g') as double) / case when t like '%\\%' escape '\\' then 100.0 else 1.0 end::double end as value from t""")
def numeric_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers recovered from the text of cells."""
    q, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_orderkey") % 8
    cell = (
        F.when(k == 0, F.concat(F.lit("("), q, F.lit(")"))).when(k == 1, F.concat(q, F.lit("%"))).when(k == 2, F.concat(F.lit("$"), q, F.lit(".5")))
        .when(k == 3, F.concat(F.lit("00"), "l_linenumber")).when(k == 4, F.concat(F.lit("1,"), F.col("l_quantity").cast("int") + 100, F.lit(".25")))
        .when(k == 5, F.concat(F.lit("-"), q)).when(k == 6, F.concat("l_returnflag", "l_linenumber")).otherwise(F.concat(F.lit(" "), q, F.lit(" ")))
    )
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("cell")).withColumn("value", T.recovered_number(F.col("cell")))


@query("""with f as (select page_id, regexp_replace(url, '[?#].*$', '') as name from pages)
    select page_id, regexp_replace(name, '\\.[^/.]+$', '') as base, lower(regexp_extract(name, '\\.([^/.]+)$', 1)) as extension,
    trim(regexp_replace(regexp_replace(name, '[\\\\/:*?"<>|\\x00-\\x1F]+', ' ', 'g'), '\\s+', ' ', 'g')) as clean from f""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs as file names: base, extension, cleaned."""
    f = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("name"))
    return f.select("page_id", T.file_base(F.col("name")).alias("base"), T.file_extension(F.col("name")).alias("extension"), T.clean_file_name(F.col("name")).alias("clean"))


@query("""select case when regexp_matches(text, '[\\x{0900}-\\x{097F}]') then 'devanagari' when regexp_matches(text, '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]') then 'cjk' else 'latin' end as face,
    not regexp_matches(text, '[^\\x20-\\x7E\\x{00A0}-\\x{00FF}]') as western, lang, count(*) as n from documents group by all""")
def font_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which face documents need, and whether a western encoding holds them."""
    d = read(spark, sf_dir, "documents").select(T.font_face(F.col("text")).alias("face"), T.western(F.col("text")).alias("western"), "lang")
    return d.groupBy("face", "western", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("""with m as (select event_id, case event_id % 6 when 0 then 'Invalid XRef entry' when 1 then 'Array buffer allocation failed' when 2 then 'File not found' when 3 then 'Password required'
    when 4 then 'The file is corrupt' else event_type end as message from events)
    select case when regexp_matches(lower(message), 'password|encrypt') then 'locked' when regexp_matches(lower(message), 'not found|no longer|moved or deleted|permission') then 'gone'
    when regexp_matches(lower(message), 'memory|allocation|too large') then 'memory' when regexp_matches(lower(message), 'invalid|corrupt|damaged|xref|parse') then 'damaged' else 'other' end as class, count(*) as n from m group by 1""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of failed jobs by class."""
    k = F.col("event_id") % 6
    message = F.when(k == 0, "Invalid XRef entry").when(k == 1, "Array buffer allocation failed").when(k == 2, "File not found").when(k == 3, "Password required").when(k == 4, "The file is corrupt").otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").select(T.error_class(message).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("""with a as (select conv_id, turn, text from conversations), b as (select conv_id - 1 as conv_id, turn, text from conversations),
    j as (select coalesce(a.conv_id, b.conv_id) as conv_id, coalesce(a.turn, b.turn) as page_index, a.text as a, b.text as b from a full join b on a.conv_id = b.conv_id and a.turn = b.turn)
    select conv_id, page_index, case when a is null then 'added' when b is null then 'removed' when a = b then 'same' else 'changed' end as state from j""")
def page_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a document and of the next one side by side."""
    c = read(spark, sf_dir, "conversations")
    a = c.select("conv_id", F.col("turn").alias("page_index"), "text")
    b = c.select((F.col("conv_id") - 1).alias("conv_id"), F.col("turn").alias("page_index"), "text")
    return O.aligned_pages(a, b, "conv_id").select("conv_id", "page_index", "state")


@query("""select item_id, md5(replace(regexp_replace(regexp_replace(text, '(\\w{3})(\\w{3}) ', '\\1-' || chr(10) || '\\2 ', 'g'), '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g'), chr(10), ' ')) as digest from benchmark""")
def dehyphenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut inside words and joined again."""
    cut = F.regexp_replace("text", r"([A-Za-z0-9_]{3})([A-Za-z0-9_]{3}) ", "$1-\n$2 ")
    return read(spark, sf_dir, "benchmark").select("item_id", F.md5(T.dehyphenated(cut)).alias("digest"))


@query("select doc_id, length_grapheme(text) as n_graphemes, length(text) as n_chars from documents")
def grapheme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters as a reader counts them, and code points."""
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.graphemes(F.col("text"))).cast("long").alias("n_graphemes"), F.length("text").cast("long").alias("n_chars"))


@query("""with c as (select conv_id, string_agg(role || ' ' || text, ' ' order by turn) as t from conversations group by 1), s as (select conv_id, unnest(string_split(t, '')) as ch, generate_subscripts(string_split(t, ''), 1) as k from c),
    f as (select conv_id, ch, min(k) as k from s group by 1, 2) select conv_id, string_agg(ch, '' order by k) as characters from f group by 1""")
def collected_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All characters of a document's texts, for the choice of faces."""
    own = T.distinct_characters(F.concat(F.when(F.col("turn") > F.min("turn").over(Window.partitionBy("conv_id")), " ").otherwise(""), F.col("role"), F.lit(" "), F.col("text")))
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", own.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "t"))).alias("s"))
    return c.select("conv_id", T.distinct_characters(F.array_join(F.col("s.t"), "")).alias("characters"))


@query("""with c as (select page_id, trim(regexp_replace(url, '\\s+', ' ', 'g')) as t from pages), w as (select page_id, t, list_transform(string_split(t, ''), lambda c: case when regexp_matches(c, '[ijl.,:;|!'' ]') then 3.0 when regexp_matches(c, '[mwMW]') then 9.0 else 6.0 end::double) as w from c),
    k as (select page_id, t, list_sum(w) as total, list_max(list_filter(range(0, len(w) + 1), lambda n: 6.0 + coalesce(list_sum(w[1:n]), 0) <= 150)) as n from w)
    select page_id, case when total <= 150 then t else t[1:greatest(n, 1)] || '…' end as shown from k""")
def ellipsized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to a column's width."""
    width = lambda c: F.when(c.rlike("[ijl.,:;|!' ]"), 3.0).when(c.rlike("[mwMW]"), 9.0).otherwise(6.0)
    return read(spark, sf_dir, "pages").select("page_id", T.ellipsized(F.col("url"), F.lit(150.0), width).alias("shown"))
