"""The editor's steps on pages that have their glyphs as lists, against those on rows; and what they shuffle."""

from pyspark.sql import functions as F

from quillspark.operators import editor as E
from quillspark.plans import QUERIES
from test_bounds import _shuffles
from test_editor import SCHEMA, pages


def test_pages_give_what_rows_give(spark):
    glyphs = spark.createDataFrame([*pages(), *((50, k, t, 3.0 * k, 0.0, 1.0, 0.0, 10.0, 3.0, 0, f, True) for k, (t, f) in enumerate([(" ", "R"), ("a", None), ("b", None), (None, "B"), ("\t", "B")]))], SCHEMA)
    chunked = E.glyph_chunks(glyphs, ["page"]).cache()
    lists = glyphs.groupBy("page").agg(F.collect_list(F.struct(*E.GLYPH)).alias("g"))
    lines = E.editor_lines(chunked, ["page"])
    for rows, found in ((E.chunk_lines(chunked, ["page"]), E.pages_chunks), (lines, E.pages_lines), (E.editor_blocks(lines, ["page"]), E.pages_blocks)):
        got = found(lists, ["page"], F.col("g"))
        assert got.dtypes == rows.dtypes
        assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.collect()))


def test_glyphs_of_pages_are_not_shuffled(spark, sf_dir):
    """Texts of documents are dealt once; glyphs, chunks and lines stay in Python until they are the result."""
    for name in ("editor_chunks", "editor_lines", "editor_blocks"):
        assert _shuffles(QUERIES[name](spark, sf_dir)) == 1, name
