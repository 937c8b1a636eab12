"""Options of operators: comments of pages, sampled hashes, checksums, marks of redaction, pages of images."""

import zlib

from pyspark.sql import functions as F

from quillspark.operators import layout as L
from quillspark.operators import optimize as O
from quillspark.operators import pages as P
from quillspark.operators import text as T


def test_comments_of_pages(spark):
    rows = [(1, 0, 0, "heading", 1, None, "A"), (1, 0, 1, "list", None, False, "x"), (1, 1, 0, "list", None, False, "y"), (1, 3, 0, "paragraph", None, None, "z")]
    df = spark.createDataFrame(rows, "doc_id int, page int, place int, kind string, level int, ordered boolean, text string")
    got = {p: L.markdown(df, "doc_id", ["page", "place"], p).first().markdown for p in (None, "page")}
    assert got[None] == "# A\n\n- x\n- y\n\nz\n"
    assert got["page"] == "<!-- Page 1 -->\n\n# A\n\n- x\n\n<!-- Page 2 -->\n\n- y\n\n<!-- Page 4 -->\n\nz\n"


def fnv(data, window):
    n, h = len(data), 0x811C9DC5
    for at in (0, max(0, n // 2 - window // 2), max(0, n - window)):
        for b in data[at : at + window]:
            h = (h ^ b) * 16777619 % 2**32
    return h


def test_sampled_hashes(spark):
    data = [b"", b"a", bytes(range(256)), bytes(range(256)) * 3, b"\0\0\n\r", bytes(255 - k % 251 for k in range(1000))]
    df = spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(data)] + [(99, None)], "k int, d binary")
    got = {r.k: (r.s, r.c) for r in df.select("k", O.sample_hash(F.col("d"), 100).alias("s"), F.crc32("d").alias("c")).collect()}
    assert got.pop(99) == (None, None)
    assert got == {k: (fnv(d, 100), zlib.crc32(d)) for k, d in enumerate(data)}


def test_marks_of_redaction(spark):
    mail = "to a@b.cd now"
    pages = spark.createDataFrame([(1, 0, mail, "t"), (1, 1, mail, "t"), (1, 1, None, None), (2, 0, mail, "t"), (3, 0, "clean", "t")], "id int, page int, text string, title string")
    marks = spark.createDataFrame([(1, 1), (1, 1), (2, 7), (3, 0)], "id int, page int")
    got = sorted(map(tuple, T.redacted(pages, "id", "page", "text", marks, {"email": r"\S+@\S+"}, "#", metadata=("title",)).collect()), key=repr)
    assert got == sorted([(1, 0, mail, None, None), (1, 1, "to # now", None, None), (1, 1, None, None, None), (2, 0, None, None, T.NOTHING_MARKED), (3, 0, "clean", None, None)], key=repr)
    assert T.redacted(pages.limit(0), "id", "page", "text", marks).collect() == []


def test_pages_of_images(spark):
    rows = [("a4", "auto", 100.0, 50.0, 0.0), ("letter", "landscape", 2000.0, 1000.0, 18.0), ("fit", "auto", 1683.78, 400.0, 54.0), ("fit", "upright", 100.0, 40.0, 0.0), ("a5", "auto", 10.0, 10.0, 0.0), ("a4", "auto", 0.0, 10.0, 0.0)]
    df = spark.createDataFrame(rows, "size string, way string, w double, h double, m double")
    got = [[None if v is None else round(v, 2) for v in r] for r in P.place_images_by(df, F.col("size"), F.col("way"), F.col("m")).select("page_w", "page_h", "draw_w", "draw_h", "x", "y").collect()]
    assert got[:4] == [[841.89, 595.28, 100.0, 50.0, 370.94, 272.64], [792.0, 612.0, 756.0, 378.0, 18.0, 117.0], [949.89, 308.0, 841.89, 200.0, 54.0, 54.0], [100.0, 40.0, 100.0, 40.0, 0.0, 0.0]]
    assert got[4] == [None] * 6 and got[5] == [None] * 6
