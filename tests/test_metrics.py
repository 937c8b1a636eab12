"""Metrics of faces: from files, in sums, and where glyphs are missing."""

from pyspark.sql import functions as F

from quillspark.functions import metrics as M
from quillspark.operators import glyphs as O
from quillspark.sources.metrics import metrics_of_files, standard_metrics

FILE = """StartFontMetrics 4.1
C 32 ; WX 250 ; N space ; B 0 0 0 0 ;
C 39 ; WX 333 ; N quoteright ; B 1 2 3 4 ;
C 65 ; WX 722 ; N A ; B 15 0 706 674 ;
C 86 ; WX 722 ; N V ; B 16 0 697 662 ;
C -1 ; WX 722 ; N Aacute ; B 15 0 706 890 ;
C -1 ; WX 180 ; N quotesingle ; B 48 431 133 676 ;
C -1 ; WX 500 ; N Euro ; B 0 0 500 676 ;
C broken
KPX A V -135
KPX Aacute V -135
KPX A nothing -50
KPX V A x""".split("\n")


def test_metrics_of_files(spark):
    lines = spark.createDataFrame([("serif", t) for t in [*FILE, None]], "face string, line string")
    widths, pairs = metrics_of_files(lines, "face", "line")
    assert {r.ch: r.width for r in widths.collect()} == {" ": 250, "’": 333, "A": 722, "V": 722, "Á": 722, "'": 180}
    assert {r.pair: r.kern for r in pairs.collect()} == {"AV": -135, "ÁV": -135}
    texts = spark.createDataFrame([(1, "AV A", "serif", 10), (2, "", "serif", 10), (3, None, "serif", 10), (4, "A€", "serif", 10), (5, "A", "none", 10)], "id int, text string, face string, size int")
    got = {r.id: (round(r.width, 3), r.n_missing) for r in O.metric_widths(texts, ["id"], "text", "face", "size", widths, pairs, missing=500).collect()}
    assert got == {1: (22.81, 0), 2: (0.0, 0), 3: (0.0, 0), 4: (12.22, 1), 5: (5.0, 1)}


def test_large_metrics_are_joined_by_shuffle(spark, monkeypatch):
    widths, pairs = standard_metrics(spark)
    texts = spark.createDataFrame([(1, "AVATAR Tow", "sans", 12), (2, "iïÏ", "sans", 1000)], "id int, text string, face string, size int")
    sums = [sorted(map(tuple, O.metric_widths(texts, ["id"], "text", "face", "size", widths, pairs).collect()))]
    monkeypatch.setattr(O, "MOST_METRICS", 3)
    sums.append(sorted(map(tuple, O.metric_widths(texts, ["id"], "text", "face", "size", widths, pairs).collect())))
    own = M.glyphs("sans")
    by_hand = sum(own[c] for c in "AVATAR Tow") + sum(M.PAIRS.get(a + b, 0) for a, b in zip("AVATAR To", "VATAR Tow", strict=True))
    assert [round(w, 6) for _, w, _ in sums[0]] == [round(w, 6) for _, w, _ in sums[1]] == [round(by_hand * 0.012, 6), 222 + 278 + 278]


def test_every_face_has_all_of_ascii():
    for face, of in M.FACES.items():
        chars = "".join(of.values())
        assert len(chars) == len(set(chars)) and {chr(c) for c in range(32, 127)} <= set(chars), face


def test_measured_texts(spark):
    rows = spark.createDataFrame([("iW",), ("",), ("中",)], "t string")
    got = [r.w for r in rows.select(M.measured(F.col("t"), M.glyph_width("sans", 10.0)).alias("w")).collect()]
    assert [round(w, 6) for w in got] == [11.66, 0.0, 5.56]
