"""What keeps queries within memory and disk as tables grow: small slices in Python, partitions by size, few shuffles."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions import slices
from quillspark.operators import glyphs
from quillspark.operators import tables as found_tables
from quillspark.plans import QUERIES
from quillspark.sources import files, slides, tables
from quillspark.sources.metrics import standard_metrics


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_slices_are_small_and_complete(monkeypatch):
    monkeypatch.setattr(slices, "SLICE", 4000)
    seen = []

    @slices.sliced
    def lengths(a, b):
        seen.append(a.nbytes + b.nbytes)
        return pa.array([len(x) + len(y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())

    rows = [["x" * (k % 50)] * (k % 7) for k in range(300)]
    found = lengths(pa.array(rows), pa.array(rows))
    assert found.to_pylist() == [2 * len(r) for r in rows]
    assert len(seen) > 10 and max(seen) <= 4000
    assert lengths(pa.array([], pa.list_(pa.string())), pa.array([], pa.list_(pa.string()))).to_pylist() == []


def test_partitions_of_words_grow_with_the_texts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tables, "TEXT_BYTES", 10_000)
    docs = tables.read(spark, sf_dir, "documents")
    size = sum(len((r.text or "").encode()) for r in docs.select("text").collect())
    assert tables.runs(spark, sf_dir).rdd.getNumPartitions() == -(-size // 10_000)


def test_words_are_shuffled_once_after_each_fold(spark, sf_dir):
    """Documents are dealt before they are words, and pages after every step in Python; nothing else is shuffled."""
    for name, most in {"text_lines": 2, "line_segments": 2, "editor_chunks": 3, "editor_lines": 3, "editor_blocks": 3}.items():
        assert _shuffles(QUERIES[name](spark, sf_dir)) <= most, name


def test_tags_of_slides_are_not_shuffled(spark):
    """Parts are dealt before they are tags, and a package of many parts comes out whole."""
    parts = spark.createDataFrame([(1, "ppt/presentation.xml", "<p:presentation/>"), *((1, f"ppt/slides/slide{k}.xml", f"<p:sld n='{k}'>{'x' * 5000}</p:sld>") for k in range(700))], "deck long, part string, xml string")
    back = slides.slide_parts(slides.packages(parts, ["deck"]), ["deck"])
    assert sorted(map(tuple, back.select("deck", "part", "xml").collect())) == sorted(map(tuple, parts.collect()))
    plan = slides.slide_tokens(back, ["deck"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Exchange hashpartitioning(deck")


def test_columns_are_looked_up_and_not_tried_one_by_one():
    """The same column as by trying all, and a number of steps that hardly grows with the columns of a line."""
    rng = random.Random(7)
    for n in (1, 2, 5, 40):
        for _ in range(300):
            edges = sorted(rng.choice((rng.randrange(60), rng.random() * 60)) for _ in range(2 * n))
            columns = found_tables._united([(float(a), float(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)])
            x0 = rng.choice((float(rng.randrange(-5, 65)), rng.random() * 60))
            x1, tolerance = x0 + rng.choice((0.0, 1.0, 2.5, 30.0)), rng.choice((0.4, 1.0, 8.0))
            tried = (k for k, (a, b) in enumerate(columns) if min(x1, b) > max(x0, a) or abs(x0 - a) < tolerance or abs(x1 - b) < tolerance)
            assert found_tables._column_of({"x0": x0, "x1": x1}, columns, tolerance) == next(tried, -1)
            overlap = [min(x1, b) - max(x0, a) for a, b in columns]
            score = [o if o > 0 else -abs((x0 + x1 - a - b) / 2) for o, (a, b) in zip(overlap, columns, strict=True)]
            assert found_tables._best_column(x0, x1, columns) == score.index(max(score))

    class Counted(list):
        steps = 0

        def __getitem__(self, k):
            Counted.steps += 1
            return super().__getitem__(k)

        def __iter__(self):
            for k in range(len(self)):
                yield self[k]

    wide = Counted((10.0 * k, 10.0 * k + 6) for k in range(100_000))
    assert found_tables._column_of({"x0": 900_001.0, "x1": 900_004.0}, wide, 0.5) == 90_000
    assert found_tables._best_column(900_007.0, 900_008.0, wide) == 90_000
    assert Counted.steps < 500


def test_lines_keep_the_partitions_of_words(spark, sf_dir, monkeypatch):
    """Where partitions of lines are left to Spark, it joins them up to 64 MB of shuffled pages, many times that as rows."""
    monkeypatch.setattr(tables, "TEXT_BYTES", 10_000)
    n = tables.partitions(tables.read(spark, sf_dir, "documents"), "text")
    assert n > 4
    for name in ("text_lines", "fine_segments", "styled_runs"):
        assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == n, name


def test_pages_are_laid_out_once(spark, sf_dir):
    """Tables, blocks and their order come from one step in Python whose items are written; what follows does not repeat it."""
    plan = QUERIES["layout_to_markdown"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Scan parquet" in plan


def test_pairs_of_a_text_are_rows_once(spark):
    """A text of few different characters is few rows, whatever its length; the last character has no pair."""
    texts = spark.createDataFrame([(1, "AV" * 50_000 + "\N{GRINNING FACE}", "sans", 10), (2, "", "sans", 10), (3, None, "sans", 10)], "id int, t string, face string, size int")
    counts = texts.select("id", F.explode(glyphs._glyph_counts(F.col("t"))).alias("g")).select("g.*").collect()
    assert sorted(tuple(r) for r in counts if r["pair"]) == [("A", "AV", 50_000), ("V", "VA", 49_999), ("V", "V\N{GRINNING FACE}", 1)]
    assert [tuple(r) for r in counts if not r["pair"]] == [("\N{GRINNING FACE}", None, 1)]
    found = glyphs.metric_widths(texts, ["id"], "t", "face", "size", *standard_metrics(spark)).orderBy("id").collect()
    assert [r["n_missing"] for r in found] == [1, 0, 0] and [r["width"] for r in found][1:] == [0.0, 0.0]
    assert abs(found[0]["width"] - ((667 * 2 - 70) * 50_000 - 80 * 49_999 + 556) / 100) < 1e-3


def test_cells_of_workbooks_are_dealt_once(spark, sf_dir):
    """Cells are shuffled once, by workbook; the other shuffles are of sizes, which refuse workbooks.  There were eleven."""
    assert _shuffles(QUERIES["workbook_widths"](spark, sf_dir)) <= 6


def test_pages_of_html_are_parsed_by_slices(spark):
    page = "<h1>A</h1><p>b <b>c</b></p>" * 200
    pages = spark.createDataFrame([(k, page if k % 2 else None) for k in range(200)], "id int, html string")
    blocks = files.html_blocks(pages, "id", "html")
    assert "MapInPandas" not in blocks._jdf.queryExecution().executedPlan().toString()
    assert blocks.groupBy("kind", "level", "text").count().orderBy("kind").collect() == [("heading", 1, "A", 20_000), ("paragraph", 0, "b c", 20_000)]
    assert blocks.agg(F.max("block")).first()[0] == 399


def test_word_files_are_dealt_by_their_texts_and_tags_made_once(spark, sf_dir, monkeypatch):
    """Text and XML of documents are shuffled, each once and to partitions by the bytes of texts; tags are not, and are made once."""
    monkeypatch.setattr(tables, "TEXT_BYTES", 10_000)
    n = tables.partitions(tables.read(spark, sf_dir, "documents"), "text")
    for name in ("word_paragraphs", "word_runs", "word_cells"):
        found = QUERIES[name](spark, sf_dir)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert _shuffles(found) == 2 and plan.count("Generate posexplode(regexp_extract_all") == 1, name
        assert found.rdd.getNumPartitions() == n, name


def test_packages_of_slides_are_no_values_and_tags_are_made_once(spark, sf_dir):
    """A package of many parts goes through a file of its task; what is looked at several times is written."""
    parts = spark.createDataFrame([*((k, "ppt/presentation.xml", "<p:presentation/>") for k in (1, 2)), (3, "x.xml", "<a/>"), *((k % 2 + 1, f"ppt/slides/slide{k}.xml", f"<p:sld n='{k}'>{'ä' * 5000}</p:sld>") for k in range(1400))], "deck long, part string, xml string")
    back = slides.written_and_read(parts, ["deck"])
    assert "content" not in back._jdf.queryExecution().executedPlan().toString()
    own = back.unionByName(slides.slide_parts(slides.packages(parts, ["deck"]), ["deck"]).withColumn("deck", -F.col("deck"))).collect()
    for sign in (1, -1):
        assert sorted(tuple(r) for r in own if r["deck"] * sign > 0 and not r["error"]) == sorted((sign * d, None, p, x) for d, p, x in parts.where("deck < 3").collect())
        assert [r["error"] for r in own if r["deck"] == 3 * sign] == ["no presentation in the package"]
    for name in ("slide_shapes", "slide_runs"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Generate posexplode(regexp_extract_all") <= 1 and "MapInArrow" not in plan, name


def test_items_of_pages_are_dealt_once(spark, sf_dir):
    """Items are dealt as documents; no join or window deals them again."""
    found = QUERIES["layout_to_markdown"](spark, sf_dir)
    assert _shuffles(found) == 1 and "Join" not in found._jdf.queryExecution().executedPlan().toString()
