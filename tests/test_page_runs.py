"""Lines, segments and styles of pages that are arrays: equal to a walk over their runs, and words are never shuffled."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.operators import layout as L
from quillspark.plans import ORACLES, QUERIES
from quillspark.sources import tables
from test_queries import rows

NAMES = {
    "text_lines": 1, "chained_text_lines": 1, "fine_segments": 1, "styled_runs": 1, "detected_tables": 1, "emphasized_segments": 1, "built_blocks": 1, "line_segments": 1, "styled_markdown": 1,
    "block_alignment": 2, "block_kinds": 4, "documents_to_markdown": 4, "tight_tables": 1,
}
SCHEMA = "doc_id int, page int, run_no int, text string, x double, y double, w double, size double, bold boolean, italic boolean, mono boolean"


def shuffles(df):
    return re.findall(r"Exchange (?:hash|range|single)\w*\(?[^\n]*", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", sorted(NAMES))
def test_words_are_not_shuffled(spark, sf_dir, name):
    """Documents are dealt as texts; what is shuffled after them is segments or sizes.  Words were shuffled as rows before."""
    found = shuffles(QUERIES[name](spark, sf_dir))
    assert 1 <= len(found) <= NAMES[name], found


def _pages(seed):
    r, out = random.Random(seed), []
    for page in range(5):
        y, k = 0.0, 0
        for _ in range(r.randrange(0, 12)):
            y += r.choice([0.0, 3.0, 9.0, 30.0])
            size, x = r.choice([8.0, 11.0, 20.0]), 0.0
            for _ in range(r.randrange(1, 14)):
                x += r.choice([-9.0, 0.0, 1.0, 4.0, 30.0])
                text = r.choice(["a", "bc", "d ", " e", "f\t", "*g*", "  ", "h `i`", "j  ", "ü"])
                out.append((seed, page, k, text, x, y + r.choice([0.0, 0.0, 1.5]), r.choice([0.0, 5.0, 60.0]), size + r.choice([0.0, 0.0, 0.4, 1.0]), r.random() < 0.5, r.random() < 0.3, r.random() < 0.2))
                k += 1
    r.shuffle(out)
    return out


def _walked(runs, gap):
    """(page, line, runs by segment) by a walk over sorted runs; runs are the tuples of SCHEMA."""
    out = []
    for page in sorted({r[1] for r in runs}):
        lines = []
        for r in sorted((r for r in runs if r[1] == page), key=lambda r: (r[5], r[4], r[2])):
            if lines:
                first = lines[-1][0]
                small, large = sorted((first[7], r[7]))
                if abs(first[5] - r[5]) < large * (0.6 if small < large * 0.8 else 0.4):
                    lines[-1].append(r)
                    continue
            lines.append([r])
        for n, line in enumerate(lines):
            size, cut = _middle([r[7] for r in line]), []
            for r in sorted(line, key=lambda r: (r[4], r[2])):
                before = [q for s in cut for q in s]
                if not before or r[4] - max(q[4] + q[6] for q in before) >= size * gap:
                    cut.append([])
                cut[-1].append(r)
            out.append((page, n, cut))
    return out


def _middle(values):
    return sorted(values)[len(values) // 2]


def _pieces(segment):
    out = []
    for k, r in enumerate(segment):
        gap = k and r[4] - max(q[4] + q[6] for q in segment[:k]) > r[7] * 0.15
        closed = k and re.search("[ \t\n\x0b\f\r][\x85  ]?$", segment[k - 1][3])
        out.append((" " if gap and not closed and not re.match("[ \t\n\x0b\f\r]", r[3]) else "") + r[3])
    return out


def _collapsed(text):
    return re.sub("[ \t\n\x0b\f\r]+", " ", text).strip(" ")


@pytest.mark.parametrize("gap", [0.5, 1.6])
def test_segments_are_those_of_a_walk(spark, gap):
    runs = [r for seed in range(12) for r in _pages(seed)]
    paged = L.pages(spark.createDataFrame(runs, SCHEMA))
    expected = [
        (seed, page, line, k, min(r[4] for r in s), max(r[4] + r[6] for r in s), _middle([r[5] for r in s]), _middle([r[7] for r in s]), all(r[8] for r in s), _collapsed("".join(_pieces(s))))
        for seed in range(12) for page, line, cut in _walked([r for r in runs if r[0] == seed], gap) for k, s in enumerate(cut)
    ]
    got = L.segments(paged, gap).select("doc_id", "page", "line", "segment", "x0", "x1", "y", "size", "bold", "text").collect()
    assert len(expected) > 200 and sorted(map(tuple, got)) == sorted(expected)


def test_lines_and_styles_are_those_of_a_walk(spark):
    runs = [r for seed in range(12) for r in _pages(seed)]
    paged = L.pages(spark.createDataFrame(runs, SCHEMA))
    boxes, styles, told = [], [], {}
    for seed in range(12):
        for page, line, cut in _walked([r for r in runs if r[0] == seed], 1.6):
            own = [r for s in cut for r in s]
            boxes.append((seed, page, line, len(own), min(r[4] for r in own), max(r[4] + r[6] for r in own), _middle([r[5] for r in own]), _middle([r[7] for r in own])))
            for k, s in enumerate(cut):
                groups, marks, last = [], [], None
                for r, piece in zip(s, _pieces(s), strict=True):
                    if not last or last[8] != r[8] or abs(last[7] - r[7]) >= 0.5:
                        groups.append([])
                    groups[-1].append(r)
                    if not last or last[8:] != r[8:]:
                        marks.append(("", r[8:]))
                    marks[-1] = (marks[-1][0] + piece, r[8:])
                    last = r
                styles += [(seed, page, line, k, n, g[0][8], " ".join(r[3] for r in g)) for n, g in enumerate(groups)]
                told[seed, page, line, k] = marks
    assert sorted(map(tuple, L.line_boxes(paged).select("doc_id", "page", "line", "n_runs", "x0", "x1", "y", "size").collect())) == sorted(boxes)
    assert sorted(map(tuple, L.style_runs(paged).collect())) == sorted(styles)
    marks = spark.createDataFrame([(*at, k, t, *flags) for at, m in told.items() for k, (t, flags) in enumerate(m)], "doc_id int, page int, line int, segment int, k int, t string, bold boolean, italic boolean, mono boolean")
    shown = {(*r[:4], r["k"]): r["m"] for r in marks.select("*", L.emphasis(F.col("t"), F.col("bold"), F.col("italic"), F.col("mono")).alias("m")).collect()}
    expected = {at: _collapsed("".join(shown[(*at, k)] for k in range(len(m)))) for at, m in told.items()}
    assert {tuple(r[:4]): r["text"] for r in L.emphasized(paged).collect()} == expected


def test_chained_lines_are_those_of_a_walk(spark):
    runs, expected = [r for seed in range(12) for r in _pages(seed)], []
    for seed in range(12):
        for page in range(5):
            lines, last = [], None
            for r in sorted((r for r in runs if r[:2] == (seed, page)), key=lambda r: (r[5], r[4], r[2])):
                if not last or abs(r[5] - last[5]) >= r[7] * 0.6:
                    lines.append([])
                lines[-1].append(r)
                last = r
            expected += [(seed, page, k, " ".join(r[3] for r in sorted(s, key=lambda r: (r[4], r[2]))), round(sum(r[5] for r in s) / len(s), 6), max(r[7] for r in s), min(r[4] for r in s)) for k, s in enumerate(lines)]
    got = L.chained_lines(spark.createDataFrame(runs, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["page"], r["line"], r["text"], round(r["y"], 6), r["size"], r["x"]) for r in got) == sorted(expected)


DOCS = [
    (1, None), (2, ""), (3, "  \n \n"), (4, "\n".join(f"w{k} x" for k in range(120))), (5, " ".join(f"w{k}" for k in range(2500)) + "\nnext one"), (6, "a b  c  d\n- item\n1. one\n# x"),
    (7, "\n" * 130 + "late words"), (None, "no name\nat all."),
]


@pytest.mark.parametrize("name", sorted(set(NAMES) & set(ORACLES)))
def test_odd_documents(spark, tmp_path, name):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES[name](spark, str(tmp_path)).toPandas()
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(found) == rows(c.execute(ORACLES[name]).fetchdf())


def test_runs_of_pages_are_the_runs(spark, sf_dir):
    """The same runs as rows of words have, in arrays; documents of one name share their pages."""
    columns = ["doc_id", "page", *L.RUN]
    paged = tables.page_runs(spark, sf_dir, 4).select("doc_id", "page", F.inline("r")).select(*columns)
    whole = tables.runs(spark, sf_dir).select(*columns)
    assert paged.exceptAll(whole).count() == 0 and whole.count() == paged.count()


def test_documents_of_one_name(spark, tmp_path):
    spark.createDataFrame([(1, "aa bb\ncc"), (1, "dd ee\n\nff")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["line"]: (r["n_runs"], r["x0"], r["x1"]) for r in QUERIES["text_lines"](spark, str(tmp_path)).collect()}
    assert got == {0: (4, 0.0, 88.0), 1: (1, 0.0, 11.0), 2: (1, 0.0, 11.0)}


def test_blocks_are_classified_where_documents_were_dealt_to(spark, sf_dir):
    """only texts are shuffled; segments were written, read twice and shuffled, and so were weights of sizes."""
    plan = QUERIES["block_kinds"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange ", plan)) == 1 and plan.count("FileScan parquet") == 1 and "documents.parquet" in plan
    assert len(shuffles(QUERIES["documents_to_markdown"](spark, sf_dir))) == 2


def test_blocks_of_documents_are_those_of_segments(spark):
    """The same blocks as by the body's size and the headings' sizes as relations, with pages in any order and rows without a document."""
    runs = [(None, *r[1:]) if r[0] == 3 else r for seed in range(12) for r in _pages(seed)]
    runs += [(20, 0, k, t, 0.0, 30.0 * k, 5.0, 20.0 - k, False, False, False) for k, t in enumerate(["1. " + "a" * 90, "b. c", "", "d" * 30, "e:", "f" * 20])] + [(21, 0, 0, "", 0.0, 0.0, 0.0, 14.0, True, False, False)]
    paged = L.pages(spark.createDataFrame(runs, SCHEMA))
    expected = L.classified(L.segments(paged).withColumn("n_segments", F.lit(1)), L.body_size(L.size_weights(paged)))
    docs = paged.groupBy("doc_id").agg(F.collect_list(F.struct("page", "r")).alias("pages"))
    columns = ["doc_id", "page", "line", "segment", "size", "bold", "text", "kind", "level", "marker", "ordered"]
    got = sorted(map(repr, L.classified_segments(docs).select(columns).collect()))
    assert len(got) > 200 and got == sorted(map(repr, expected.select(columns).collect()))
    assert {"heading", "list", "paragraph"} == {k for k in ("heading", "list", "paragraph") if any(f"kind='{k}'" in r for r in got)}


def _steps_in_python(spark, sf_dir, name):
    """The Arrow steps of a query's plan, as (functions, one inside the other)."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    return [re.findall(r"(\w+)\((?=\w+\(|sort_array|r#)", line) for line in re.findall(r"ArrowEvalPython \[([^\n]*)", plan)]


def test_runs_stay_in_python_until_lines_are_chained(spark, sf_dir):
    """F16: runs are placed and chained in one step; they went to Spark, ten times as large as their text, and back."""
    assert _steps_in_python(spark, sf_dir, "chained_text_lines") == [["find", "_placed"]]


@pytest.mark.parametrize("name", ["styled_runs", "text_lines", "line_segments", "fine_segments", "emphasized_segments", "styled_markdown"])
def test_runs_stay_in_python_until_they_are_rows(spark, sf_dir, name):
    """the same for styles, and for the queries that share the step."""
    assert _steps_in_python(spark, sf_dir, name) == [["find", "_placed"]]
