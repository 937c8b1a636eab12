"""Operators on text: search and redaction, alignment and word comparison."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import PRESETS, comparable


def search_counts(df: DataFrame, key: str, text: str, presets: dict[str, str] = PRESETS) -> DataFrame:
    """Rows (key, preset, n) of the presets that a text has matches of."""
    found = F.array(*[F.struct(F.lit(k).alias("preset"), F.size(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).cast("long").alias("n")) for k, p in presets.items()])
    return df.select(key, F.inline(found)).where("n > 0")


def literal(query: str, match_case: bool = False) -> str | None:
    """A pattern for the words of a search box, its marks escaped; null for a blank one."""
    escaped = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", query.strip())
    return ("" if match_case else "(?iu)") + escaped if escaped else None


def masked(df: DataFrame, text: str, presets: dict[str, str] = PRESETS, mark: str = "█") -> DataFrame:
    """Every match replaced by the mark."""
    t = F.col(text)
    for p in presets.values():
        t = F.regexp_replace(t, p, mark)
    return df.withColumn(text, t)


#: Why a document is refused that has nothing marked.
NOTHING_MARKED = "nothing marked"


def redacted(pages: DataFrame, key: str, page: str, text: str, marks: DataFrame, presets: dict[str, str] = PRESETS, mark: str = "█", metadata: tuple[str, ...] = ()) -> DataFrame:
    """Pages with the matches on marked ones masked; others are as they were.  Adds error.

    ``marks`` (key, page) may name a page more than once and pages that are not there.  A document none of whose pages is
    marked is refused: its rows have an error and no text.  Columns named as ``metadata`` are emptied in all rows.
    """
    of = marks.select(key, page).distinct()
    some = of.join(pages.select(key, page).distinct(), [key, page], "left_semi").select(key).distinct().withColumn("__some", F.lit(True))
    known = pages.join(of.withColumn("__marked", F.lit(True)), [key, page], "left").join(some, key, "left")
    refused = F.col("__some").isNull()
    changed = masked(known.withColumn("__text", F.col(text)), "__text", presets, mark)
    out = changed.withColumns({
        text: F.when(~refused, F.when(F.col("__marked"), F.col("__text")).otherwise(F.col(text))), "error": F.when(refused, NOTHING_MARKED), **{c: F.lit(None).cast(pages.schema[c].dataType) for c in metadata},
    })
    return out.select(*pages.columns, "error")


def match_spans(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, start, end) of all matches; start counts from 0.

    The pieces between matches give the places: starts are running sums of their lengths.
    """
    rest, found = F.split(F.col(text), pattern, -1), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    rows = df.select(key, rest.alias("rest"), found.alias("found")).where("size(found) > 0")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state, k):
        a = state["at"] + F.length(F.get(F.col("rest"), k))
        b = a + F.length(F.get(F.col("found"), k))
        return F.struct(b.alias("at"), F.concat(state["spans"], F.array(F.struct(a.alias("start"), b.alias("end")))).alias("spans"))

    spans = F.aggregate(F.sequence(F.lit(0), F.size("found") - 1), start, step)["spans"]
    return rows.select(key, F.inline(spans))


def match_boxes(spans: DataFrame, runs: DataFrame, key: list[str]) -> DataFrame:
    """Boxes over matches in runs: proportional to the characters, a point wider, 1.2 sizes high."""
    one = F.col("w") / F.col("n_chars")
    joined = spans.join(runs, key)
    return joined.select(
        *key, "start", "end", (F.col("x") + one * F.col("start") - 1).alias("box_x"), (F.col("y") - F.col("size")).alias("box_y"),
        (one * (F.col("end") - F.col("start")) + 2).alias("box_w"), (1.2 * F.col("size")).alias("box_h"),
    )


def common_affixes(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Lengths of the common start and of the common end of two arrays of words (columns a and b of key)."""
    both = a.join(b, key)
    m = F.least(F.size("a"), F.size("b"))
    places = F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: F.element_at("a", i) != F.element_at("b", i))
    head = F.coalesce(F.get(differ, F.lit(0)) - 1, m)
    with_head = both.withColumn("prefix", head)
    left = F.least(F.size("a"), F.size("b")) - F.col("prefix")
    back = F.when(left > 0, F.sequence(F.lit(1), left)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(back, lambda i: F.element_at("a", -i) != F.element_at("b", -i))
    return with_head.withColumn("suffix", F.coalesce(F.get(differ, F.lit(0)) - 1, left))


MOST_EDITS = 2500


def _forward(a: np.ndarray, b: np.ndarray, most: int) -> list[np.ndarray] | None:
    """After every number of edits the furthest place in ``a`` on each diagonal that so many edits reach; None beyond ``most``.

    All diagonals of a step move together; those with odd distance from the step's number can't be reached by it.
    """
    n, m = len(a), len(b)
    steps: list[np.ndarray] = []
    for d in range(min(n + m, most) + 1):
        x = np.zeros(d + 1, dtype=np.int32)
        if d:
            last = steps[-1]
            x[:-1] = last
            x[-1] = last[-1] + 1
            x[1:-1] = np.where(last[:-1] < last[1:], last[1:], last[:-1] + 1)
        y = x - np.arange(-d, d + 1, 2, dtype=np.int32)
        live = np.flatnonzero((x < n) & (y < m))
        while len(live):
            live = live[a[x[live]] == b[y[live]]]
            x[live] += 1
            y[live] += 1
            live = live[(x[live] < n) & (y[live] < m)]
        steps.append(x)
        if ((x >= n) & (y >= m)).any():
            return steps
    return None


def shortest_edits(a: list[str], b: list[str], most: int = MOST_EDITS) -> list[tuple[str, int, int]] | None:
    """Runs (op, start, number) of a shortest edit script, eq and ins counted in ``b`` and del in ``a``; None beyond ``most`` edits.

    What both have in common at the start and at the end is set aside before the greedy furthest-reaching search.
    """
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    left = min(len(a), len(b)) - head
    tail = next((i for i in range(left) if a[-1 - i] != b[-1 - i]), left)
    numbers: dict[str, int] = {}
    own = [np.array([numbers.setdefault(w, len(numbers)) for w in t[head : len(t) - tail]], dtype=np.int32) for t in (a, b)]
    steps = _forward(*own, most)
    if steps is None:
        return None
    ops, x, y = [("eq", len(b) - tail, tail)], len(own[0]), len(own[1])
    for d in range(len(steps) - 1, 0, -1):
        last, i = steps[d - 1], (x - y + d) // 2
        inserted = i == 0 or (i != d and last[i - 1] < last[i])
        px = int(last[i] if inserted else last[i - 1])
        py = px - (x - y) + (-1 if inserted else 1)
        same = x - px if inserted else x - px - 1
        ops.append(("eq", head + y - same, same))
        ops.append(("ins", head + py, 1) if inserted else ("del", head + px, 1))
        x, y = px, py
    ops += [("eq", head, x), ("eq", 0, head)]
    runs: list[tuple[str, int, int]] = []
    for op, at, size in reversed(ops):
        if runs and runs[-1][0] == op:
            runs[-1] = (op, runs[-1][1], runs[-1][2] + size)
        elif size:
            runs.append((op, at, size))
    return runs


def word_diff(pairs: DataFrame, key: list[str], most: int = MOST_EDITS, texts: bool = True) -> DataFrame:
    """Runs of the word comparison of columns a and b: (key, run, op, n_words, text); one row with op null if too different.

    Without ``texts``, the column text is null.
    """
    schema = pairs.select(*key).schema.simpleString()[7:-1].replace(":", " ") + ", run int, op string, n_words int, text string"
    marks = {0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"', 0xAD: None}

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for *k, a, b in p[[*key, "a", "b"]].itertuples(index=False, name=None):
                a, b = [re.findall(r"[^ \t-\r]+", t or "") for t in (a, b)]
                runs = shortest_edits(*([x.translate(marks) for x in w] for w in (a, b)), most)
                if runs is None:
                    rows.append((*k, 0, None, None, None))
                for i, (op, at, n) in enumerate(runs or []):
                    rows.append((*k, i, op, n, " ".join((a if op == "del" else b)[at : at + n]) if texts else None))
            out = pd.DataFrame(rows, columns=[*key, "run", "op", "n_words", "text"])
            yield out.astype({"n_words": "Int32"})

    return pairs.select(*key, "a", "b").mapInPandas(compare, schema)


def diff_stats(diff: DataFrame, key: list[str]) -> DataFrame:
    """Changes (runs that are not equal), words inserted and deleted, and whether the texts were too different."""
    n = lambda op: F.coalesce(F.sum(F.when(F.col("op") == op, F.col("n_words"))), F.lit(0))
    return diff.groupBy(*key).agg(F.count_if(F.col("op") != "eq").alias("changes"), n("ins").alias("inserted"), n("del").alias("deleted"), F.max(F.col("op").isNull()).alias("too_different"))


def diff_context(diff: DataFrame, around: int = 10, fold_from: int = 24) -> DataFrame:
    """Equal runs of more than ``fold_from`` words shortened to ``around`` words on either side."""
    w = F.split("text", " ")
    short = F.concat_ws(" ", F.slice(w, 1, around), F.lit("…"), F.slice(w, -around, around))
    return diff.withColumn("text", F.when((F.col("op") == "eq") & (F.col("n_words") > fold_from), short).otherwise(F.col("text")))


def aligned_pages(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pages of two versions side by side by index; what only one of them has is 'added' or 'removed'."""
    left, right = a.select(key, "page_index", F.col("text").alias("a")), b.select(key, "page_index", F.col("text").alias("b"))
    same = comparable(F.col("a")) == comparable(F.col("b"))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(same, "same").otherwise("changed")
    return left.join(right, [key, "page_index"], "full").withColumn("state", state)
