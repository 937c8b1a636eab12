"""Quality classifier: a generalised additive model with pairwise interactions.

Features of whole texts are counted in numpy over Arrow batches.  Each feature is cut into quantile bins and has a
lookup table of log-odds; cyclic boosting grows one shallow tree per feature and round on the residuals and adds its
leaf values to the table.  Then the feature pairs whose residuals gain most get two-dimensional tables in the same
way.  A document's score is the logistic of the sum of its table entries: vectorised bin lookups and additions.

The model is fitted on at most ``max_rows`` labelled rows, the ones with the smallest hash of their key; every
document is scored.

Defined results: null and empty texts have all features 0 and get the score of that; labels that are null are left
out, a document labelled more than once counts with its highest label; with labels of one kind or none the score is
the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import fold, read, small_batches
from quillspark.llm.wordhash import buffers, mix, slices, words

FEATURES = (
    "log_words", "word_bytes", "upper", "digits", "symbols", "exclamations", "bars", "non_ascii", "other_marks",
    "line_words", "repeated_words", "repeated_lines", "upper_words", "marked_words",
)
MAX_ROWS = 20_000


def _classes() -> np.ndarray:
    table = np.zeros((256, 6), dtype=np.float32)
    table[65:91, 0] = 1
    table[48:58, 1] = 1
    for c in "#*$%&|<>":
        table[ord(c), 2] = 1
    table[ord("!"), 3] = 1
    table[0xC2:, 4] = 1
    for c in "\"'()[]{}=+_/\\^~`@:;?":
        table[ord(c), 5] = 1
    return table


_CLASS = _classes()


def byte_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often every byte occurs in each row."""
    out = np.zeros((len(offsets) - 1, 256))
    if len(out) == 1:
        for lo in range(0, len(data), 1 << 20):
            out[0] += np.bincount(data[lo : lo + (1 << 20)], minlength=256)
        return out
    size = np.diff(offsets)
    for lo in range(0, len(out), 512):
        own = size[lo : lo + 512]
        cells = np.repeat(np.arange(len(own)), own) * 256 + data[offsets[lo] : offsets[lo + len(own)]]
        out[lo : lo + len(own)] = np.bincount(cells, minlength=256 * len(own)).reshape(-1, 256)
    return out


def _repeats(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each row the share of its items that are equal to another one of the row before them."""
    number = np.diff(first)
    if len(number) == 1:
        return np.array([1 - len(np.unique(hashes)) / number[0] if number[0] else 0.0])
    row = np.repeat(np.arange(len(number)), number)
    with np.errstate(over="ignore"):
        distinct = np.unique(hashes ^ mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    return 1 - np.bincount(row[distinct], minlength=len(number)) / np.maximum(number, 1) - (number == 0)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text, from all of it."""
    parts = [_features(texts.slice(a, b - a)) for a, b in slices(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _features(texts: pa.Array) -> np.ndarray:
    data, offsets = buffers(texts)
    w = words(texts)
    n = np.diff(w.first)
    size = np.maximum(np.diff(offsets), 1)
    counts = byte_counts(data, offsets)
    upper, digits, symbols, shouts, high, marks = (counts @ _CLASS).T
    bars = counts[:, 0x7C]
    length = np.concatenate(([0], np.cumsum(w.ends - w.starts)))
    length = length[w.first[1:]] - length[w.first[:-1]]
    last = data[w.ends - 1] if len(w.ends) else np.empty(0, np.uint8)
    head = data[w.starts] if len(w.starts) else np.empty(0, np.uint8)
    per_row = lambda flag: np.diff(np.concatenate(([0], np.cumsum(flag)))[w.first])
    big = per_row((head >= 65) & (head < 91))
    marked = per_row(np.isin(last, np.frombuffer(b"#*$%&|<>!", np.uint8)))
    # Lines: the words of a line as one hash; a line starts at a word with a line feed between it and the word before.
    if len(w.starts):
        feeds = np.searchsorted(np.flatnonzero(data == 0x0A), w.starts)
        new = np.ones(len(w.starts), dtype=bool)
        new[1:] = feeds[1:] != feeds[:-1]
        new[w.first[:-1][n > 0]] = True
        at = np.flatnonzero(new)
        with np.errstate(over="ignore"):
            place = np.arange(len(new)) - np.repeat(at, np.diff(np.append(at, len(new))))
            line = np.add.reduceat(w.hashes * mix(place.astype(np.uint64) + np.uint64(7)), at)
        line_first = np.searchsorted(at, w.first)
    else:
        line, line_first = np.empty(0, np.uint64), np.zeros(len(w.first), np.int64)
    some = np.maximum(n, 1)
    return np.column_stack(
        (
            np.log1p(n), length / some, upper / size, digits / size, symbols / size, shouts / size, bars / size, high / size, marks / size,
            n / np.maximum(np.diff(line_first), 1), _repeats(w.first, w.hashes), _repeats(line_first, line), big / some, marked / some,
        )
    )


@dataclass
class AdditiveModel:
    """Bin edges, a table of log-odds per feature, and two-dimensional tables of feature pairs."""

    edges: list[np.ndarray]
    bias: float
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    coarse: int = 8

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)])

    def small(self, bins: np.ndarray) -> np.ndarray:
        """Bins of the pair tables: neighbouring bins of the fine cut together."""
        count = np.array([len(e) + 1 for e in self.edges])
        return bins * self.coarse // np.maximum(count, self.coarse)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        z = np.full(len(x), self.bias)
        for k, t in enumerate(self.tables):
            z += t[bins[:, k]]
        small = self.small(bins)
        for (i, j), t in self.pairs.items():
            z += t[small[:, i], small[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, ridge: float = 1.0, least: float = 2.0) -> np.ndarray:
    """Leaf values over ordered bins of a best-first tree with ``leaves`` leaves, by Newton gain."""
    g, h = np.concatenate(([0], np.cumsum(gradient))), np.concatenate(([0], np.cumsum(weight)))
    value = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)

    def best(a: int, b: int) -> tuple[float, int]:
        cuts = np.arange(a + 1, b)
        cuts = cuts[(h[cuts] - h[a] >= least) & (h[b] - h[cuts] >= least)]
        if not len(cuts):
            return 0.0, -1
        gain = value(a, cuts) + value(cuts, b) - value(a, b)
        k = int(np.argmax(gain))
        return float(gain[k]), int(cuts[k])

    parts = [(0, len(gradient), *best(0, len(gradient)))]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: parts[i][2])
        a, b, gain, cut = parts[k]
        if cut < 0 or gain <= 1e-9:
            break
        parts[k : k + 1] = [(a, cut, *best(a, cut)), (cut, b, *best(cut, b))]
    out = np.zeros(len(gradient))
    for a, b, _, _ in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 80, leaves: int = 3, rate: float = 0.15, n_pairs: int = 6) -> AdditiveModel:
    """Cyclic boosting of the main tables, then of the tables of the ``n_pairs`` strongest pairs."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for k in range(x.shape[1])]
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges])
    if not len(y) or y.min() == y.max():
        return model
    cells = model.bins(x)
    z = np.full(len(y), model.bias)

    def newton(cell: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return np.bincount(cell, y - p, size), np.bincount(cell, np.maximum(p * (1 - p), 1e-4), size)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            step = rate * _tree(*newton(cells[:, k], len(table)), leaves)
            table += step
            z += step[cells[:, k]]
    c = model.coarse
    small = model.small(cells)
    gains = {}
    for i, j in combinations(range(x.shape[1]), 2):
        g, h = newton(small[:, i] * c + small[:, j], c * c)
        gains[i, j] = float((g**2 / (h + 1)).sum())
    for i, j in sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]:
        table = np.zeros((c, c))
        cell = small[:, i] * c + small[:, j]
        for _ in range(rounds // 4):
            g, h = newton(cell, c * c)
            g, h = g.reshape(c, c), h.reshape(c, c)
            # A tree of depth two: a cut of one feature, then one of the other on either side.
            step, most = np.zeros((c, c)), 0.0
            for cut in range(1, c):
                trial = np.vstack([np.tile(_tree(g[a:b].sum(0), h[a:b].sum(0), 2), (b - a, 1)) for a, b in ((0, cut), (cut, c))])
                gain = float((trial * g - trial**2 * h / 2).sum())
                if gain > most:
                    step, most = trial, gain
            table += rate * step
            z += rate * step.reshape(-1)[cell]
        model.pairs[i, j] = table
    return model


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_rows: int = MAX_ROWS) -> AdditiveModel:
    """Fits on the labelled rows with the smallest hash of the key, ``max_rows`` at most."""
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("__label"))
    chosen = chosen.orderBy(F.xxhash64(F.lit("sample"), key), key).limit(max_rows)
    rows = docs.select(key, F.col(text).alias("__text")).join(F.broadcast(chosen), key)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    table = rows.select("__text", "__label").mapInArrow(measure, "x array<double>, y int").toArrow()
    x = np.array(table["x"].to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    y = table["y"].to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # the same model whatever the order in which rows arrive
    return fit(x[order], y[order])


def quality_score(df: DataFrame, text: str, model: AdditiveModel) -> Column:
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array(held.value.score(features(texts)))

    return score(F.col(text))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; labels are learned from the documents whose fold is not 1."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)
    model = train(docs, labels, "doc_id", "text", "quality")
    scored = docs.withColumn("score", quality_score(docs, "text", model))
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
