"""URL filter: character language-model ratio.

Two smoothed variable-order Markov models (Witten-Bell back-off over hashed contexts) are learned, one from URLs
that are accepted and one from URLs that are rejected.  A URL's score is the difference of its two log
likelihoods divided by its length; it is accepted from a calibrated threshold on.

A table of counts has ``2 * (order + 1) * 2**context_bits * 64`` cells whatever the input (25 MB by default), so
its broadcast is bounded; its counts come from all labelled URLs, summed in Spark before they reach the driver.

Defined results: a null or empty URL scores 0.0; without labelled URLs of both kinds every score is 0.0 and the
threshold 0.0, so everything is accepted; repeated rows are counted and judged one by one; other columns pass; a URL
of any length is worked on in blocks of characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import read
from quillspark.llm.wordhash import buffers, mix

ALPHABET = 64
_SYMBOL = np.full(256, 63, dtype=np.uint8)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _SYMBOL[ord(_c)] = _SYMBOL[ord(_c.upper())] = _i + 1
for _c in "0123456789":
    _SYMBOL[ord(_c)] = 27
for _i, _c in enumerate("/.:-_?&=#%+~,;@!$*()[]'\"|<> "):
    _SYMBOL[ord(_c)] = 28 + _i


def _cells(urls: pa.Array, order: int, context_bits: int, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cells, rows) for blocks of characters: for every order the cell of (context, character), and the rows they are in.

    Contexts start with the boundary symbol 0, so the first characters have contexts too.  A block sees the characters
    before it, so that long URLs, however they are cut, give the same cells.
    """
    data, offsets = buffers(urls)
    for lo in range(0, len(data), block):
        hi = min(lo + block, len(data))
        at = np.arange(lo, hi)
        row = np.searchsorted(offsets, at, side="right") - 1
        place = at - offsets[row]
        symbol = _SYMBOL[data[max(0, lo - order) : hi]].astype(np.uint64)
        own = symbol[lo - max(0, lo - order) :]
        out = np.empty((order + 1, len(own)), dtype=np.int64)
        context = np.zeros(len(own), dtype=np.uint64)
        for k in range(order + 1):
            if k:
                before = np.zeros(len(own), dtype=np.uint64)
                inside = place >= k
                before[inside] = symbol[np.flatnonzero(inside) + (len(symbol) - len(own)) - k]
                with np.errstate(over="ignore"):
                    context = mix(context * np.uint64(ALPHABET) + before + np.uint64(k * 1000))
            bins = context >> np.uint64(64 - context_bits)
            out[k] = (bins * np.uint64(ALPHABET) + own).astype(np.int64)
        yield out, row


@dataclass(frozen=True)
class UrlRatioModel:
    """Learned ``counts[label, order, context, symbol]`` and the threshold of the ratio."""

    counts: np.ndarray
    order: int
    context_bits: int
    threshold: float = 0.0

    def log_ratio_table(self) -> tuple[np.ndarray, np.ndarray]:
        """counts and continuation weights ready for interpolation: n(ctx, c) / (n + T) and T / (n + T)."""
        n = self.counts.sum(axis=3, dtype=np.float64)
        kinds = (self.counts > 0).sum(axis=3)
        total = n + kinds
        seen = total > 0
        share = np.where(seen[..., None], self.counts / np.maximum(total, 1)[..., None], 0.0).astype(np.float32)
        back = np.where(seen, kinds / np.maximum(total, 1), 1.0).astype(np.float32)
        return share.reshape(2, self.order + 1, -1), back

    def scorer(self):
        share, back = self.log_ratio_table()
        order, bits = self.order, self.context_bits
        usable = bool(self.counts[0].any() and self.counts[1].any())

        def score(urls: pa.Array) -> np.ndarray:
            total = np.zeros(len(urls))
            for cells, row in _cells(urls, order, bits) if usable else ():
                log = []
                for label in (0, 1):
                    p = np.full(cells.shape[1], 1.0 / ALPHABET)
                    for k in range(order + 1):
                        p = share[label, k][cells[k]] + back[label, k][cells[k] // ALPHABET] * p
                    log.append(np.log(p))
                total += np.bincount(row, log[1] - log[0], len(total))
            return total / np.maximum(np.diff(buffers(urls)[1]), 1)

        return score


def _scored(df: DataFrame, url: str, model: UrlRatioModel) -> Column:
    held = df.sparkSession.sparkContext.broadcast((model.counts, model.order, model.context_bits))

    @F.arrow_udf("double")
    def ratio(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = UrlRatioModel(*held.value).scorer()
        for urls in parts:
            yield pa.array(score(urls))

    return ratio(F.col(url))


def fit(df: DataFrame, url: str, accepted: Column, order: int = 5, context_bits: int = 13, holdout: int = 5) -> UrlRatioModel:
    """Learns from the rows whose ``accepted`` is true or false (null: not labelled).

    One row in ``holdout``, by hash of the URL, is kept from the counts and calibrates the threshold: the value
    with the fewest mistakes when both kinds weigh the same, nearest to 0 among equals, read off histograms of all
    held-out scores.
    """
    labelled = df.select(F.col(url).alias("url"), accepted.cast("int").alias("label")).where("label is not null and url is not null")
    labelled = labelled.withColumn("held", F.crc32("url") % holdout == 0)
    shape = (2, order + 1, 1 << context_bits, ALPHABET)
    per_label = int(np.prod(shape[1:]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for b in batches:
            for label in (0, 1):
                own = b.column(0).filter(pa.array(b.column(1).to_numpy(zero_copy_only=False) == label))
                if not len(own):
                    continue
                for cells, _ in _cells(own, order, context_bits):
                    cells = cells + (np.arange(order + 1) << (context_bits + 6))[:, None] + label * per_label
                    key, n = np.unique(cells, return_counts=True)
                    both = np.concatenate((held[0], key))
                    key, at = np.unique(both, return_inverse=True)
                    held = key, np.bincount(at, np.concatenate((held[1], n)), len(key)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["cell", "n"])

    table = labelled.where("not held").select("url", "label").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * per_label, dtype=np.int32)
    counts[table["cell"].to_numpy()] = np.minimum(table["n"].to_numpy(), 2**31 - 1)
    model = UrlRatioModel(counts.reshape(shape), order, context_bits)
    step = 0.005
    scores = labelled.where("held").select("label", F.floor(_scored(labelled, "url", model) / step).alias("bin")).groupBy("label", "bin").count().collect()
    sides = [{r["bin"]: r["count"] for r in scores if r["label"] == k} for k in (0, 1)]
    if not all(sides):
        return model
    total = [sum(s.values()) for s in sides]
    best = (2.0, 0.0, 0.0)
    for edge in sorted({0, *(b for s in sides for b in s), *(b + 1 for s in sides for b in s)}):
        wrong = sum(n for b, n in sides[0].items() if b >= edge) / total[0] + sum(n for b, n in sides[1].items() if b < edge) / total[1]
        best = min(best, (wrong, abs(edge * step), edge * step))
    return UrlRatioModel(model.counts, order, context_bits, best[2])


def url_score(df: DataFrame, url: str, model: UrlRatioModel) -> Column:
    """Length-normalised log-likelihood difference, accepted minus rejected."""
    return _scored(df, url, model)


#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged: by the longest rule, else by the ratio learned from the URLs that rules judge."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    parts = pages.withColumns({"host": host, "path": path})
    rule, verdict = rule_columns(F.col("host"), F.col("path"))
    judged = parts.withColumns({"rule": rule, "ruled": verdict})
    model = fit(judged, "url", F.col("ruled") == "allow")
    scored = judged.withColumn("score", url_score(judged, "url", model))
    by_model = F.when(F.col("score") >= model.threshold, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
