"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus, SQL functions only.

Tokens are a text's words and its runs of symbols.  Tokens and pairs of neighbouring tokens are hashed into a fixed number of buckets.  Two multinomials over the buckets are counted, one
over the trusted rows and one over all rows, and every document gets the mean over its n-grams of the log ratio of
their smoothed shares.  Documents below a threshold fail.

Only the two rows of bucket counts (``buckets`` numbers each, whatever the input) reach the driver; scoring looks
the ratios up in a constant array and needs no shuffle.

Defined results: null and empty texts have no n-grams and ratio 0.0; a text is never split over rows; without
trusted rows all ratios are 0.0.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_KEYS, read, written

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^\p{L}\p{N}_\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space, in order; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def base_columns(df: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    Repeats are found per row by hashing the five-word windows.  Only rows with a window hash met twice sort their
    windows: sorted positions of repeated windows give the covered words, min(5, gap to the next) each.
    """
    size = 5
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__words", words(F.col(text)))
    n = F.size("__words")
    starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    window = F.transform(starts, lambda i: F.xxhash64(F.slice("__words", i, size)))
    df = df.withColumn("__windows", window)
    df = df.withColumn("__repeats", F.size("__windows") > F.size(F.array_distinct("__windows")))
    placed = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__placed", F.when(F.col("__repeats"), placed))
    same = lambda a, b: F.get(F.col("__placed"), a)["h"] == F.get(F.col("__placed"), b)["h"]
    met = F.filter("__placed", lambda p, j: ((j > 0) & same(j, j - 1)) | ((j < F.size("__placed") - 1) & same(j, j + 1)))
    df = df.withColumn("__at", F.sort_array(F.transform(met, lambda p: p["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
    covered = F.aggregate(
        "__at", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(size), p - a["last"])).alias("n"), p.alias("last"))
    )["n"]
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("__lines", lines)
    return df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("__words", "__windows", "__repeats", "__placed", "__at", "__lines")


def exploded(df: DataFrame, text: str, buckets: int) -> DataFrame:
    """One row per token with ``b1``, the token's bucket, and ``b2``, the bucket of it and the next; null without.

    Tokens are the words, then the runs of symbols.  Hashing stands behind the generator, where it is compiled;
    explode() without outer would lose empty texts and add a filter that evaluates the array twice.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__tokens", F.concat(words(F.col(text)), F.regexp_extract_all(t, F.lit(SYMBOLS), F.lit(0))))
    follow = F.slice("__tokens", 2, F.greatest(F.size("__tokens") - 1, F.lit(0)))
    df = df.withColumn("__pair", F.explode_outer(F.arrays_zip(F.col("__tokens").alias("a"), follow.alias("b")))).drop("__tokens")
    a, b = F.col("__pair")["a"], F.col("__pair")["b"]
    of = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    return df.withColumns({"b1": F.when(a.isNotNull(), of(a)), "b2": F.when(b.isNotNull(), of(a, b))}).drop("__pair")


def counts(df: DataFrame, text: str, trusted: Column, buckets: int) -> dict[int, tuple[int, int]]:
    """By bucket the number of n-grams among all rows and among those where ``trusted`` holds."""
    grams = exploded(df.select(F.coalesce(trusted, F.lit(False)).alias("trusted"), F.col(text).alias("text")), "text", buckets)
    both = grams.select("trusted", F.stack(F.lit(2), "b1", "b2").alias("bucket")).where("bucket is not null")
    rows = both.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if("trusted").alias("target")).collect()
    return {r["bucket"]: (r["raw"], r["target"]) for r in rows}


def fit(parts: Iterable[DataFrame], text: str, trusted: Column, buckets: int = 16384) -> list[float]:
    """Log ratios of the buckets: share among rows where ``trusted`` holds over share among all rows, add-one smoothed.

    The rows come in parts, each counted by itself, whose counts are summed.
    """
    raw, target = [1.0] * buckets, [1.0] * buckets
    for df in parts:
        for bucket, (n, good) in counts(df, text, trusted, buckets).items():
            raw[bucket] += n
            target[bucket] += good
    if sum(target) == buckets:
        return [0.0] * buckets
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(a) - math.log(b) + shift for a, b in zip(target, raw, strict=True)]


#: Scans of the documents, at most, that take the place of a shuffle.
MOST_SCANS = 8


def marked(docs: DataFrame, good: DataFrame, key: str) -> Iterator[DataFrame]:
    """The documents in parts, with ``good`` where their key is among the given distinct keys, which are written.

    A part has the rows and the keys of one hash value, so that about ``BROADCAST_KEYS`` keys are broadcast at a time,
    every row belongs to exactly one part, and no text is shuffled.  Every part reads the table, so where there would be
    over ``MOST_SCANS`` of them, keys and texts are joined by shuffle instead, in one part.
    """
    parts = max(1, -(-good.count() // BROADCAST_KEYS))
    if parts > MOST_SCANS:
        yield docs.join(good.withColumn("good", F.lit(True)), key, "left")
        return
    of = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(parts))
    for k in range(parts):
        yield docs.where(of == k).join(F.broadcast(good.where(of == k).withColumn("good", F.lit(True))), key, "left")


def with_ratio(df: DataFrame, text: str, ratios: list[float]) -> DataFrame:
    """Adds ``log_ratio``, the mean log ratio over a text's n-grams (0.0 without any), and drops the text.

    The sum over a row's tokens is complete after the first half of the aggregation, in the task that reads the
    row, so that one short row for each document is shuffled, whatever its length.
    """
    table = F.from_json(F.lit(json.dumps([round(x, 6) for x in ratios])), "array<double>")
    keep = [c for c in df.columns if c != text]
    rows = exploded(df.withColumn("__row", F.monotonically_increasing_id()), text, len(ratios)).drop(text)
    value = F.coalesce(F.get(table, F.col("b1")), F.lit(0.0)) + F.coalesce(F.get(table, F.col("b2")), F.lit(0.0))
    n = F.count("b1") + F.count("b2")
    mean = F.when(n > 0, F.sum(value) / n).otherwise(0.0)
    return rows.groupBy("__row", *keep).agg(mean.alias("log_ratio")).drop("__row")


#: Mean log ratio below which a document fails.
THRESHOLD = -0.25


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with base counts and the verdict; trusted are the documents that labels mark as good."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    good = written(read(spark, sf_dir, "labels").where("quality = 1 and doc_id is not null").select("doc_id").distinct(), "good")
    ratios = fit(marked(docs, good, "doc_id"), "text", F.col("good"))
    scored = with_ratio(base_columns(docs, "text"), "text", ratios)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("log_ratio") >= THRESHOLD)).alias("kept"), F.round("log_ratio", 4).alias("log_ratio"),
    )
