"""A corpus pipeline of five stages, each one operator of ``quillspark.llm`` on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs.  All but the last return the columns of ``documents``.  Rows are judged one by one; only near duplicates need
a key, for which rows that share a doc_id are one document, kept once while any of them is kept: the row whose text has
the least hash, then the least text, then the least other columns.  A row without a doc_id goes by the hash of its text,
after all that have one.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import op06_pii
from quillspark.llm.common import fold, read, scratch, without, written
from quillspark.llm.op02_jaccard_join import jaccard_join
from quillspark.llm.op04_decontamination import without_items
from quillspark.llm.op07_quality_classifier import quality_score, train
from quillspark.llm.op08_packing import packed, tokenized


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; labels are learned from the folds other than 1."""
    labels = read(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)
    model = train(docs, labels, "doc_id", "text", "quality")
    return docs.withColumn("__score", quality_score(docs, "text", model)).where("__score >= 0.5").drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least key of each near-duplicate class, once."""
    by_text = F.shiftrightunsigned(F.xxhash64(F.col("text")), 2) + (1 << 62)
    docs = docs.withColumn("__key", F.coalesce(F.col("doc_id"), by_text))
    member, _ = jaccard_join(docs, "__key", "text")
    by_key = written(member.groupBy("__key").agg(F.max(F.col("__key") == F.col("class_id")).alias("stays"), F.count(F.lit(1)).alias("n")), "kept")
    left = without(docs, "__key", by_key.where("not stays").select("__key"))
    repeated = written(by_key.where("stays and n > 1").select("__key"), "repeated")
    if not repeated.isEmpty():
        rows = left.join(repeated, "__key", "left_semi")
        order = F.struct(F.xxhash64("text"), "text", F.to_json(F.struct(*docs.columns)))
        again = rows.groupBy("__key").agg(F.min_by(F.struct(*(F.col(c) for c in docs.columns if c != "__key")), order).alias("__row")).select("__key", "__row.*")
        left = without(left, "__key", repeated).unionByName(again)
    return left.drop("__key")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain an item of the benchmark."""
    return without_items(docs, read(spark, sf_dir, "benchmark"), "text", "item_id", "text")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows the text."""
    masked = docs.withColumn("__masked", op06_pii.mask(docs, "text", op06_pii.fitted(docs, "text")))
    length = F.when(F.col("__masked") == F.col("text"), F.col("n_chars")).otherwise(F.length("__masked").cast("long"))
    return masked.withColumns({"n_chars": length, "text": F.col("__masked")}).drop("__masked")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packed(written(tokenized(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json")), "pieces"))


STAGES = [
    ("quality_classifier", quality), ("jaccard_join", near_duplicates), ("decontamination", decontamination),
    ("personal_data", personal_data), ("packing", packing),
]

#: Learned models and tokenizers cannot be expressed in SQL; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""

    def apply(docs: DataFrame, stage: tuple) -> DataFrame:
        path = scratch(spark, stage[0])
        stage[1](spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    return reduce(apply, STAGES, read(spark, sf_dir, "documents"))
