"""Usage events as a stream: read from a folder, summed by event time with a watermark, written exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """The events of a folder of Parquet files as a stream of jobs, ``files`` files a batch."""
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)
    outcome = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    return events.select("event_id", "ts", "user_id", F.col("event_type").alias("tool"), outcome.alias("outcome"), F.col("value").alias("ms"))


def hourly(jobs: DataFrame, late: str = "2 hours") -> DataFrame:
    """Jobs by hour and tool; rows later than ``late`` behind the latest event are dropped."""
    w = F.window("ts", "1 hour")
    return jobs.withWatermark("ts", late).groupBy(w.alias("w"), "tool").agg(F.count(F.lit(1)).alias("jobs")).select(F.col("w.start").alias("start"), "tool", "jobs")


def without_repeats(jobs: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event id once within the watermark."""
    return jobs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes all that is there now to Parquet and returns when done."""
    query = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def write_updates(df: DataFrame, path: str, checkpoint: str):
    """Writes what changed in every batch, with the batch's number; a batch that is repeated replaces what it wrote."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = df.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest(updates: DataFrame, key: list[str]) -> DataFrame:
    """The last state of every key of written updates."""
    rest = [c for c in updates.columns if c not in (*key, "batch")]
    return updates.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")
