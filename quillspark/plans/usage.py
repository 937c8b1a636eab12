"""Queries on the log of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import usage as U
from quillspark.plans.registry import query
from quillspark.sources.shared import scratch
from quillspark.sources.tables import read, usage
from quillspark.streaming import usage as S


@query("""select event_type as tool, count(*) as jobs, count(*) filter (event_type <> 'error') as ok, round(avg(case when event_type <> 'error' then 1 else 0 end), 6) as success_rate,
    round(quantile_cont(value, 0.5), 6) as median_ms, round(quantile_cont(value, 0.95), 6) as p95_ms from events group by rollup (event_type)""")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs, success, median and 95th percentile, overall and by tool."""
    return U.summary(usage(spark, sf_dir))


@query("select time_bucket(interval '1 hour', ts) as start, event_type as tool, count(*) as jobs, round(sum(value), 2) as ms from events group by 1, 2")
def usage_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by hour and tool."""
    return U.tumbling(usage(spark, sf_dir), "1 hour").withColumn("ms", F.round("ms", 2))


@query("select time_bucket(interval '30 minutes', ts) - k * interval '30 minutes' as start, count(*) as jobs from events, (select unnest([0, 1]) as k) group by 1")
def usage_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs in every hour that starts at a half hour."""
    return U.sliding(usage(spark, sf_dir), "1 hour", "30 minutes")


@query("""with l as (select user_id, ts, coalesce(ts > lag(ts) over (partition by user_id order by ts) + interval '30 minutes', false)::int as n from events),
    s as (select *, sum(n) over (partition by user_id order by ts rows unbounded preceding) as k from l)
    select user_id, min(ts) as start, max(ts) + interval '30 minutes' as end, count(*) as jobs from s group by user_id, k""")
def usage_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with pauses under 30 minutes."""
    return U.sessions(usage(spark, sf_dir), "30 minutes")


@query("""select case when event_type = 'error' then case event_id % 3 when 0 then 'cancelled' when 1 then 'stopped' else 'error' end else 'ok' end as outcome, count(*) as n,
    sum(json_extract(props, '$.k')::bigint)::bigint as files from events group by 1""")
def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of jobs with the number of files in their properties."""
    k = F.col("event_id") % 3
    outcome = F.when(F.col("event_type") == "error", F.when(k == 0, "cancelled").when(k == 1, "stopped").otherwise("error")).otherwise("ok")
    e = read(spark, sf_dir, "events").select(outcome.alias("outcome"), F.get_json_object("props", "$.k").cast("long").alias("files"))
    return e.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("files").alias("files"))


def _ranges(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The events in ranges of time, one after the other, of which each is about RANGE_ROWS rows; three at least.

    Events without a time belong to no moment of a stream and are in no range.  Bounds are literals of the column's type,
    so that Parquet reads only the row groups of a range.
    """
    events = read(spark, sf_dir, "events").where("ts is not null")
    parts = max(3, -(-events.count() // RANGE_ROWS))
    moment = F.unix_micros(F.col("ts").cast("timestamp"))
    edges = [int(x) for x in events.select(moment.alias("m")).approxQuantile("m", [k / parts for k in range(1, parts)], 0.01)]
    at = lambda m: F.timestamp_micros(F.lit(m)).cast(events.schema["ts"].dataType)
    lows, highs = [None, *edges], [*edges, None]
    return [events.where((F.lit(True) if a is None else F.col("ts") >= at(a)) & (F.lit(True) if b is None else F.col("ts") < at(b))) for a, b in zip(lows, highs, strict=True)]


RANGE_ROWS = 50_000_000


@query("select time_bucket(interval '1 hour', ts) as start, event_type as tool, count(*) as jobs from events group by 1, 2")
def usage_stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by hour and tool: a stream that is fed range by range, its watermark dropping the state of hours gone by.

    Jobs without a time, which no watermark can place, are counted beside the stream, under a null hour.
    """
    path = scratch(spark, "hourly")
    for k, events in enumerate(_ranges(spark, sf_dir)):
        events.write.parquet(f"{path}/in/range={k}")
        S.write_updates(S.hourly(S.read_events(spark, f"{path}/in/range=*", 1000), "2 hours"), f"{path}/out", f"{path}/checkpoint")
    timed = S.latest(spark.read.parquet(f"{path}/out"), ["start", "tool"])
    rest = read(spark, sf_dir, "events").where("ts is null").groupBy(F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("jobs"))
    return timed.unionByName(rest.select(F.lit(None).cast(timed.schema["start"].dataType).alias("start"), "tool", "jobs"))


@query()
def usage_stream_over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose value stayed over the limit for an hour, by state that a stream keeps from range to range of time.

    A value without a time has no place in this order and takes no part.
    """
    path = scratch(spark, "over-limit")
    for k, events in enumerate(_ranges(spark, sf_dir)):
        events.write.parquet(f"{path}/in/range={k}")
        S.write(U.over_limit(S.read_events(spark, f"{path}/in/range=*", 1000), 20.0, 3_600_000), f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema("user_id long, ts timestamp, held_ms long").parquet(f"{path}/out")


@query("select conv_id, coalesce(sum(strlen(text)), 0)::bigint as bytes, count(*) as files from (select * from conversations qualify row_number() over (partition by conv_id order by turn) <= 2000) group by 1")
def input_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and files of the input of jobs; as in the operator, the first 2,000 files count."""
    c = read(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.octet_length("text").alias("bytes")).alias("file"))
    c = c.groupBy("conv_id").agg(F.sort_array(F.collect_list("file")).alias("files"))
    size, number = U.input_size(F.col("files"), lambda f: f["bytes"])
    return c.select("conv_id", size.alias("bytes"), number.alias("files"))
