"""Operators on the log of jobs: summaries by tool, and its streaming forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Classes of values that a first count tells apart.
CLASSES = 4096


def quantiles(rows: DataFrame, key: str, value: str, at: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles by key, and over all rows (key null): one column for each name of ``at``.

    Rows are first counted by key and class of value, equal widths between the least and the largest.  The counts tell
    in which classes the ranks asked for lie; only those classes are then counted value by value.  No group of values is
    gathered, and both counts are combined before they are shuffled.
    """
    low, high = rows.agg(F.min(value), F.max(value)).first()
    width = ((high or 0) - (low or 0)) / CLASSES or 1.0
    classed = rows.select(F.col(key), F.col(value).alias("v"), F.floor((F.col(value) - F.lit(low)) / width).alias("c")).where("v is not null")
    both = lambda n, *by: n.unionAll(n.groupBy(*by).agg(F.sum("n").alias("n")).select(*by, F.lit(None).cast(dict(rows.dtypes)[key]).alias(key), F.lit(True).alias("all"), "n"))
    counted = both(classed.groupBy("c", key).agg(F.count(F.lit(1)).alias("n")).select("c", key, F.lit(False).alias("all"), "n"), "c")
    group = Window.partitionBy("all", key)
    upto = F.sum("n").over(group.orderBy("c")).alias("upto")
    spans = counted.select("all", key, "c", "n", upto, F.sum("n").over(group).alias("total"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("total") - 1)).alias("rank")) for name, p in at.items()))).alias("w")
    spans = spans.select("all", key, "c", (F.col("upto") - F.col("n")).alias("before"), "upto", wanted).select("all", key, "c", "before", "upto", "w.*")
    spans = spans.where((F.floor("rank") < F.col("upto")) & (F.ceil("rank") >= F.col("before")))
    classes = spans.select("all", key, "c", "before").distinct()
    inside = classed.join(F.broadcast(classes.select("c").distinct()), "c")
    values = both(inside.groupBy("c", "v", key).agg(F.count(F.lit(1)).alias("n")).select("c", "v", key, F.lit(False).alias("all"), "n"), "c", "v")
    same = F.col("a.all").eqNullSafe(F.col("b.all")) & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")) & (F.col("a.c") == F.col("b.c"))
    placed = values.alias("a").join(classes.alias("b"), same).select("a.all", f"a.{key}", "a.c", "a.v", "a.n", "b.before")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("all", key, "c").orderBy("v"))
    placed = placed.withColumn("upto", upto).withColumn("first", F.col("upto") - F.col("n"))
    met = placed.alias("a").join(spans.alias("b"), same).select("a.all", f"a.{key}", "b.name", "b.rank", "a.v", "a.first", "a.upto")
    pick = lambda r: F.max(F.when((F.col("first") <= r) & (r < F.col("upto")), F.col("v")))
    by_name = met.groupBy("all", key, "name").agg(pick(F.floor("rank")).alias("lo"), pick(F.ceil("rank")).alias("hi"), F.max(F.col("rank") - F.floor("rank")).alias("part"))
    value_of = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")
    return by_name.groupBy("all", key).agg(*(F.max(F.when(F.col("name") == name, value_of)).alias(name) for name in at))


def summary(usage: DataFrame) -> DataFrame:
    """Jobs, success rate, median and 95th percentile of milliseconds, overall (tool null) and by tool."""
    g = usage.rollup("tool").agg(
        F.grouping("tool").cast("boolean").alias("all"), F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("outcome") == "ok").alias("ok"), F.round(F.avg((F.col("outcome") == "ok").cast("int")), 6).alias("success_rate"),
    )
    q = quantiles(usage, "tool", "ms", {"median_ms": 0.5, "p95_ms": 0.95}).withColumnsRenamed({"all": "of_all", "tool": "of_tool"})
    joined = g.join(q, (F.col("all") == F.col("of_all")) & F.col("tool").eqNullSafe(F.col("of_tool")), "left")
    return joined.select("tool", "jobs", "ok", "success_rate", F.round("median_ms", 6).alias("median_ms"), F.round("p95_ms", 6).alias("p95_ms"))


def tumbling(usage: DataFrame, width: str) -> DataFrame:
    w = F.window("ts", width)
    return usage.groupBy(w.alias("w"), "tool").agg(F.count(F.lit(1)).alias("jobs"), F.sum("ms").alias("ms")).select(F.col("w.start").alias("start"), "tool", "jobs", "ms")


def sliding(usage: DataFrame, width: str, slide: str) -> DataFrame:
    w = F.window("ts", width, slide)
    return usage.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("jobs")).select(F.col("w.start").alias("start"), "jobs")


def sessions(usage: DataFrame, gap: str) -> DataFrame:
    """Sessions of users: jobs without a pause of ``gap``."""
    w = F.session_window("ts", gap)
    return usage.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("jobs")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "jobs")


def over_limit(samples: DataFrame, limit: float, hold_ms: int) -> DataFrame:
    """Streaming: (user_id, ts, held_ms) when a user's value has been over the limit for ``hold_ms`` without a sample below it.

    State by user is the time since when the value is over; events of a batch are taken in order of time.
    """
    schema = "user_id long, ts timestamp, held_ms long"

    def watch(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else None
        rows = pd.concat([p[["ts", "ms"]] for p in parts]).dropna(subset=["ts"]).sort_values(["ts", "ms"], ignore_index=True)
        over = rows["ms"] > limit
        now = rows["ts"].astype("datetime64[ms]").astype("int64")
        begins = now.where(over & ~over.shift(fill_value=since is not None))
        if since is not None and len(rows) and over[0]:
            begins[0] = since
        began = begins.ffill().where(over)
        hit = rows[over & (now - began >= hold_ms)]
        if len(rows):
            since = int(began.iloc[-1]) if over.iloc[-1] else None
        state.update((since,)) if since is not None else state.remove() if state.exists else None
        held = (now - began)[hit.index].astype("int64")
        yield pd.DataFrame({"user_id": key[0], "ts": hit["ts"], "held_ms": held})

    return samples.groupBy("user_id").applyInPandasWithState(watch, schema, "since long", "append", "NoTimeout")


MOST_FILES = 2000


def input_size(files: Column, size, most: int = MOST_FILES) -> tuple[Column, Column]:
    """Bytes and number of the first ``most`` files of a job's input; ``size`` gives the bytes of one."""
    counted = F.slice(files, 1, most)
    return F.aggregate(counted, F.lit(0).cast("long"), lambda s, f: s + F.coalesce(size(f), F.lit(0)).cast("long")), F.size(counted).cast("long")
