"""Chains, missing times and lost rows that small tables do not show."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq

from quillspark.operators import optimize as O
from quillspark.plans import QUERIES


def reached(edges, roots):
    done, ahead = set(roots), list(roots)
    while ahead:
        v = ahead.pop()
        new = {b for a, b in edges if a == v} - done
        done |= new
        ahead += new
    return done


def test_long_chains_and_cycles_are_walked_to_the_end(spark):
    n = 3000
    edges = [(1, k, k + 1) for k in range(n)] + [(2, k, (k + 1) % 40) for k in range(40)] + [(3, 0, 1), (3, 1, 2), (3, 1, 3), (3, 3, 3), (3, 5, 0)]
    nodes = spark.createDataFrame([(1, k) for k in range(n + 5)] + [(2, k) for k in range(45)] + [(3, k) for k in range(7)], "doc int, id int")
    roots = spark.createDataFrame([(1, 0), (2, 7), (3, 0)], "doc int, id int")
    got = O.reachable(nodes, spark.createDataFrame(edges, "doc int, a int, b int"), roots, ["doc"]).collect()
    assert {r.id for r in got if r.doc == 1} == set(range(n + 1)) and {r.id for r in got if r.doc == 2} == set(range(40))
    assert {r.id for r in got if r.doc == 3} == reached([(a, b) for d, a, b in edges if d == 3], [0])


def test_streams_and_events_without_a_time(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [dict(event_id=k, ts=None if k % 10 == 0 else start + dt.timedelta(minutes=k), user_id=k % 3, event_type="view", value=float(k % 50), props="{}") for k in range(1000)]
    schema = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])
    pq.write_table(pa.Table.from_pylist(rows, schema), tmp_path / "events.parquet")
    got = {r.start: r.jobs for r in QUERIES["usage_stream_hourly"](spark, str(tmp_path)).collect()}
    assert got.pop(None) == 100 and sum(got.values()) == 900
    over = []
    since = {}
    for r in sorted((r for r in rows if r["ts"]), key=lambda r: r["ts"]):
        u, now = r["user_id"], int((r["ts"] - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
        since[u] = (since.get(u) or now) if r["value"] > 20.0 else None
        if since[u] is not None and now - since[u] >= 3_600_000:
            over.append((u, now - since[u]))
    found = QUERIES["usage_stream_over_limit"](spark, str(tmp_path)).collect()
    assert sorted((r.user_id, r.held_ms) for r in found) == sorted(over)


def test_ranges_of_time_are_pushed_to_the_scan(spark, sf_dir):
    from quillspark.plans.usage import _ranges

    parts = _ranges(spark, sf_dir)
    assert sum(p.count() for p in parts) == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    plan = parts[1]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
