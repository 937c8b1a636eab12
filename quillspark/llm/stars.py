"""Connected components of a table of links by alternating star contraction.

Each round maps every edge to the least neighbour of one end, until the edges no longer change: then they are stars
around the roots.  Rounds grow with the logarithm of a component's size, and only ids move.  All edges of a large
component meet at few ids; the neighbours of ids with more than ``CROWD`` edges are looked up by broadcast, or, if there
are too many such ids, by copies of theirs in ``SALTS`` places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_KEYS, written

CROWD, SALTS = 256, 32


def looked_up(edges: DataFrame, by_v: DataFrame, *others: str) -> DataFrame:
    """``edges`` (v, others...; u if none are named) with ``m`` of ``by_v`` (v, m, n), n being the number of edges of v."""
    others = others or ("u",)
    by_v = written(by_v, "by-id")
    crowded = by_v.where(F.col("n") > CROWD)
    n = crowded.count()
    if not n:
        return edges.join(by_v.drop("n"), "v").select("v", *others, "m")
    if n <= BROADCAST_KEYS:
        held = F.broadcast(crowded.select("v", F.struct("m").alias("found")))
        split = edges.join(held, "v", "left")
        rest = split.where("found is null").select("v", *others).join(by_v.where(F.col("n") <= CROWD).drop("n"), "v")
        return split.where("found is not null").select("v", *others, "found.m").unionByName(rest.select("v", *others, "m"))
    places = F.when(F.col("n") > CROWD, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    own = F.explode(F.array(F.lit(-1), F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int")))
    return edges.withColumn("salt", own).join(by_v.withColumn("salt", F.explode(places)), ["v", "salt"]).select("v", *others, "m")


def components(links: DataFrame) -> DataFrame:
    """(v, root): the least id of the component of every linked id that is not itself the least; links are (a, b)."""
    edges, before = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u != v").distinct(), None
    edges = written(edges, "edges")
    while True:
        both = edges.unionAll(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = written(looked_up(both, least).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct(), "large-stars")
        low = large.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
        small = looked_up(large, low).where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = written(small.unionAll(low.select("v", F.col("m").alias("u"))).distinct(), "small-stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select("v", F.col("u").alias("root"))
        before = now
