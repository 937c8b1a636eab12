"""Reading order of the boxes of a page by recursive cuts.

The depth of the recursion depends on the page, so the boxes of a page are gathered and many pages are ordered in one
Arrow batch; a page is a physical unit of bounded size, and pages are spread by hash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Box = tuple[float, float, float, float, int]


def _bands(boxes: list[Box], low: int, high: int, gap: float) -> list[list[Box]]:
    """Groups of boxes that stay more than ``gap`` apart along one side."""
    out: list[list[Box]] = []
    reach = float("-inf")
    for b in sorted(boxes, key=lambda b: (b[low], b[4])):
        if not out or b[low] - reach > gap:
            out.append([])
        out[-1].append(b)
        reach = max(reach, b[high])
    return out


def reading_order(boxes: list[Box], unit: float) -> list[int]:
    """Numbers of boxes (x0, y0, x1, y1, number) in reading order.

    Horizontal cuts at gaps over 0.2 units come first, then vertical ones over 1.2 units; what cannot be cut is read
    from the top, then from the left.
    """
    pending, out = [boxes], []
    while pending:
        own = pending.pop()
        for low, high, gap in ((1, 3, 0.2 * unit), (0, 2, 1.2 * unit)):
            parts = _bands(own, low, high, gap) if len(own) > 1 else []
            if len(parts) > 1:
                pending += reversed(parts)
                break
        else:
            out += [b[4] for b in sorted(own, key=lambda b: (b[1], b[0], b[4]))]
    return out


def ordered(blocks: DataFrame, key: list[str], number: str, unit: str) -> DataFrame:
    """(key, number, place): the place in reading order of every box (x0, y0, x1, y1) of a page; ``unit`` is its body size."""

    @F.arrow_udf("array<int>")
    def order(boxes: pa.Array, units: pa.Array) -> pa.Array:
        return pa.array([reading_order([(*b.values(), i) for i, b in enumerate(own)], u) for own, u in zip(boxes.to_pylist(), units.to_pylist(), strict=True)], pa.list_(pa.int32()))

    boxes = F.sort_array(F.collect_list(F.struct(F.col(number).alias("n"), F.struct("x0", "y0", "x1", "y1").alias("at"))))
    pages = blocks.groupBy(*key).agg(boxes.alias("b"), F.max(unit).alias("u"))
    placed = pages.withColumn("o", order(F.col("b.at"), F.col("u")))
    return placed.select(*key, "b", F.posexplode("o").alias("place", "k")).select(*key, F.get(F.col("b.n"), F.col("k")).alias(number), "place")
