"""Scalar functions of page geometry, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MM = 72 / 25.4


def anchor(page_w: Column, page_h: Column, w: Column, h: Column, position: Column, margin: Column) -> tuple[Column, Column]:
    """Lower left corner of a w x h box at one of nine positions, origin at the lower left of the page."""
    x = F.when(position.endswith("left"), margin).when(position.endswith("right"), page_w - w - margin).otherwise((page_w - w) / 2)
    y = F.when(position.startswith("top"), page_h - h - margin).when(position.startswith("bottom"), margin).otherwise((page_h - h) / 2)
    return x, y


def turned_box(w: Column, h: Column, degrees: Column) -> tuple[Column, Column]:
    """Width and height of the bounding box of a turned w x h box."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.abs(w * c) + F.abs(h * s), F.abs(w * s) + F.abs(h * c)


def turned_placement(page_w: Column, page_h: Column, w: Column, h: Column, degrees: Column, position: Column, margin: Column) -> tuple[Column, Column]:
    """Origin that makes a box turn about its own centre with its bounding box at the position."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    bw, bh = turned_box(w, h, degrees)
    x, y = anchor(page_w, page_h, bw, bh, position, margin)
    return x + bw / 2 - (w / 2 * c - h / 2 * s), y + bh / 2 - (w / 2 * s + h / 2 * c)


def mirrored(position: Column) -> Column:
    """The position with left and right exchanged at its end."""
    return F.when(position.endswith("left"), F.regexp_replace(position, "left$", "right")).when(position.endswith("right"), F.regexp_replace(position, "right$", "left")).otherwise(position)


def roman(n: Column) -> Column:
    """Lower-case Roman numerals; numbers below 1 count as 1."""
    n = F.greatest(n.cast("int"), F.lit(1))
    digit = lambda names, unit: F.element_at(F.array(*map(F.lit, names)), (F.floor(n / unit) % 10 + 1).cast("int"))
    ones = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]
    tens = ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"]
    hundreds = ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"]
    return F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), digit(hundreds, 100), digit(tens, 10), digit(ones, 1))


def rgb(color: Column) -> Column:
    """struct<r, g, b> in 0..1 of ``#rrggbb`` or ``#rgb``; null for anything else."""
    plain = F.regexp_replace(color, "^#", "")
    full = F.when(plain.rlike("^[0-9A-Fa-f]{3}$"), F.regexp_replace(plain, "(.)", "$1$1")).when(plain.rlike("^[0-9A-Fa-f]{6}$"), plain)
    part = lambda k: F.conv(F.substring(full, k, 2), 16, 10).cast("int") / 255
    return F.when(full.isNotNull(), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def half_up(x: Column) -> Column:
    """Rounding by floor(x + 0.5), halves towards plus infinity."""
    return F.floor(x + 0.5)


def viewer_matrix(x0: Column, y0: Column, x1: Column, y1: Column, rotate: Column) -> Column:
    """struct<a, b, c, d, e, f, width, height>: from a page as it is seen (origin at the lower left) to the page's own space.

    Quarter turns are rounded from any angle; width and height are those of the page as it is seen.
    """
    quarter = F.pmod(half_up(rotate / 90), F.lit(4))
    by_turn = lambda *values: F.when(quarter == 1, values[1]).when(quarter == 2, values[2]).when(quarter == 3, values[3]).otherwise(values[0])
    w, h = x1 - x0, y1 - y0
    one = lambda *v: by_turn(*map(F.lit, map(float, v)))
    return F.struct(
        one(1, 0, -1, 0).alias("a"), one(0, 1, 0, -1).alias("b"), one(0, -1, 0, 1).alias("c"), one(1, 0, -1, 0).alias("d"), by_turn(x0, x1, x1, x0).alias("e"), by_turn(y0, y0, y1, y1).alias("f"),
        by_turn(w, h, w, h).alias("width"), by_turn(h, w, h, w).alias("height"),
    )


def burnt_box(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, scale: float = 2.5) -> Column:
    """struct<x0, y0, x1, y1>: the pixels that a box blackens, rounded outwards and kept on the page."""
    at = lambda v, most, turn: F.least(F.greatest(turn(v * scale), F.lit(0)), turn(most * scale)).cast("long")
    return F.struct(at(x, page_w, F.floor).alias("x0"), at(y, page_h, F.floor).alias("y0"), at(x + w, page_w, F.ceil).alias("x1"), at(y + h, page_h, F.ceil).alias("y1"))
