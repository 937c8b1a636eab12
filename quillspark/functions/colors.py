"""Colours with lists of transforms, as drawings and presentations have them.

A colour is a struct (r, g, b from 0 to 255, alpha from 0 to 1).  Transforms are a list of structs (name, val) that apply
one after another; val is in thousandths of a per cent, or sixty-thousandths of a degree where it is a hue.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RGB = ("r", "g", "b")


def _let(value: Column, f) -> Column:
    """``f`` of the value, which is computed once."""
    return F.transform(F.array(value), f)[0]


def rgb(hexadecimal: Column) -> Column:
    """The colour of six hexadecimal digits."""
    part = lambda k: F.conv(F.substring(hexadecimal, 2 * k + 1, 2), 16, 10).cast("double")
    return F.struct(*(part(k).alias(c) for k, c in enumerate(RGB)), F.lit(1.0).alias("alpha"))


def hexadecimal(color: Column) -> Column:
    """Six hexadecimal digits of a colour, channels to the nearest whole number."""
    return _let(color, lambda c: F.concat(*(F.lpad(F.hex(F.round(c[k]).cast("int")), 2, "0") for k in RGB)))


def _clamp(x: Column, most: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(x, F.lit(most)))


def to_hsl(c: Column) -> Column:
    """Hue in degrees, saturation and lightness from 0 to 1; greys have hue and saturation 0."""
    edges = F.struct(*((c[k] / 255).alias(k) for k in RGB), (F.greatest(*(c[k] for k in RGB)) / 255).alias("high"), (F.least(*(c[k] for k in RGB)) / 255).alias("low"))
    return _let(edges, _hsl)


def _hsl(e: Column) -> Column:
    r, g, b, high, low = (e[k] for k in (*RGB, "high", "low"))
    light, d = (high + low) / 2, high - low
    grey = d < 1e-12
    part = F.when(grey, 1.0).otherwise(d)
    hue = F.when(high == r, (g - b) / part + F.when(g < b, 6.0).otherwise(0.0)).when(high == g, (b - r) / part + 2).otherwise((r - g) / part + 4)
    saturation = d / F.when(grey, 1.0).when(light > 0.5, 2 - high - low).otherwise(high + low)
    return F.struct(F.when(grey, 0.0).otherwise(hue * 60).alias("h"), F.when(grey, 0.0).otherwise(saturation).alias("s"), light.alias("l"))


def from_hsl(x: Column, alpha: Column) -> Column:
    """The colour of hue, saturation and lightness."""
    h, s, light = (x[k] for k in "hsl")
    q = F.when(light < 0.5, light * (1 + s)).otherwise(light + s - light * s)

    def channels(e: Column) -> Column:
        p = 2 * e["l"] - e["q"]
        turn = lambda t: F.when(t < 1 / 6, p + (e["q"] - p) * 6 * t).when(t < 0.5, e["q"]).when(t < 2 / 3, p + (e["q"] - p) * (2 / 3 - t) * 6).otherwise(p)
        value = lambda third: F.when(e["s"] == 0, e["l"]).otherwise(_let(F.pmod(e["h"] + third, F.lit(1.0)), turn)) * 255
        return F.struct(*(value(third).alias(k) for k, third in zip(RGB, (1 / 3, 0.0, -1 / 3), strict=True)), e["alpha"].alias("alpha"))

    return _let(F.struct((F.pmod(h, F.lit(360.0)) / 360).alias("h"), s.alias("s"), light.alias("l"), q.alias("q"), alpha.alias("alpha")), channels)


def _linear(v: Column) -> Column:
    x = v / 255
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def _gamma(v: Column) -> Column:
    x = _clamp(v)
    return 255 * F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def _turned(hsl: Column, name: Column, v: Column) -> Column:
    """Hue, saturation and lightness after a transform of one of them."""
    f, degrees, h, s, light = v / 100000, v / 60000, hsl["h"], hsl["s"], hsl["l"]
    hue = F.when(name == "hueMod", h * f).when(name == "hueOff", h + degrees).when(name == "hue", degrees).when(name == "comp", h + 180).otherwise(h)
    saturation = F.when(name == "satMod", s * f).when(name == "satOff", s + f).when(name == "sat", f).otherwise(s)
    lightness = F.when(name == "lumMod", light * f).when(name == "lumOff", light + f).when(name == "lum", f).otherwise(light)
    return F.struct(hue.alias("h"), _clamp(saturation).alias("s"), _clamp(lightness).alias("l"))


def _step(c: Column, mod: Column) -> Column:
    """The colour after one transform; one that is not known changes nothing."""
    name, v = mod["name"], mod["val"].cast("double")
    f = v / 100000
    alpha = F.when(name == "alpha", f).when(name == "alphaMod", c["alpha"] * f).when(name == "alphaOff", c["alpha"] + f).otherwise(c["alpha"])
    grey = 0.299 * c["r"] + 0.587 * c["g"] + 0.114 * c["b"]

    def channel(k: str, long: str) -> Column:
        x = c[k]
        out = F.when(name == "tint", _gamma(_linear(x) * f + (1 - f))).when(name == "shade", _gamma(_linear(x) * f)).when(name == "inv", 255 - x).when(name == "gray", grey)
        return out.when(name == long, f * 255).when(name == f"{long}Mod", x * f).when(name == f"{long}Off", x + f * 255).otherwise(x)

    plain = F.struct(*(channel(k, long).alias(k) for k, long in zip(RGB, ("red", "green", "blue"), strict=True)), alpha.alias("alpha"))
    by_hsl = _let(_let(to_hsl(c), lambda hsl: _turned(hsl, name, v)), lambda x: from_hsl(x, c["alpha"]))
    return F.when(name.rlike("^(lum|sat|hue)(Mod|Off)?$|^comp$"), by_hsl).otherwise(plain)


def transformed(color: Column, mods: Column) -> Column:
    """The colour after all transforms in order; a null list counts as empty."""
    none = F.array().cast("array<struct<name: string, val: double>>")
    last = F.aggregate(F.coalesce(mods, none), color, _step)
    return F.when(color.isNotNull(), _let(last, lambda c: F.struct(*(_clamp(c[k], 255.0).alias(k) for k in RGB), _clamp(c["alpha"]).alias("alpha"))))
