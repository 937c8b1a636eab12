"""Scalar functions of spreadsheets, as Column expressions (exact decimals as an Arrow function)."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.geometry import roman


#: Room for all digits of any double.
WIDE = Context(prec=1100)


def fixed(places: int):
    """Text with so many decimals of the exact binary value, halves away from zero: 1.005 gives 1.00 with two."""
    unit = Decimal(1).scaleb(-places)

    @F.arrow_udf("string")
    def text(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{Decimal(v).quantize(unit, ROUND_HALF_UP, WIDE):f}" for v in x.to_pylist()], pa.string())

    return text


def rounded(x: Column, places: int) -> Column:
    """Rounding by floor(x * 10^places + 0.5), as number formats do."""
    return F.floor(x * 10.0**places + 0.5) / 10.0**places


def number_format(x: Column, places: int, thousands: bool = False, percent: bool = False, prefix: str = "") -> Column:
    """The formats 0.00, #,##0.00, 0.00% and their like; a minus sign goes before the prefix."""
    v = rounded(F.abs(x) * (100.0 if percent else 1.0), places)
    plain = F.format_number(v, places) if thousands else F.replace(F.format_number(v, places), F.lit(","), F.lit(""))
    return F.concat(F.when((x < 0) & (v > 0), "-").otherwise(""), F.lit(prefix), plain, F.lit("%" if percent else ""))


def sectioned(x: Column, positive: Column, negative: Column, zero: Column) -> Column:
    """pos;neg;zero: the section of a number by its sign."""
    return F.when(x > 0, positive).when(x < 0, negative).otherwise(zero)


def column_letters(k: Column) -> Column:
    """A, B, ..., Z, AA, ... of a column number from 0 (up to three letters)."""
    letter = lambda n: F.char((F.lit(65) + n).cast("int"))
    one = letter(F.pmod(k, F.lit(26)))
    two = F.when(k >= 26, letter(F.pmod(F.floor(k / 26) - 1, F.lit(26)))).otherwise("")
    three = F.when(k >= 702, letter(F.floor((k - 702) / 676))).otherwise("")
    return F.concat(three, two, one)


def column_number(letters: Column) -> Column:
    """The number from 0 of up to three letters."""
    padded = F.lpad(letters, 3, "@")
    value = sum(((F.ascii(F.substring(padded, k + 1, 1)) - 64) * 26 ** (2 - k) for k in range(3)), F.lit(0))
    return value - 1


def day_and_second(serial: Column) -> tuple[Column, Column]:
    """Whole days and seconds of a serial number; the last ten-thousandth of a second is rounded up, into the next day if need be."""
    seconds = (serial - F.floor(serial)) * 86400
    whole = F.floor(seconds) + (seconds - F.floor(seconds) > 0.9999).cast("int")
    return (F.floor(serial) + (whole == 86400).cast("int")).cast("int"), F.when(whole == 86400, 0).otherwise(whole).cast("int")


def serial_date(serial: Column) -> Column:
    """The day of a serial number as text, yyyy-mm-dd; day 60 is 1900-02-29, which does not exist, and day 0 is 1900-01-00."""
    day, _ = day_and_second(serial)
    real = F.when(day > 60, F.date_add(F.lit("1899-12-30").cast("date"), day)).otherwise(F.date_add(F.lit("1899-12-31").cast("date"), day))
    return F.when((serial < 0) | (serial > 2958465), F.lit(None)).when(day == 60, "1900-02-29").when(day == 0, "1900-01-00").otherwise(F.date_format(real, "yyyy-MM-dd"))


def serial_time(serial: Column) -> Column:
    """The time of day of a serial number, hh:mm:ss."""
    _, s = day_and_second(serial)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("int"), F.pmod(s, F.lit(60)))


def is_date_format(code: Column) -> Column:
    """Whether a format shows a date or time: a date letter outside of quotes, brackets and escapes."""
    bare = F.regexp_replace(code, r'"[^"]*"|\\.|\[(?![hms]+\])[^\]]*\]', "")
    return bare.rlike(r"(?i)[ymdhs]") & ~bare.rlike("(?i)general")


def looks_numeric(t: Column) -> Column:
    """Cells that are set to the right."""
    return F.trim(t).rlike(r"^[-+(]?[$€£]?[0-9][0-9,. ]*%?\)?$")


def tick(v: Column, code: str) -> Column:
    """Axis text: two decimals at most, percent or thousands by the format."""
    short = lambda x: F.regexp_replace(F.regexp_replace(F.replace(F.format_number(x, 2), F.lit(","), F.lit("")), "0+$", ""), r"\.$", "")
    if "%" in code:
        return F.concat(short(v * 100), F.lit("%"))
    if "," in code:
        return F.when(F.abs(v) >= 1000, F.format_number(v.cast("long"), 0)).otherwise(short(v))
    return short(v)


def alpha(n: Column) -> Column:
    return F.lower(column_letters(F.greatest(n, F.lit(1)) - 1))


def list_number(kind: Column, n: Column) -> Column:
    """Numbers of lists by kind, such as arabicPeriod, alphaLcParenR, romanUcPeriod; anything else as arabicPeriod."""
    text = n.cast("string")
    wrap = {"arabicParenR": ("", text, ")"), "arabicParenBoth": ("(", text, ")"), "arabicPlain": ("", text, ""), "alphaLcPeriod": ("", alpha(n), "."), "alphaUcPeriod": ("", F.upper(alpha(n)), "."),
            "alphaLcParenR": ("", alpha(n), ")"), "alphaUcParenR": ("", F.upper(alpha(n)), ")"), "romanLcPeriod": ("", roman(n), "."), "romanUcPeriod": ("", F.upper(roman(n)), ".")}
    out = F.concat(text, F.lit("."))
    for name, (a, t, b) in wrap.items():
        out = F.when(kind == name, F.concat(F.lit(a), t, F.lit(b))).otherwise(out)
    return out
