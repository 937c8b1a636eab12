"""Number formats of spreadsheets: a format code becomes a Column expression when the plan is made.

A code is cut into sections (positive; negative; zero; text), a section into literals and one number pattern or date
fields.  Codes that are not supported (fractions, other calendars) give null.  Only the digits of the exact binary value
need Python, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.sheets import WIDE, day_and_second

# The codes of the numbers that workbooks use without defining them.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def _digits(x: Decimal, n: int) -> tuple[str, int]:
    """The first ``n`` digits of a positive number, halves up, and its power of ten."""
    e = x.adjusted()
    d = int(x.scaleb(n - 1 - e, WIDE).quantize(Decimal(1), ROUND_HALF_UP, WIDE))
    return (str(d)[:n], e + 1) if len(str(d)) > n else (str(d), e)


def _exponential(v: float, places: int) -> str:
    d, e = _digits(abs(Decimal(v)), places + 1) if v else ("0" * (places + 1), 0)
    return f"{'-' * (v < 0)}{d[0]}{'.' * (places > 0)}{d[1:]}e{'-' if e < 0 else '+'}{abs(e)}"


def _precise(v: float, n: int) -> str:
    d, e = _digits(abs(Decimal(v)), n) if v else ("0" * n, 0)
    sign = "-" * (v < 0)
    if e < -6 or e >= n:
        return _exponential(v, n - 1)
    if e < 0:
        return f"{sign}0.{'0' * (-e - 1)}{d}"
    return sign + (d if e == n - 1 else f"{d[: e + 1]}.{d[e + 1 :]}")


def _fixed(v: float, places: int) -> str:
    return f"{Decimal(v).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP, WIDE):f}"


def _bare(text: str) -> str:
    """Without zeros at the end of the decimals, and with two digits of exponent at least."""
    head, mark, power = text.upper().partition("E")
    head = head.rstrip("0").rstrip(".") if "." in head else head
    return head + mark + (power[0] + power[1:].zfill(2) if mark else "")


def _general(v: float) -> str:
    if v == int(v) and abs(v) < 2**31:
        return str(int(v))
    size, most = Decimal(abs(v)).adjusted(), 12 if v < 0 else 11
    if -4 <= size <= -1:
        return _bare(_precise(v, 10 + size))
    if abs(size) <= 9:
        shorter = (_bare(_fixed(v, 12)), _precise(v, 10))
        return _bare(next((t for t in shorter if len(t) <= most), _exponential(v, 5)))
    if size == 10:
        return _bare(_fixed(v, 10)[:12])
    plain = _bare(_fixed(v, 11))
    return _bare(_precise(v, 6)) if len(plain) > most or plain in ("0", "-0") else plain


def _texts(of: Callable[[float], str]):
    @F.arrow_udf("string")
    def text(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None or v - v != 0 else of(v) for v in x.to_pylist()], pa.string())

    return text


def exponential(x: Column, places: int) -> Column:
    """1.23e+4: so many decimals of the exact binary value, halves away from zero; null for infinities and NaN."""
    return _texts(lambda v: _exponential(v, places))(x)


def precise(x: Column, digits: int) -> Column:
    """So many significant digits, with an exponent below 1e-6 and where there are more digits before the point."""
    return _texts(lambda v: _precise(v, digits))(x)


def general(x: Column) -> Column:
    """The General format: whole numbers as they are, others in about eleven characters."""
    return _texts(_general)(x)


def sections(code: str) -> list[str]:
    """The code cut at semicolons outside of quotes and escapes."""
    out = []
    for text, end in re.findall(r'((?:"[^"]*"|[\\_*].|[^;"\\_*])*)(;|$)', code):
        out.append(text)
        if not end:
            break
    return out


_TOKEN = re.compile(r'"(?P<quoted>[^"]*)"|\\(?P<escaped>.)|_(?P<space>.)|\*.|\[(?P<clock>h+|m+|s+)\]|\[(?P<other>[^\]]*)\]|(?P<half>AM/PM|A/P)|(?P<field>y+|m+|d+|h+|s+|\.0+(?=[^0#?]|$))|(?P<any>.)', re.I)


def is_date(section: str) -> bool:
    """Whether a section has date fields outside of quotes, escapes and brackets."""
    found = [m for m in _TOKEN.finditer(section) if m["clock"] or m["half"] or (m["field"] and not m["field"].startswith("."))]
    return bool(found) and not section.lower().startswith("general")


def second_and_parts(serial: Column, second: Column, digits: Column) -> tuple[Column, Column]:
    """The second of the minute and its decimals, rounded together; what would round to 60 is 0, in the same minute."""
    scale = F.pow(F.lit(10), digits).cast("long")
    part = F.when(digits > 0, F.greatest((serial - F.floor(serial)) * 86400 - second, F.lit(0.0))).otherwise(0.0)
    whole = F.floor((second % 60 + part) * scale + 0.5)
    whole = F.when(whole >= 60 * scale, 0).otherwise(whole)
    return F.floor(whole / scale), whole % scale


def date_text(serial: Column, section: str) -> Column:
    """A serial number by date fields; ``m`` after hours or before seconds is minutes.  Null outside of 0 to 2958465."""
    tokens = list(_TOKEN.finditer(section))
    fields = [(m["field"] or m["clock"] or "").lower() for m in tokens]
    named = [k for k, f in enumerate(fields) if f and not f.startswith(".")]
    minutes = {k for i, k in enumerate(named) if fields[k] in ("m", "mm") and not tokens[k]["clock"] and ((i and fields[named[i - 1]][0] == "h") or (i + 1 < len(named) and fields[named[i + 1]][0] == "s"))}
    half = any(m["half"] for m in tokens)
    day, second = day_and_second(serial)
    date = F.when(day > 60, F.date_add(F.lit("1899-12-30").cast("date"), day)).otherwise(F.date_add(F.lit("1899-12-31").cast("date"), day))
    year = F.when(day <= 60, 1900).otherwise(F.year(date))
    month = F.when(day == 60, 2).when(day == 0, 1).otherwise(F.month(date))
    of_month = F.when(day == 60, 29).when(day == 0, 0).otherwise(F.dayofmonth(date))
    hour = F.floor(second / 3600)
    padded = lambda n, w: F.lpad(n.cast("string"), w, "0") if w > 1 else n.cast("string")
    name = lambda names, k, n=None: F.element_at(F.array(*(F.lit(x[:n]) for x in names)), (k + 1).cast("int"))
    digits = max((len(f) - 1 for f in fields if f.startswith(".")), default=0)
    shown_second, parts = second_and_parts(serial, second, F.lit(digits))
    out = []
    for k, m in enumerate(tokens):
        f = fields[k]
        if m["clock"]:
            total = {"h": day * 24 + hour, "m": day * 1440 + F.floor(second / 60), "s": day.cast("long") * 86400 + second}[f[0]].cast("long")
            text = total.cast("string")
            out.append(F.when(F.length(text) < len(f), F.lpad(text, len(f), "0")).otherwise(text))
        elif f.startswith("."):
            out.append(F.concat(F.lit("."), F.left(F.lpad(parts.cast("string"), digits, "0"), F.lit(len(f) - 1))))
        elif k in minutes:
            out.append(padded(F.floor(second / 60) % 60, len(f)))
        elif f:
            out.append({
                "y": lambda f=f: padded(year % 100, 2) if len(f) < 3 else padded(year, 4), "h": lambda f=f: padded(1 + (hour + 11) % 12 if half else hour, len(f)), "s": lambda f=f: padded(shown_second, len(f)),
                "m": lambda f=f: padded(month, len(f)) if len(f) < 3 else name(MONTHS, month - 1, {3: 3, 5: 1}.get(len(f))),
                "d": lambda f=f: padded(of_month, len(f)) if len(f) < 3 else name(DAYS, F.pmod(day - 1, F.lit(7)), 3 if len(f) == 3 else None),
            }[f[0]]())
        elif m["half"]:
            out.append(F.when(hour >= 12, m["half"].split("/")[1]).otherwise(m["half"].split("/")[0]))
        else:
            out.append(F.lit(_literal(m)))
    return F.when((serial >= 0) & (serial <= 2958465), F.concat(*out))


def _literal(m: re.Match) -> str:
    return m["quoted"] or m["escaped"] or (" " if m["space"] else m["any"] or "")


_PATTERN = re.compile(r"(?P<whole>[0#?][0#?,]*)?(?:\.(?P<parts>[0#?]*))?(?P<scale>,*)(?P<power>[eE][+-]0+)?")


_FRACTION = re.compile(r"(?P<whole>[#0?]+ +)?(?P<top>[#0?]+)(?P<left> ?)/(?P<right> ?)(?:(?P<bottom>[#0?]+)|(?P<fixed>\d+))")
#: Digits of a denominator that is searched for, at most.
MOST_DIGITS = 7


def best_fraction(x: Column, most: int) -> Column:
    """(p, q): the fraction nearest to ``x`` with a denominator of ``most`` at the most; of equally near ones that with the smaller one.

    The continued fraction is folded until its next convergent is too large.  The last step of a convergent may be
    taken in part: as much of it as the bound allows is compared with the convergent before.
    """
    long = lambda c: c.cast("long")
    start = F.struct(F.lit(0).cast("long").alias("p0"), F.lit(1).cast("long").alias("q0"), F.lit(1).cast("long").alias("p1"), F.lit(0).cast("long").alias("q1"), x.cast("double").alias("rest"), F.lit(False).alias("done"))

    let = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  computes the value once

    def convergent(s: Column, a: Column) -> Column:
        room = F.when(s["q1"] > 0, F.floor((most - s["q0"]) / s["q1"])).otherwise(0).cast("long")
        return F.struct((a * s["p1"] + s["p0"]).alias("p"), (a * s["q1"] + s["q0"]).alias("q"), (s["rest"] - a).alias("rest"), (room * s["p1"] + s["p0"]).alias("part_p"), (room * s["q1"] + s["q0"]).alias("part_q"))

    def chosen(s: Column, c: Column) -> Column:
        over = c["q"] > most
        nearer = (c["part_q"] > 0) & (F.abs(x - c["part_p"] / F.greatest(c["part_q"], F.lit(1))) < F.abs(x - s["p1"] / F.greatest(s["q1"], F.lit(1))) - 1e-12)
        pick = lambda now, part, before: F.when(~over, now).when(nearer, part).otherwise(before)
        ends = over | (c["rest"] < 5e-8)
        return F.struct(s["p1"].alias("p0"), s["q1"].alias("q0"), pick(c["p"], c["part_p"], s["p1"]).alias("p1"), pick(c["q"], c["part_q"], s["q1"]).alias("q1"), F.when(c["rest"] < 5e-8, 0.0).otherwise(1 / F.greatest(c["rest"], F.lit(1e-9))).alias("rest"), ends.alias("done"))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(let(let(long(F.floor(s["rest"])), lambda a: convergent(s, a)), lambda c: chosen(s, c)))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, step)
    return F.struct(found["p1"].alias("p"), found["q1"].alias("q"))


def fraction_text(x: Column, m: re.Match) -> Column:
    """A number that is not negative as a fraction: mixed where the pattern has a whole part, with a fixed or the best denominator."""
    whole = F.floor(x) if m["whole"] else F.lit(0).cast("long")
    if m["fixed"]:
        q = F.lit(int(m["fixed"])).cast("long")
        all_ = F.floor(x * int(m["fixed"]) + 0.5)
        whole = F.floor(all_ / q) if m["whole"] else whole
        p, wide = (all_ - whole * q).cast("long"), len(m["top"])
        shown_q, wide_q = F.lit(m["fixed"]), len(m["fixed"])
    else:
        wide = wide_q = min(max(len(m["top"]), len(m["bottom"])), MOST_DIGITS)
        best = best_fraction(x - whole, 10**wide - 1)
        carry = F.lit(bool(m["whole"])) & (best["p"] == best["q"])
        p, q = F.when(carry, F.lit(0).cast("long")).otherwise(best["p"]), best["q"]
        whole = whole + F.when(carry, 1).otherwise(0)
        shown_q = F.rpad(q.cast("string"), wide, " ")
    fill = F.when(F.length(p.cast("string")) < wide, F.lpad(p.cast("string"), wide, " ")).otherwise(p.cast("string"))
    part = F.concat(fill, F.lit(m["left"] + "/" + m["right"]), shown_q)
    if not m["whole"]:
        return part
    head = F.when(whole > 0, whole.cast("string")).when(p > 0, "").otherwise("0")
    return F.concat(head, F.lit(" "), F.when(p > 0, part).otherwise(" " * (wide + wide_q + 1 + len(m["left"] + m["right"]))))


#: Letters that stand for calendars other than the usual one.
_CALENDAR = re.compile(r"(?<![a-z])(?!e[+-])[beg]+\d*(?![a-z])", re.I)


def declined(code: str) -> str | None:
    """Why a format code is not supported, so that its text is null; ``None`` where it is."""
    for section in sections(code):
        bare = _CONDITION.sub("", section)
        plain = "".join("\0" if m["quoted"] is not None or m["escaped"] or m["space"] or m["clock"] or m["other"] is not None or m["half"] else m[0] for m in _TOKEN.finditer(bare))
        if re.sub(r"\0", "", plain).lower().startswith("general") or "@" in plain:
            continue
        if re.search(r"\[\$-[0-9A-F]{5,8}\]", section, re.I) or _CALENDAR.search(plain):
            return "another calendar"
        if is_date(bare):
            continue
        found = next((m for m in _PATTERN.finditer(plain) if m["whole"] or m["parts"]), None)
        if found and found["power"] and len(found["whole"] or "") != 1:
            return "exponents in steps"
    return None


def number_text(x: Column, section: str) -> Column:
    """A number that is not negative by a section with one number pattern; null for patterns that are not supported."""
    plain = "".join("\0" if not m["any"] and m["field"] is None else m[0] if m["field"] else m["any"] for m in _TOKEN.finditer(section))
    at = next((m for m in _PATTERN.finditer(plain) if m["whole"] or m["parts"]), None)
    pieces: list[Column] = []
    number, fraction = None, _FRACTION.search(plain)
    if fraction:
        at, number = fraction, fraction_text(x * 10.0 ** (2 * plain.count("%")), fraction)
    elif at:
        whole, parts = at["whole"] or "", at["parts"] or ""
        grouped = "," in whole.rstrip(",")
        scale = len(whole) - len(whole.rstrip(",")) + len(at["scale"])
        v = x * 10.0 ** (2 * plain.count("%") - 3 * scale)
        if at["power"]:
            if len(whole) != 1:
                return F.lit(None).cast("string")
            text = exponential(v, len(parts))
            power = F.regexp_extract(text, r"e[+-](\d+)$", 1)
            sign = F.when(text.contains("e-"), "-").otherwise("+" if "+" in at["power"] else "")
            number = F.concat(F.regexp_extract(text, r"^([^e]*)", 1), F.lit("E"), sign, F.when(F.length(power) < len(at["power"]) - 2, F.lpad(power, len(at["power"]) - 2, "0")).otherwise(power))
        else:
            n = F.when(v >= 2.0**52, v).otherwise(F.floor(v * 10.0 ** len(parts) + 0.5) / 10.0 ** len(parts))
            text = F.format_number(n, len(parts))
            head, tail = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
            head = head if grouped else F.replace(head, F.lit(","), F.lit(""))
            least = whole.count("0")
            head = F.when(F.floor(n) == 0, "0" * least).when(F.length(F.replace(head, F.lit(","), F.lit(""))) < least, F.lpad(head, least, "0")).otherwise(head)
            wide = len(whole.replace(",", ""))
            if "?" in whole:
                head = F.when(F.length(head) < wide, F.lpad(head, wide, " ")).otherwise(head)
            kept = len(parts.rstrip("#?"))
            short = F.concat(F.substring(tail, 1, kept), F.regexp_replace(F.substring(tail, kept + 1, len(parts)), "0+$", ""))
            tail = F.rpad(short, len(parts), " ") if parts.endswith("?") else short
            number = F.concat(head, F.lit("."), tail) if "." in at[0] else head
    spot = 0
    for m in _TOKEN.finditer(section):
        size = 1 if (m["field"] is None) else len(m[0])
        if at and at.start() <= spot < at.end():
            if spot == at.start():
                pieces.append(number)
        elif m["other"] is None and not m[0].startswith("*"):
            pieces.append(F.lit(m[0] if m["field"] else _literal(m)))
        spot += size
    return F.concat(*pieces) if pieces else F.lit("")


_CONDITION = re.compile(r"\[(=|>=?|<[>=]?)(-?\d+(?:\.\d*)?)\]")


def formatted(x: Column, code: str) -> Column:
    """The text of a number by a format code; null where the code is declined."""
    if declined(code):
        return F.when(F.lit(False), "")
    parts = sections(code)
    if "@" in parts[-1]:
        parts = parts[:-1] or ["General"]
    tests = [_CONDITION.search(p) for p in parts[:2]]

    def shown(part: str, signed: bool) -> Column:
        bare = _CONDITION.sub("", part)
        if re.sub(r"\[[^\]]*\]", "", bare).lower().startswith("general"):
            return general(x)
        if is_date(bare):
            return date_text(x, bare)
        text = number_text(F.abs(x), bare)
        return text if signed else F.concat(F.when((x < 0) & text.rlike("[1-9]"), "-").otherwise(""), text)

    if any(tests):
        holds = {"=": x.__eq__, ">": x.__gt__, "<": x.__lt__, "<>": x.__ne__, ">=": x.__ge__, "<=": x.__le__}
        first, second = (holds[t[1]](float(t[2])) if t else F.lit(False) for t in (*tests, None)[:2])
        several = len(parts) > 1
        last = parts[2] if all(tests) and len(parts) > 2 else parts[min(1, len(parts) - 1)]
        out = F.when(first, shown(parts[0], several)).when(second, shown(parts[min(1, len(parts) - 1)], several))
        return F.when(x.isNotNull(), out.otherwise(shown(last, several)))
    if len(parts) == 1:
        return shown(parts[0], False)
    zero = shown(parts[2], True) if len(parts) > 2 else shown(parts[0], True)
    return F.when(x > 0, shown(parts[0], True)).when(x < 0, shown(parts[1], True)).when(x == 0, zero)
