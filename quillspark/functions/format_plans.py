"""Number formats that are data: a code is taken apart once into a plan, a struct, and one expression shows any number by it.

``formats`` turns a code that is known when the query is written into expressions; here every row may bring a code of its
own, as cells of workbooks do.  A plan lists sections; a section is general, a date (a list of fields) or a number (a text
before it, a text after it and how its digits are laid out).
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StringType

from quillspark.functions import formats as N
from quillspark.functions.sheets import day_and_second

# What further numbers of formats mean where a file does not define them.
IMPLICIT = {
    5: '"$"#,##0_);\\("$"#,##0\\)', 6: '"$"#,##0_);[Red]\\("$"#,##0\\)', 7: '"$"#,##0.00_);\\("$"#,##0.00\\)', 8: '"$"#,##0.00_);[Red]\\("$"#,##0.00\\)',
    41: '_(* #,##0_);_(* \\(#,##0\\);_(* "-"_);_(@_)', 42: '_("$"* #,##0_);_("$"* \\(#,##0\\);_("$"* "-"_);_(@_)', 43: '_(* #,##0.00_);_(* \\(#,##0.00\\);_(* "-"??_);_(@_)', 44: '_("$"* #,##0.00_);_("$"* \\(#,##0.00\\);_("$"* "-"??_);_(@_)',
    59: "0", 60: "0.00", 61: "#,##0", 62: "#,##0.00", 63: '"$"#,##0_);\\("$"#,##0\\)', 64: '"$"#,##0_);[Red]\\("$"#,##0\\)', 65: '"$"#,##0.00_);\\("$"#,##0.00\\)', 66: '"$"#,##0.00_);[Red]\\("$"#,##0.00\\)',
    67: "0%", 68: "0.00%", 69: "# ?/?", 70: "# ??/??", 73: "d-mmm-yy", 74: "d-mmm", 75: "mmm-yy", 76: "h:mm", 78: "m/d/yy h:mm", 79: "mm:ss", 80: "[h]:mm:ss", 81: "mmss.0",
    **dict.fromkeys((*range(27, 32), 36, *range(50, 59), 71, 72), "m/d/yy"), **dict.fromkeys((*range(32, 36), 77), "h:mm:ss"),
}

_FIELD = pa.struct([("kind", pa.string()), ("text", pa.string())])
_INTS = lambda *names: [(n, pa.int32()) for n in names]
_NUMBER = pa.struct([*_INTS("power", "least", "wide", "places", "kept", "exponent"), *((n, pa.bool_()) for n in ("grouped", "spaced", "point", "plus"))])
_FRACTION = pa.struct([("whole", pa.bool_()), *_INTS("wide", "wide_q"), ("fixed", pa.int64()), ("before", pa.string()), ("behind", pa.string())])
_SECTION = pa.struct([("kind", pa.string()), ("half", pa.bool_()), ("fields", pa.list_(_FIELD)), ("head", pa.string()), ("tail", pa.string()), ("number", _NUMBER), ("fraction", _FRACTION)])
_TEST = pa.struct([("op", pa.string()), ("value", pa.float64())])
#: The type of a plan, for Arrow and for Spark.
ARROW_PLAN = pa.struct([("code", pa.string()), ("declined", pa.string()), ("tests", pa.list_(_TEST)), ("sections", pa.list_(_SECTION))])
PLAN = from_arrow_type(ARROW_PLAN)


def _date_fields(section: str) -> tuple[bool, list[dict]]:
    """The fields of a date section by name; ``m`` after hours or before seconds is ``n``, minutes."""
    tokens = list(N._TOKEN.finditer(section))
    fields = [(m["field"] or m["clock"] or "").lower() for m in tokens]
    named = [k for k, f in enumerate(fields) if f and not f.startswith(".")]
    out = []
    for k, (m, f) in enumerate(zip(tokens, fields, strict=True)):
        if m["clock"]:
            out.append({"kind": f"[{f[0]}]", "text": "0" * len(f)})
        elif f.startswith("."):
            out.append({"kind": ".", "text": f[1:]})
        elif f:
            place = named.index(k)
            beside = (place and fields[named[place - 1]][0] == "h") or (place + 1 < len(named) and fields[named[place + 1]][0] == "s")
            if f in ("m", "mm") and beside:
                f = "n" * len(f)
            least, most = {"y": (2, 4), "m": (1, 5), "d": (1, 4)}.get(f[0], (1, 2))
            size = min(max(len(f), least), most)
            out.append({"kind": f[0] * (4 if f[0] == "y" and size == 3 else size), "text": None})
        elif m["half"]:
            out.append({"kind": "half", "text": m["half"]})
        else:
            out.append({"kind": "text", "text": N._literal(m)})
    return any(m["half"] for m in tokens), out


def _section(code: str) -> dict:
    out = {"kind": "general", "half": False, "fields": [], "head": "", "tail": "", "number": None, "fraction": None}
    if re.sub(r"\[[^\]]*\]", "", code).lower().startswith("general"):
        return out
    if N.is_date(code):
        half, fields = _date_fields(code)
        return out | {"kind": "date", "half": half, "fields": fields}
    tokens = list(N._TOKEN.finditer(code))
    plain = "".join("\0" if not m["any"] and m["field"] is None else m[0] if m["field"] else m["any"] for m in tokens)
    at = fraction = N._FRACTION.search(plain)
    at = at or next((m for m in N._PATTERN.finditer(plain) if m["whole"] or m["parts"]), None)
    ends, spot = ["", ""], 0
    for m in tokens:
        if not (at and at.start() <= spot < at.end()) and m["other"] is None and not m[0].startswith("*"):
            ends[bool(at) and spot >= at.end()] += m[0] if m["field"] else N._literal(m)
        spot += 1 if m["field"] is None else len(m[0])
    out |= {"kind": "number", "head": ends[0], "tail": ends[1]}
    percent = 2 * plain.count("%")
    if fraction:
        f = fraction
        wide = len(f["top"]) if f["fixed"] else min(max(len(f["top"]), len(f["bottom"])), N.MOST_DIGITS)
        shape = {"whole": bool(f["whole"]), "wide": wide, "wide_q": len(f["fixed"]) if f["fixed"] else wide, "fixed": int(f["fixed"]) if f["fixed"] else None, "before": f["left"], "behind": f["right"]}
        return out | {"fraction": shape, "number": {"power": percent}}
    if at:
        whole, parts, power = at["whole"] or "", at["parts"] or "", at["power"]
        bare = whole.rstrip(",")
        shape = {"power": percent - 3 * (len(whole) - len(bare) + len(at["scale"])), "least": whole.count("0"), "wide": len(whole.replace(",", "")) * ("?" in whole), "grouped": "," in bare}
        shape |= {"places": len(parts), "kept": len(parts.rstrip("#?")), "spaced": parts.endswith("?"), "point": "." in at[0], "exponent": len(power) - 2 if power else None, "plus": bool(power) and "+" in power}
        return out | {"number": shape}
    return out


@lru_cache(4096)
def plan(code: str) -> dict:
    """The plan of a code; one that is declined says why and has no sections."""
    reason = N.declined(code)
    parts = N.sections(code)
    if "@" in parts[-1]:
        parts = parts[:-1] or ["General"]
    tests = [N._CONDITION.search(p) for p in parts[:2]]
    if reason:
        return {"code": code, "declined": reason, "tests": [], "sections": []}
    tests = [{"op": t[1] if t else None, "value": float(t[2]) if t else None} for t in tests] if any(tests) else []
    return {"code": code, "declined": None, "tests": tests, "sections": [_section(N._CONDITION.sub("", p)) for p in parts[:3]]}


@F.arrow_udf(PLAN)
def plans(codes: pa.Array) -> pa.Array:
    """The plans of codes; null for null."""
    return pa.array([None if c is None else plan(c) for c in codes.to_pylist()], ARROW_PLAN)


@F.arrow_udf(StringType())
def _exponentials(x: pa.Array, places: pa.Array) -> pa.Array:
    rows = zip(x.to_pylist(), places.to_pylist(), strict=True)
    return pa.array([None if v is None or p is None or v - v != 0 else N._exponential(v, p) for v, p in rows], pa.string())


def _padded(text: Column, width: Column | int, fill: str) -> Column:
    """Filled from the left; longer texts stay."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.when(F.length(text) < width, F.lpad(text, width, F.lit(fill))).otherwise(text)


def _date(serial: Column, section: Column) -> Column:
    """A serial number by the fields of a date section; null outside of 0 to 2958465."""
    return F.transform(F.array(F.struct(*(c.alias(n) for c, n in zip((serial, *day_and_second(serial)), ("x", "day", "second"), strict=True)))), lambda k: _fields(k["x"], k["day"], k["second"], section))[0]


def _fields(serial: Column, day: Column, second: Column, section: Column) -> Column:
    date = F.date_add(F.when(day > 60, F.lit("1899-12-30")).otherwise("1899-12-31").cast("date"), day)
    year = F.when(day <= 60, 1900).otherwise(F.year(date)).cast("string")
    month = F.when(day == 60, 2).when(day == 0, 1).otherwise(F.month(date))
    of_month = F.when(day == 60, 29).when(day == 0, 0).otherwise(F.dayofmonth(date)).cast("string")
    hour, minute = F.floor(second / 3600), F.floor(second / 60)
    shown_hour = F.when(section["half"], 1 + (hour + 11) % 12).otherwise(hour).cast("string")
    name = lambda names, k: F.split_part(F.lit(" ".join(names)), F.lit(" "), k.cast("int"))
    of_week = F.pmod(day - 1, F.lit(7)) + 1
    digits = F.coalesce(F.array_max(F.transform(F.filter(section["fields"], lambda f: f["kind"] == "."), lambda f: F.length(f["text"]))), F.lit(0))
    shown_second, parts = N.second_and_parts(serial, second, digits)
    one = {"yyyy": year, "m": month.cast("string"), "d": of_month, "h": shown_hour, "n": (minute % 60).cast("string"), "s": shown_second.cast("string")}
    texts = {"yy": F.substring(year, 3, 2), **one, **{2 * k: F.lpad(one[k], 2, "0") for k in "mdhns"}}
    texts |= {"mmm": F.left(name(N.MONTHS, month), F.lit(3)), "mmmm": name(N.MONTHS, month), "mmmmm": F.left(name(N.MONTHS, month), F.lit(1)), "ddd": F.left(name(N.DAYS, of_week), F.lit(3)), "dddd": name(N.DAYS, of_week)}

    def shown(f: Column) -> Column:
        clocks = {"[h]": day * 24 + hour, "[m]": day * 1440 + minute, "[s]": day.cast("long") * 86400 + second}
        out = F.when(f["kind"] == "text", f["text"]).when(f["kind"] == "half", F.split_part(f["text"], F.lit("/"), F.when(hour >= 12, 2).otherwise(1)))
        for kind, text in texts.items():
            out = out.when(f["kind"] == kind, text)
        for kind, total in clocks.items():
            out = out.when(f["kind"] == kind, _padded(total.cast("long").cast("string"), F.length(f["text"]), "0"))
        return out.when(f["kind"] == ".", F.concat(F.lit("."), F.left(_padded(parts.cast("string"), digits, "0"), F.length(f["text"]))))

    return F.when((serial >= 0) & (serial <= 2958465), F.array_join(F.transform(section["fields"], shown), ""))


def _fraction(x: Column, f: Column) -> Column:
    """A number that is not negative as a fraction, by the shape of it."""
    mixed = F.when(f["whole"], F.floor(x)).otherwise(0)
    best = N.best_fraction(x - mixed, (F.pow(F.lit(10), f["wide"]) - 1).cast("long"))
    eighths = F.floor(x * f["fixed"] + 0.5)
    let = lambda value, g: F.transform(F.array(value), g)[0]  # noqa: E731  computes the value once

    def carried(b: Column) -> Column:
        over = f["whole"] & (b["p"] == b["q"])
        return F.struct((mixed + over.cast("int")).cast("long").alias("n"), F.when(over, 0).otherwise(b["p"]).cast("long").alias("p"), F.rpad(b["q"].cast("string"), f["wide"], F.lit(" ")).alias("q"))

    stepped_n = F.when(f["whole"], F.floor(eighths / f["fixed"])).otherwise(0)
    stepped = F.struct(stepped_n.cast("long").alias("n"), (eighths - stepped_n * f["fixed"]).cast("long").alias("p"), f["fixed"].cast("string").alias("q"))

    def text(r: Column) -> Column:
        part = F.concat(_padded(r["p"].cast("string"), f["wide"], " "), f["before"], F.lit("/"), f["behind"], r["q"])
        head = F.when(r["n"] > 0, r["n"].cast("string")).when(r["p"] > 0, "").otherwise("0")
        blank = F.repeat(F.lit(" "), f["wide"] + f["wide_q"] + 1 + F.length(f["before"]) + F.length(f["behind"]))
        return F.when(~f["whole"], part).otherwise(F.concat(head, F.lit(" "), F.when(r["p"] > 0, part).otherwise(blank)))

    return let(F.when(f["fixed"].isNotNull(), stepped).otherwise(let(best, carried)), text)


def _number(x: Column, n: Column, exponential: Column) -> Column:
    """A number that is not negative by the layout of its digits; ``exponential`` is its text with an exponent."""
    v = x * F.pow(F.lit(10.0), n["power"])
    scale = F.pow(F.lit(10.0), n["places"])
    whole = F.when(v >= 2.0**52, v).otherwise(F.floor(v * scale + 0.5) / scale)
    text = F.call_function("format_number", whole, n["places"])
    head, tail = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    bare = F.replace(head, F.lit(","), F.lit(""))
    head = F.when(F.floor(whole) == 0, F.repeat(F.lit("0"), n["least"])).when(F.length(bare) < n["least"], F.lpad(bare, n["least"], F.lit("0"))).when(n["grouped"], head).otherwise(bare)
    head = _padded(head, n["wide"], " ")
    short = F.concat(F.left(tail, n["kept"]), F.regexp_replace(F.substr(tail, n["kept"] + 1), "0+$", ""))
    tail = F.when(n["spaced"], F.rpad(short, n["places"], F.lit(" "))).otherwise(short)
    plain = F.when(n["point"], F.concat(head, F.lit("."), tail)).otherwise(head)
    power = _padded(F.regexp_extract(exponential, r"e[+-](\d+)$", 1), n["exponent"], "0")
    sign = F.when(exponential.contains("e-"), "-").when(n["plus"], "+").otherwise("")
    return F.when(n["exponent"].isNotNull(), F.concat(F.split_part(exponential, F.lit("e"), F.lit(1)), F.lit("E"), sign, power)).otherwise(plain)


def chosen_section(x: Column, plan: Column) -> Column:
    """The section that shows a number: by the conditions of the plan, else by the number's sign."""
    n, tests = F.size(plan["sections"]), plan["tests"]

    def holds(k: int) -> Column:
        t = F.get(tests, F.lit(k))
        ops = {"=": x == t["value"], ">": x > t["value"], "<": x < t["value"], "<>": x != t["value"], ">=": x >= t["value"], "<=": x <= t["value"]}
        out = F.lit(False)
        for op, test in ops.items():
            out = F.when(t["op"] == op, test).otherwise(out)
        return F.coalesce(out, F.lit(False))

    both = F.get(tests, F.lit(0))["op"].isNotNull() & F.get(tests, F.lit(1))["op"].isNotNull()
    last = F.when(both & (n > 2), 2).otherwise(F.least(F.lit(1), n - 1))
    tested = F.when(holds(0), 0).when(holds(1), F.least(F.lit(1), n - 1)).otherwise(last)
    signed = F.when(x > 0, 0).when(x < 0, F.least(F.lit(1), n - 1)).when(n > 2, 2).otherwise(0)
    return F.get(plan["sections"], F.when(F.size(tests) > 0, tested).otherwise(signed))


def shown(x: Column, plan: Column) -> Column:
    """The text of a number by a plan; null where the plan's code is declined, in general form for a null plan."""
    section = chosen_section(x, plan)
    plainly = plan.isNull() | (section["kind"] == "general")
    of_power = F.when(section["number"]["exponent"].isNotNull(), F.abs(x) * F.pow(F.lit(10.0), section["number"]["power"]))
    known = F.struct(
        x.alias("x"), section.alias("s"), (F.size(plan["sections"]) == 1).alias("alone"), plainly.alias("plainly"), N.general(F.when(plainly, x)).alias("general"), _exponentials(of_power, section["number"]["places"]).alias("power"),
    )

    def text(k: Column) -> Column:
        s, size, n = k["s"], F.abs(k["x"]), k["s"]["number"]
        digits = F.when(s["fraction"].isNotNull(), _fraction(size * F.pow(F.lit(10.0), n["power"]), s["fraction"])).when(n.isNotNull(), _number(size, n, k["power"])).otherwise("")
        whole = F.concat(s["head"], digits, s["tail"])
        signed = F.transform(F.array(whole), lambda t: F.concat(F.when((k["x"] < 0) & k["alone"] & t.rlike("[1-9]"), "-").otherwise(""), t))[0]
        return F.when(k["plainly"], k["general"]).when(s["kind"] == "date", _date(k["x"], s)).when((s["kind"] == "number") & k["x"].isNotNull(), signed)

    return F.transform(F.array(known), text)[0]
