"""Formats that are data show numbers as formats that are known to the query do."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import format_plans as P
from quillspark.functions import formats as N

CODES = [
    *(c for c in N.BUILT_IN.values() if c not in ("@", "##0.0E+0")),
    '[>100000]"large "0.0,"k";[<0]"debt "0;0', '[<=5]"low";[>1000]"high "#,##0;0.0', "[=0]\"none\";General", "0.0##", "?0.0??", "#,##0.00_);[Red](#,##0.00)", '0;-0;"zero"', "yyyy-mm-dd hh:mm:ss.000", "yyy dddd mmmmm", "[mm]:ss", "[ss]",
    "h AM/PM", "h:mm A/P", "# ??/100", "?/?", "0.000E-00", "0%;(0.0%)", "#,##0,", "0.0,,\"M\"", "General;-0", '"only text"', "00000", "#", "#.##",
]
NUMBERS = [0.0, 1.0, -1.0, 0.5, -0.004, 3.25, 12.345, -12.345, 59.0, 60.0, 61.75, 999.995, 1234.5678, -98765.4321, 45123.654321, 45123.99999999, 123456.0, 1e9, 2958466.0, 1e-7]


def test_plans_show_numbers_as_codes_do(spark):
    x = spark.createDataFrame([(v,) for v in NUMBERS], "x double")
    codes = spark.createDataFrame([(c,) for c in CODES], "code string")
    by_plan = codes.select("code", P.plans(F.col("code")).alias("plan")).crossJoin(x).select("code", "x", P.shown(F.col("x"), F.col("plan")).alias("t"))
    got = {(r.code, r.x): r.t for r in by_plan.collect()}
    for lo in range(0, len(CODES), 8):
        part = CODES[lo : lo + 8]
        for r in x.select("x", *(N.formatted(F.col("x"), c).alias(f"c{k}") for k, c in enumerate(part))).collect():
            for k, c in enumerate(part):
                assert got[c, r.x] == r[f"c{k}"], (c, r.x)


@pytest.mark.parametrize("code", ["[$-1010000]yyyy", "b1yyyy", "##0.0E+0"])
def test_declined_codes_say_why(code):
    assert P.plan(code)["declined"] and not P.plan(code)["sections"]


def test_null_numbers_and_plans(spark):
    rows = spark.createDataFrame([(1.5, None), (None, "0.0"), (None, None), (float("nan"), "General"), (2.0, "")], "x double, code string")
    got = rows.select(P.shown(F.col("x"), P.plans(F.col("code"))).alias("t")).collect()
    assert [r.t for r in got] == ["1.5", None, None, None, ""]


def test_seconds_are_rounded_with_their_decimals(spark):
    day = 86400.0
    rows = spark.createDataFrame([(1.25 / day, "ss.0"), (59.96 / day, "mm:ss.0"), (59.94 / day, "mm:ss.0"), (0.05 / day, "s.00"), (7.9996 / day, "ss.000")], "x double, code string")
    got = [r.t for r in rows.select(P.shown(F.col("x"), P.plans(F.col("code"))).alias("t")).collect()]
    assert got == ["01.3", "00:00.0", "00:59.9", "0.05", "08.000"]
