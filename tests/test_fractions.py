"""Fractions of numbers by search; format codes that are declined."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillspark.functions import formats as N


def nearest(x, most):
    return min((Fraction(round(x * d), d) for d in range(1, most + 1)), key=lambda f: (abs(f - x), f.denominator))


def test_best_fractions(spark):
    r = random.Random(7)
    xs = [0.0, 0.5, 1 / 3, 0.3, 0.999, 0.005, 2.5, 0.125] + [r.randint(0, 9999) / r.choice([7, 100, 128, 1000, 9973]) for _ in range(200)] + [r.random() for _ in range(100)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double")
    for most in (9, 99, 999):
        for row in df.select("k", "x", N.best_fraction(F.col("x"), most).alias("f")).collect():
            best = nearest(Fraction(row.x), most)
            assert abs(abs(Fraction(row.f.p, row.f.q) - Fraction(row.x)) - abs(best - Fraction(row.x))) < 1e-11 and row.f.q <= most


@pytest.mark.parametrize(
    "x, code, text",
    [
        (2.5, "# ?/?", "2 1/2"), (0.3, "# ?/?", " 2/7"), (3.0, "# ?/?", "3    "), (0.0, "# ?/?", "0    "), (-1.25, "# ??/??", "-1  1/4 "), (0.999, "# ?/?", "1    "), (0.37, "# ?/8", " 3/8"), (1.99, "# ?/8", "2    "), (5.25, "?/?", "21/4"),
        (1.5, '"about "# ?/?" in"', "about 1 1/2 in"), (0.5, "# ?/100", " 50/100"), (12.34, "0.00", "12.34"),
    ],
)
def test_fraction_texts(spark, x, code, text):
    assert spark.range(1).select(N.formatted(F.lit(x), code)).first()[0] == text


def test_declined_codes():
    fine = ["General", "0.00", "#,##0;(#,##0)", '0.0,"k"', "d-mmm-yy", "# ?/?", "0.00E+00", "@", '[>100]"x"0;0', "_(* #,##0_)", "[h]:mm", "$#,##0", "0%", "h:mm AM/PM", "[Red]0.0", "(000) 000-0000"]
    assert [c for c in fine if N.declined(c)] == []
    assert {c: N.declined(c) for c in ("##0.0E+0", "[$-107041E]d/mm/yyyy", "bbbb", "ggge")} == {"##0.0E+0": "exponents in steps", "[$-107041E]d/mm/yyyy": "another calendar", "bbbb": "another calendar", "ggge": "another calendar"}
