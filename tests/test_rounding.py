"""Decimals of numbers against exact arithmetic."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from picmeta.functions import text


def test_fixed_rounds_the_exact_value(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 0.5, 1.5, 0.25, 0.35, 8.45, 9.95, 0.05, -8.45, -0.01, 0.00005, 2.5e-5, 22.75845, 21.21775, 99999.99995, 1e11, 4503599627370.4, 1e16, 123456789012.34565, -3e20]
    values += [rng.randrange(1, 10**7) / 10 ** rng.randrange(1, 7) + rng.choice((0, 5)) / 10**5 for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    for places in (1, 4):
        got = df.select("v", text.fixed(F.col("v"), places).alias("t")).collect()
        for r in got:
            if r.v is None or abs(r.v) >= 1 << 63:
                assert r.t is None if r.v is None else Fraction(r.t) == Fraction(r.v)
            else:
                assert r.t == f"{r.v:.{places}f}", r.v  # Python rounds as C does


def test_positions_round_the_exact_value(spark):
    # 22 degrees, 45 minutes, 30.42 seconds: a little less than 22.75845
    assert spark.range(1).select(text.coordinate(F.lit("22/1, 45/1, 3042/100"), F.lit("N")).alias("t")).first().t == f"{22.0 + 45.0 / 60 + (3042 / 100) / 3600:.4f} N"


def test_exposure_rounds_the_exact_value(spark):
    got = spark.createDataFrame([(8.45,), (2.5,), (8.55,), (4.0,), (0.004,), (0.0,), (None,)], "v double").select("v", text.exposure(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in got} == {8.45: "8.4 s", 2.5: "2.5 s", 8.55: "8.6 s", 4.0: "4 s", 0.004: "1/250 s", 0.0: None, None: None}
