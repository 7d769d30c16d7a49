from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ranktab.functions.bins import round_half_up
from ranktab.operators import calibrate


def test_round_half_up_equals_round(spark):
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, -1e-9, 1e300, -1e22, 2.5e-7, 5e-7, -5e-7, 0.1234565, 0.1234575, 1.0000005, -2.0000015, 68719.4767355, 1e10 + 0.5]
    rows = spark.createDataFrame([(x,) for x in odd], "x double")
    rows = rows.unionByName(spark.range(20_000).select(((F.rand(3) - 0.5) * F.pow(F.lit(10.0), F.col("id") % 14)).alias("x")))
    rows = rows.unionByName(spark.range(20_000).select(((F.col("id") * 2 + 1) / 2e6).alias("x")))
    for digits in (3, 6, 9):
        both = rows.select("x", F.round("x", digits).alias("a"), round_half_up(F.col("x"), digits).alias("b"))
        assert both.where(~F.col("a").eqNullSafe(F.col("b"))).collect() == []


def test_moves_skip_rows_without_place(spark):
    nan = float("nan")
    rows = [(0, [0.5, 0.3, 0.2, 0.1]), (3, [0.5, 0.3, 0.2, 0.1]), (None, [0.1] * 4), (1, None), (2, [0.1, None, 0.3, 0.2]), (7, [0.1] * 4), (1, [0.2]), (2, [nan, 0.1, nan, 0.1])]
    df = spark.createDataFrame(rows, "y int, proba array<double>")
    base, moves = calibrate.score_moves(df, [1.0] * 4, factors=(2.0,))
    assert base == (1 + 1) / 8  # rows 0 (first), 3 (fourth: nothing) and the last (first of equal ones)
    assert moves[(3, 2.0)] == pytest.approx((1 + 1 / 3 + 1) / 8)
    assert moves[(0, 2.0)] == 2 / 8

