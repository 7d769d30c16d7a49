"""Jitter draws of two columns share one digest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranktab.functions.rng import normal, tagged
from ranktab.operators.augment import jitter_expand


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_jitter_makes_one_digest_per_two_columns(spark):
    rows = spark.createDataFrame([("a", 10.0, 20.0, None), ("b", 0.0, -5.0, 3.0), (None, 1.0, 2.0, 3.0)], "id string, x double, y double, z double")
    out = jitter_expand(rows, "id", ["x", "y", "z"])
    assert plan(out).count("md5(") == 2
    assert out.columns == ["id", "x", "y", "z", "copy"]
    want = []
    for i, c in enumerate(["x", "y", "z"]):
        moved = F.col(c) * (F.lit(1.0) + F.lit(0.01) * normal(tagged(F.col("id"), "jitter", 42, F.col("copy"), i // 2), i % 2))
        want.append(F.when(F.col("copy") == 0, F.col(c)).when(F.col(c).isNotNull(), F.greatest(moved, F.lit(0.0))).alias(c))
    copies = rows.withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    key = lambda r: (str(r["id"]), r["copy"])
    assert sorted(out.collect(), key=key) == sorted(copies.select("id", *want, "copy").collect(), key=key)
