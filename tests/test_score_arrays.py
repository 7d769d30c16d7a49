"""Drawn scores are rounded in compiled code, not inside lambda functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranktab.catalog.bindings import N_CLASSES, with_scores
from ranktab.functions.proba import normalise, soft_vote


def test_no_lambda_rounds_the_scores(spark):
    rows = spark.range(50).select(F.col("id").cast("string"), (F.col("id") % N_CLASSES).cast("int").alias("y"))
    drawn = with_scores(rows, {"p": "p", "q": "q"})
    voted = drawn.select("id", soft_vote([normalise(F.col("p")), normalise(F.col("q"))]).alias("proba"))
    plan = voted._jdf.queryExecution().optimizedPlan().toString().upper()
    lambdas = [line for line in plan.splitlines() if "LAMBDAFUNCTION" in line]
    assert lambdas and "FLOOR(" in plan
    assert not [line for line in lambdas if "FLOOR(" in line]
    assert voted.where(F.size("proba") == N_CLASSES).count() == 50
    assert drawn.where(F.col("p").isNull() | F.exists("p", lambda x: x != F.round(x, 6))).count() == 0
