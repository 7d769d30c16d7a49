from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ranktab.llm import secrets


def test_rare_secrets_reach_the_forest(spark):
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("word"), F.lit(0).alias("part"), F.lit("v").alias("value"))
    rows = rows.withColumn("label", (F.col("doc_id") % 20_000 == 7).cast("double"))
    rows = rows.select("*", *[F.col("label").alias(f"f_{f}") for f in secrets.FEATURES])
    for turned in (F.col("label"), 1 - F.col("label")):
        model = secrets.fit_forest(rows.withColumn("label", turned), rows=1_000)
        scored = model.transform(secrets._assembled(rows)).select("label", vector_to_array("probability")[1].alias("p"))
        ends = {r["label"]: r["p"] for r in scored.groupBy("label").agg(F.avg("p").alias("p")).collect()}
        assert abs(ends[1.0] - ends[0.0]) > 0.5


def test_few_findings_are_taken_whole(spark):
    rows = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("word"), F.lit(0).alias("part"), F.lit("v").alias("value"), (F.col("id") < 50).cast("double").alias("label"))
    taken = lambda n: {r["label"]: r["count"] for r in secrets.class_sample(rows, {0.0: 4_950, 1.0: 50}, n).groupBy("label").count().collect()}
    assert taken(5_000) == {0.0: 4_950, 1.0: 50}
    assert taken(1_000)[1.0] == 50 and 800 < taken(1_000)[0.0] < 1_100
