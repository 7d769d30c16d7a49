from __future__ import annotations

from pyspark.sql import functions as F

from ranktab.llm.labelled import held_out, training_rows


def test_rare_class_is_kept_whole(spark):
    labels = spark.range(400_000).select(F.col("id").alias("doc_id"), (F.col("id") % 40_000 == 3).cast("int").alias("toxic"))
    labels = labels.unionByName(labels.limit(1000))  # label rows given twice
    docs = spark.range(400_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    got = {r["label"]: r["count"] for r in training_rows(docs, labels, "toxic").groupBy("label").count().collect()}
    free = labels.where(~held_out(F.col("doc_id")) & (F.col("toxic") == 1)).select("doc_id").distinct().count()
    assert got[1] == free and 0 < free <= 10
    assert 19_000 < got[0] + got[1] < 21_000


def test_small_tables_are_taken_whole(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (61, 5), (62, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, None if i == 0 else f"t{i}") for i in range(63)], "doc_id long, text string")
    got = training_rows(docs, labels, "toxic").collect()
    kept = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).count()
    assert len(got) == kept
    assert training_rows(docs, labels.limit(0), "toxic").count() == 0
