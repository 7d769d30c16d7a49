"""Flags described as numbers give the forest that categories give."""

from __future__ import annotations

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ranktab.plans.features import mark_categorical
from ranktab.plans.learners import LABEL, QUICK, TREE_FEATURES, forest, plain_flags, with_class_metadata
from ranktab.sources.staging import stage

FLAGS = ["a", "b", "gappy", "rare"]


@pytest.fixture(scope="module")
def rows(spark):
    digit = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(10)).cast("int")
    made = spark.range(3000, numPartitions=3).select(
        "id",
        digit(1).alias("x"),
        (digit(2) > 4).cast("int").alias("a"),
        (digit(3) > 6).cast("int").alias("b"),
        F.when(digit(4) > 0, (digit(5) > 4).cast("int")).alias("gappy"),
        (F.col("id") == 7).cast("int").alias("rare"),
    )
    label = F.pmod(F.col("a") * 2 + F.col("b") + (F.col("x") > 5).cast("int") + (digit(6) > 7).cast("int"), F.lit(4))
    marked = mark_categorical(made.withColumn(LABEL, label), dict.fromkeys(FLAGS, 2))
    vectors = VectorAssembler(inputCols=["x", *FLAGS], outputCol=TREE_FEATURES).transform(marked)
    return stage(with_class_metadata(vectors.select("id", LABEL, TREE_FEATURES), 4))


def kinds(df):
    return {a["name"]: k for k, found in df.schema[TREE_FEATURES].metadata["ml_attr"]["attrs"].items() for a in found}


def test_only_whole_and_common_flags_become_numbers(rows):
    before, after = kinds(rows), kinds(plain_flags(rows))
    assert [before[x] for x in FLAGS] == ["nominal"] * 4
    assert [after[x] for x in FLAGS] == ["numeric", "numeric", "nominal", "nominal"]
    assert after["x"] == "numeric"


def test_two_classes_are_left_alone(rows):
    two = with_class_metadata(rows.withColumn(LABEL, F.least(LABEL, F.lit(1.0))), 2)
    assert kinds(plain_flags(two)) == kinds(two)


def test_the_forest_is_the_same(rows):
    new = forest(QUICK, 32)
    plain = new._copyValues(RandomForestClassifier())
    one, two = plain.fit(rows), new.fit(rows)
    assert one.featureImportances == two.featureImportances
    share = lambda m, out: m.transform(rows).select("id", vector_to_array("probability").alias(out))
    both = share(one, "p").join(share(two, "q"), "id")
    assert both.count() == 3000 and both.where("p <> q").count() == 0
