from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ranktab.operators import augment
from ranktab.schema import SNAKE


@pytest.fixture(scope="module")
def tiny(spark):
    """Strata of 1, 2, 3 and 40 rows, and rows without a stratum."""
    rows, i = [], 0
    for crop, n in (("one", 1), ("two", 2), ("three", 3), ("forty", 40), (None, 5)):
        for _ in range(n):
            rows.append((f"r{i}", crop, "s", float(i), f"class{i % 2}"))
            i += 1
    return spark.createDataFrame(rows, "id string, crop_type string, soil_type string, x double, label string")


def test_pairs_per_stratum(tiny):
    pairs = augment.mixup_pairs(tiny, "id", SNAKE.strings).collect()
    assert Counter(r["crop_type"] for r in pairs) == {"two": 1, "three": 1, "forty": 10}
    assert all(r["id_a"] != r["id_b"] for r in pairs)


def test_mixed_values_lie_between_their_rows(tiny):
    x = {r["id"]: (r["x"], r["label"]) for r in tiny.collect()}
    pairs = {
        (r["crop_type"], r["draw"]): (r["id_a"], r["id_b"])
        for r in augment.mixup_pairs(tiny, "id", SNAKE.strings).collect()
    }
    mixed = augment.mixup(tiny, "id", SNAKE.strings, ["x"], "label").collect()
    assert len(mixed) == len(pairs)
    for r in mixed:
        _, crop, _, draw = r["id"].split(":")
        a, b = pairs[(crop, int(draw))]
        low, high = sorted((x[a][0], x[b][0]))
        assert low - 1e-9 <= r["x"] <= high + 1e-9
        nearer = a if abs(r["x"] - x[a][0]) < abs(r["x"] - x[b][0]) else b
        assert r["label"] == x[nearer][1]


def test_no_strata_no_rows(tiny):
    assert augment.mixup(tiny, "id", [], ["x"], "label").count() == 0
    assert augment.mixup(tiny, "id", ["nope"], ["x"], "label").count() == 0


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_augmentation_does_not_depend_on_partitioning(samples, partitions):
    def run(df):
        out = augment.augment(df, "id", SNAKE.strings, SNAKE.numerics, "label")
        return out.agg(F.count("*"), F.sum(F.xxhash64(*[F.round(c, 6) if t == "double" else c for c, t in out.dtypes]).cast("decimal(38,0)"))).first()

    assert run(samples.repartition(partitions)) == run(samples)


def test_a_hot_stratum_is_sorted_in_small_parts(spark):
    df = spark.range(3000).select(
        F.col("id").cast("string").alias("id"),
        F.lit("c").alias("crop_type"),
        F.lit("s").alias("soil_type"),
    )
    plain = augment.mixup_pairs(df, "id", SNAKE.strings, digits=1).orderBy("draw").collect()
    fine = augment.mixup_pairs(df, "id", SNAKE.strings, digits=4).orderBy("draw").collect()
    assert plain == fine and len(fine) == 10


def test_jitter_keeps_originals_and_moves_copies(samples):
    names = augment.jitter_columns(samples)
    assert names == ["nitrogen", "potassium", "phosphorous"]
    out = augment.jitter_expand(samples, "id", names)
    assert out.count() == 3 * samples.count()
    both = out.alias("o").join(samples.alias("s"), "id")
    same = both.where("copy = 0 AND o.nitrogen <> s.nitrogen").count()
    assert same == 0
    stats = both.where("copy > 0 AND s.nitrogen > 0").agg(
        F.avg(F.col("o.nitrogen") / F.col("s.nitrogen") - 1).alias("m"),
        F.stddev(F.col("o.nitrogen") / F.col("s.nitrogen") - 1).alias("s"),
        F.min("o.nitrogen").alias("low"),
    ).first()
    assert abs(stats["m"]) < 1e-3 and abs(stats["s"] - 0.01) < 1e-3 and stats["low"] >= 0


def test_jitter_columns_by_name_and_type(spark):
    df = spark.createDataFrame(
        [(1, 2.0, 3.0, "x", 1.0, 2.0)],
        "nitrogen_cat int, Total_NPK double, N_P_ratio double, npk_note string, DAP_score double, Nitrogen double",
    )
    assert augment.jitter_columns(df, ("nitrogen_cat",)) == ["Total_NPK", "Nitrogen"]


def test_strata_that_read_alike_stay_apart(spark):
    rows = [(i, *(("a:b", "c") if i % 2 else ("a", "b:c")), float(i), "x") for i in range(12)]
    df = spark.createDataFrame(rows, "id string, crop string, soil string, v double, label string")
    mixed = augment.mixup(df, "id", ["crop", "soil"], ["v"], "label").collect()
    assert len(mixed) == 6 and len({r["id"] for r in mixed}) == 6
    pairs = augment.mixup_pairs(df, "id", ["crop", "soil"]).collect()
    sides = {c: {(int(r["id_a"]) // 2, int(r["id_b"]) // 2) for r in pairs if r["crop"] == c} for c in ("a", "a:b")}
    assert sides["a"] != sides["a:b"]
