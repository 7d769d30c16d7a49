from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ranktab.operators import quality, shaping
from ranktab.schema import TITLE
from ranktab.sources import sinks, staging, tables

HEADER = "id,Soil Type,Crop Type,Temparature,Humidity,Moisture,Nitrogen,Phosphorous,Potassium"
TRAIN = f"""{HEADER},Fertilizer Name
0,Black,Maize,30,50,40,10,5,1,Urea
1,Red,Wheat,NaN,60,50,0,0,0,DAP
2,Loamy,,20,,30,4,4,4,Urea
"""
TEST = f"{HEADER}\n7,Black,Maize,31,52,41,11,6,2\n"
OTHER = "Fertilizer Name,Nitrogen,Crop Type\nUrea,5,Maize\nUnknown,6,Wheat\n"


@pytest.fixture
def files(tmp_path):
    for name, text in (("train", TRAIN), ("test", TEST), ("other", OTHER)):
        (tmp_path / f"{name}.csv").write_text(text)
    return tmp_path


def load(spark, files, other=None):
    return tables.load_dataset(
        spark, str(files / "train.csv"), str(files / "test.csv"), other and str(files / other)
    )


def test_csv_by_header_name(spark, files):
    data = load(spark, files)
    types = dict(data.train.dtypes)
    assert types["id"] == "bigint" and types["Temperature"] == "double"
    assert types["Crop Type"] == "string" and "Temparature" not in types
    rows = {r["id"]: r for r in data.train.collect()}
    assert rows[0]["Temperature"] == 30.0 and rows[0]["Potassium"] == 1.0
    assert rows[1]["Temperature"] is None and rows[2]["Crop Type"] is None
    assert data.original is None
    assert set(data.x_train.columns) == set(data.x_test.columns)
    assert data.y_train.columns == ["id", "Fertilizer Name"]


def test_optional_source(spark, files):
    assert tables.read_optional(spark, None) is None
    assert tables.read_optional(spark, str(files / "absent.csv")) is None
    known = load(spark, files, "other.csv").known_original()
    assert [r["Nitrogen"] for r in known.collect()] == [5.0]


def test_parquet_source(spark, files):
    path = str(files / "t.parquet")
    load(spark, files).train.write.parquet(path)
    assert tables.read_table(spark, path).count() == 3


def test_validation(spark, files):
    data = load(spark, files)
    assert quality.validate(data.train, data.test, TITLE.id, TITLE.label)
    gap = data.test.drop("Moisture")
    assert not quality.validate(data.train, gap, TITLE.id, TITLE.label)
    assert quality.schema_difference(data.train, gap.withColumn("e", F.lit(1)), ["id", TITLE.label]) == (
        ["Moisture"],
        ["e"],
    )
    gaps = {(r["column_name"], r["n_missing"]) for r in quality.null_counts(data.train).collect()}
    assert gaps == {("Temperature", 1), ("Humidity", 1), ("Crop Type", 1)}


def test_label_balance(spark):
    even = spark.createDataFrame([("a",), ("b",)], "label string")
    odd = spark.createDataFrame([("a",), ("b",), ("b",)], "label string")
    assert {r["balanced"] for r in quality.label_distribution(even, "label").collect()} == {1}
    assert {r["balanced"] for r in quality.label_distribution(odd, "label").collect()} == {0}


def test_feature_kinds(spark):
    names = ["x_cat", "t_zone", "N_P_ratio", "DAP_score", "env_max", "const", "x", "env_cat"]
    kinds = {r["feature"]: r["kind"] for r in quality.feature_kinds(spark, names).collect()}
    assert kinds == {
        "x_cat": "categorical_binned",
        "t_zone": "categorical_binned",
        "N_P_ratio": "npk_ratio",
        "DAP_score": "fertilizer_score",
        "env_max": "environmental",
        "const": "constant",
        "x": "original",
        "env_cat": "categorical_binned",
    }


def test_expand_training_fills_missing_columns(spark, files):
    data = load(spark, files, "other.csv")
    out = shaping.expand_training(data.train, data.known_original())
    assert out.count() == 3 * 3 + 2 * 1
    assert out.where("id IS NULL").select("Moisture").distinct().collect()[0][0] is None


def test_combine_and_align(spark):
    a = spark.createDataFrame([(1, 2)], "id int, x int")
    b = spark.createDataFrame([(1, 9, 5)], "id int, x int, z int")
    both = shaping.combine_frames(a, b, "id")
    assert both.collect()[0].asDict() == {"id": 1, "x": 2, "z": 5}
    assert shaping.combine_frames(None, b, "id") is b and shaping.combine_frames(a, None, "id") is a
    assert shaping.align_columns(both, ["z", "nope", "id"]).columns == ["z", "id"]
    assert shaping.align_columns(None, ["z"]) is None


def test_feature_table_round_trip(spark, files):
    data = load(spark, files)
    path = str(files / "best")
    assert sinks.load_feature_tables(spark, path) is None
    sinks.save_feature_tables(path, data.train, data.test, None, {"best_score": 0.5})
    train, test, original, summary = sinks.load_feature_tables(spark, path)
    assert train.count() == 3 and test.count() == 1 and original is None
    assert summary["best_score"] == 0.5
    sinks.save_feature_tables(path, data.train, data.test, data.test, {"best_score": 0.6})
    assert sinks.load_feature_tables(spark, path)[2].count() == 1


def test_experiment_records(spark, files):
    df = load(spark, files).train
    for i in (0, 1):
        sinks.append_experiment(df, str(files / "exp"), i, 0.25 * i, f"try_{i}", ["id"])
    lines = [
        json.loads(line)
        for f in Path(files / "exp" / "feature_info").glob("*.json")
        for line in f.read_text().splitlines()
    ]
    assert sorted(r["experiment_name"] for r in lines) == ["try_0", "try_1"]
    assert all(r["num_features"] == 9 and r["timestamp"] > 0 for r in lines)
    assert spark.read.json(str(files / "exp" / "feature_types")).count() == 18


def test_results_twice(spark, files):
    df = spark.createDataFrame([(1, "a b c"), (2, "c b a")], "id int, label string")
    paths = sinks.save_results(df, str(files / "out"), datetime(2024, 5, 6, 7, 8, 9))
    assert paths[1].endswith("submission_20240506_070809.csv")
    for p in paths:
        back = spark.read.option("header", True).csv(p)
        assert back.columns == ["id", "label"] and back.count() == 2


def test_staging_uses_the_configured_folder(spark):
    root = staging.staging_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir")
    table = staging.stage(spark.range(5))
    assert table.count() == 5 and all(root in f for f in table.inputFiles())


def test_an_id_spelt_otherwise_stays_an_id(spark, tmp_path):
    from ranktab.plans import jobs
    from ranktab.plans.learners import QUICK
    from ranktab.schema import TITLE

    big = 6110171874554102311
    crops, soils = ["Maize", "Wheat", "Paddy"], ["Red", "Black"]
    rows = [(big + i, 20 + i % 15, 50 + i % 20, 40, crops[i % 3], soils[i % 2], i % 40, i % 20, i % 30, f"f{i % 3}") for i in range(90)]
    header = ["ID", "Temparature", "Humidity", "Moisture", "Crop Type", "Soil Type", "Nitrogen", "Potassium", "Phosphorous", "Fertilizer Name"]
    for name, n in (("train", 10), ("test", 9)):
        lines = [",".join(header[:n]), *(",".join(map(str, r[:n])) for r in rows)]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines))
    data = tables.load_dataset(spark, str(tmp_path / "train.csv"), str(tmp_path / "test.csv"))
    assert "id" in data.train.columns and "ID" not in data.train.columns
    for augmented in (False, True):
        config = jobs.JobConfig(columns=TITLE, size=QUICK, folds=2, augment=augmented)
        out = jobs.run_job(data.train, data.test, "single", config).collect()
        assert {str(r["id"]) for r in out} == {str(r[0]) for r in rows}


def test_a_corrupt_auxiliary_table_is_none(spark, tmp_path):
    bad = tmp_path / "bad.parquet"
    bad.write_bytes(b"not parquet at all")
    assert tables.read_optional(spark, str(bad)) is None


def test_a_scope_deletes_what_was_staged_in_it(spark):
    before = staging.stage(spark.range(3))
    with staging.staged_scope(spark):
        inside = staging.stage(spark.range(4))
        assert inside.count() == 4
        folder = Path(inside.inputFiles()[0].removeprefix("file:")).parent
    assert not folder.exists()
    assert before.count() == 3
