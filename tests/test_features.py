from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranktab.functions import domain
from ranktab.operators.encoding import fit_target_encoding
from ranktab.plans import features
from ranktab.plans.features import BaseFeatures, BaseFeaturesModel, FeatureConfig
from ranktab.schema import SNAKE, TITLE

RAW = [*SNAKE.numerics, *SNAKE.strings]


def test_feature_count(samples):
    raw = samples.select(*RAW)
    out = features.create_base_features(raw, SNAKE, FeatureConfig(parity=True))
    assert len(out.columns) == 51
    coded = out.withColumn("y", F.lit(1))
    encoded = fit_target_encoding(coded, SNAKE.combo, "y").transform(out)
    assert len(encoded.columns) == 52
    assert len(features.create_base_features(raw).columns) == 45


def test_title_names(samples):
    renamed = samples.select(
        *[F.col(a).alias(b) for a, b in zip(RAW, [*TITLE.numerics, *TITLE.strings])]
    )
    names = features.create_base_features(renamed, TITLE).columns
    assert {"Temperature_cat", "temperature_zone", "Nitrogen_high", "Crop_Soil_combo"} <= set(names)


def test_groups_without_inputs_are_left_out(samples):
    names = features.create_base_features(samples.select("temperature", "nitrogen")).columns
    assert "temperature_cat" in names and "temperature_zone" in names
    assert not {"env_max", "N_P_ratio", "temp_suitability", SNAKE.combo} & set(names)


def test_switches(samples):
    off = FeatureConfig(
        binned=False,
        constant=False,
        climate_comfort=False,
        nutrients=False,
        temperature_suitability=False,
        crop_soil=False,
    )
    names = set(features.create_base_features(samples.select(*RAW), SNAKE, off).columns)
    assert "env_max" in names
    assert not {"const", "climate_comfort", "temperature_cat", "Total_NPK", SNAKE.combo} & names


def test_missing_values(spark):
    schema = "temperature double, humidity double, moisture double, nitrogen double, phosphorous double, potassium double, crop_type string, soil_type string"
    df = spark.createDataFrame(
        [
            (None, 50.0, 30.0, 1.0, None, 3.0, None, "Red"),
            (20.0, 40.0, 70.0, 0.0, 0.0, 0.0, "Maize", "Loamy"),
            (35.5, 81.0, 20.0, 5.0, 6.0, 7.0, "Quinoa", None),
        ],
        schema,
    )
    a, b, c = features.create_base_features(df).collect()
    assert a["temp_stress"] == 0 and a["env_max"] == 50.0 and a["climate_comfort"] is None
    assert a["temperature_cat"] is None and a["temperature_high"] == 0
    assert a["Total_NPK"] is None and a["N_P_ratio"] is None
    assert a["NPK_balance"] == pytest.approx(np.std([1, 3], ddof=1))
    assert a[SNAKE.combo] == "nan_Red" and a["temp_suitability"] == 0
    assert b["N_P_ratio"] == 0.0 and b["Urea_score"] == 0.0 and b["crop_soil_strength"] == 1.0
    assert b["temp_stress"] == 0 and b["moisture_stress"] == 0 and b["temp_suitability"] == 0
    assert c["temp_stress"] == 1 and c["humidity_stress"] == 1 and c["moisture_stress"] == 1
    assert c["crop_soil_strength"] == 0.5


def test_fitted_on_train_applied_to_test(samples):
    train, test = samples.where("temperature < 25"), samples.where("temperature >= 25")
    model = BaseFeatures().fit(train)
    assert {r[0] for r in model.transform(test).select("temperature_cat").distinct().collect()} == {9}


def test_model_round_trip(spark, samples, tmp_path):
    model = BaseFeatures(SNAKE, FeatureConfig(parity=True)).fit(samples)
    model.write().overwrite().save(str(tmp_path / "f"))
    again = BaseFeaturesModel.load(str(tmp_path / "f"))
    assert again.transform(samples).orderBy("id").first() == model.transform(samples).orderBy("id").first()


def test_width_strategy(samples):
    out = features.create_base_features(samples, SNAKE, FeatureConfig(strategy="width", bins=4))
    assert out.agg(F.max("humidity_cat")).first()[0] == 3


def test_extra_groups(samples):
    assert features.search_round_features(samples, 9).columns == samples.columns
    first = features.search_round_features(samples, 2)
    assert "NPK_harmonic_mean" in first.columns and "env_npk_interaction" not in first.columns
    enriched = features.search_round_features(features.create_base_features(samples), 2)
    assert "env_npk_interaction" in enriched.columns
    assert set(domain.EXTRA_GROUPS) == {g for gs in domain.SEARCH_ROUNDS.values() for g in gs}


def test_categorical_marks(samples):
    model = BaseFeatures().fit(samples)
    out = model.transform(samples)
    marked = features.mark_categorical(out, model.arity())
    meta = marked.schema["temperature_cat"].metadata["ml_attr"]
    assert meta["type"] == "nominal" and meta["num_vals"] == model.arity()["temperature_cat"] + 1
    assert "crop_type" in features.categorical_columns(out)
    assert "env_max" not in features.categorical_columns(out)


def test_features_are_one_narrow_select(samples):
    model = BaseFeatures().fit(samples)
    plan = model.transform(samples)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_unused_features_are_not_read(samples):
    model = BaseFeatures().fit(samples)
    plan = model.transform(samples).select("env_max")._jdf.queryExecution().executedPlan().toString()
    assert "nitrogen" not in plan.split("ReadSchema")[1]
