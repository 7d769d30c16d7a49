from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from ranktab.operators.binning import Binner, MedianFlag
from ranktab.operators.quantiles import (
    binary_quantiles,
    equal_width_edges,
    even_probabilities,
    medians,
    quantiles,
)

TIES = [1, 1, 1, 1, 2, 2, 3, 3, 3, 7, 9, 9]


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(next(iter(columns.values())))), **columns}))


def codes(df, name="x_cat"):
    return [r[name] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("q", [2, 4, 5, 10])
@pytest.mark.parametrize("values", [TIES, [1, 2, 3], list(range(40)), [5.5, -2.0, 0.25, 9.0, 3.0]])
def test_quantile_codes_equal_pandas(spark, values, q):
    df = frame(spark, x=values)
    out = Binner(inputCols=["x"], outputCols=["x_cat"], bins=q).fit(df).transform(df)
    expected = pd.qcut(pd.Series(values), q, labels=False, duplicates="drop")
    assert codes(out) == expected.tolist()


@pytest.mark.parametrize("values", [TIES, [0.0, 1.0, 2.5, 10.0]])
def test_width_codes_equal_pandas(spark, values):
    df = frame(spark, x=values)
    out = Binner(inputCols=["x"], outputCols=["x_cat"], bins=4, strategy="width").fit(df)
    assert codes(out.transform(df)) == pd.cut(pd.Series(values), 4, labels=False).tolist()


def test_constant_column_has_no_bins(spark):
    df = frame(spark, x=[4, 4, 4])
    out = Binner(inputCols=["x"], outputCols=["x_cat"], bins=5).fit(df).transform(df)
    assert codes(out) == [None, None, None]
    assert equal_width_edges(df, ["x"], 2)["x"] == pytest.approx([3.996, 4.0, 4.004])


def test_null_stays_null_and_flag_is_zero(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0), (3, 8.0)], "id int, x double")
    out = Binner(inputCols=["x"], outputCols=["x_cat"], bins=2).fit(df).transform(df)
    assert codes(out)[1] is None
    flagged = MedianFlag(inputCols=["x"], outputCols=["hi"]).fit(df).transform(df)
    assert codes(flagged, "hi") == [0, 0, 0, 1]


def test_values_outside_the_fitted_range_take_the_end_bins(spark):
    model = Binner(inputCols=["x"], outputCols=["x_cat"], bins=4).fit(frame(spark, x=range(40)))
    assert codes(model.transform(frame(spark, x=[-100, 500]))) == [0, 3]


def test_model_saves_inside_a_pipeline(spark, tmp_path):
    df = frame(spark, x=TIES)
    stages = [
        Binner(inputCols=["x"], outputCols=["x_cat"], bins=4),
        MedianFlag(inputCols=["x"], outputCols=["hi"]),
    ]
    model = Pipeline(stages=stages).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.transform(df).collect() == model.transform(df).collect()


def skewed(spark):
    """A third of all rows hold one value; the rest are spread out."""
    rng = np.random.default_rng(7)
    values = np.concatenate([np.full(1000, 3.25), rng.normal(0, 50, 1500), rng.integers(0, 9, 500)])
    return values, frame(spark, x=values, y=values[::-1] * 2).repartition(7)


@pytest.mark.parametrize("bins,ranges,sort_rows", [(5, 16, 10**6), (20, 333, 10**6), (20, 4, 50)])
def test_range_selection_equals_numpy(spark, bins, ranges, sort_rows):
    """Also with ranges so coarse that they are cut again, around the hot value too."""
    values, df = skewed(spark)
    probabilities = even_probabilities(bins)
    found = quantiles(
        df, ["x", "y"], probabilities, distinct_bound=0, ranges=ranges, sort_rows=sort_rows
    )
    assert found["x"] == pytest.approx(np.quantile(values, probabilities).tolist(), abs=1e-9)
    assert found["y"] == pytest.approx(np.quantile(values * 2, probabilities).tolist(), abs=1e-9)


def test_both_ways_agree(spark):
    _, df = skewed(spark)
    one = quantiles(df, ["x"], [0.0, 0.1, 0.37, 1.0])
    other = quantiles(df, ["x"], [0.0, 0.1, 0.37, 1.0], distinct_bound=0, ranges=50)
    assert one["x"] == pytest.approx(other["x"], abs=1e-9)


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, x double")
    assert quantiles(df, ["x"], [0.5])["x"] is None
    assert quantiles(df, ["x"], [0.5], distinct_bound=-1)["x"] is None
    assert medians(df, ["x"]) == {"x": None}


def test_approximate_mode_is_close(spark):
    values, df = skewed(spark)
    found = quantiles(df, ["x"], [0.25, 0.75], mode="approx")["x"]
    assert found == pytest.approx(np.quantile(values, [0.25, 0.75]), abs=1.0)
    with pytest.raises(ValueError):
        quantiles(df, ["x"], [0.5], mode="guess")


@pytest.mark.parametrize("zeros,ones", [(1, 1), (3, 2), (10, 10), (0, 4), (7, 0)])
def test_binary_quantiles(zeros, ones):
    probabilities = even_probabilities(10)
    expected = np.quantile([0] * zeros + [1] * ones, probabilities)
    assert binary_quantiles(zeros, ones, probabilities) == pytest.approx(expected)


def test_bins_stay_in_generated_code(spark):
    df = frame(spark, x=TIES)
    out = Binner(inputCols=["x"], outputCols=["x_cat"], bins=4).fit(df).transform(df)
    plan = out.select(F.col("x_cat"))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "Python" not in plan
