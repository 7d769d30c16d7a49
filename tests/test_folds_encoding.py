from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ranktab.operators import encoding
from ranktab.operators.folds import stratified_folds
from ranktab.operators.ordinal import with_ordinal


def fold_map(df):
    return {r["id"]: r["fold"] for r in df.select("id", "fold").collect()}


def test_folds_are_even_inside_every_label(spark, samples):
    sizes = defaultdict(Counter)
    for r in stratified_folds(samples, "label", "id", 5).collect():
        sizes[r["label"]][r["fold"]] += 1
    for per_fold in sizes.values():
        assert max(per_fold.values()) - min(per_fold.values()) <= 1
        assert set(per_fold) == set(range(5))


@pytest.mark.parametrize("partitions", [1, 8, 64])
@pytest.mark.parametrize("digits", [1, 3])
def test_folds_do_not_depend_on_partitioning(spark, samples, partitions, digits):
    base = fold_map(stratified_folds(samples, "label", "id", 3))
    again = stratified_folds(samples.repartition(partitions), "label", "id", 3, digits=digits)
    assert fold_map(again) == base
    assert fold_map(stratified_folds(samples, "label", "id", 3, seed=1)) != base


def test_ordinal_equals_plain_window_with_a_hot_group(spark):
    df = spark.range(900).select(
        F.col("id"),
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"),
        F.md5(F.col("id").cast("string").cast("binary")).alias("h"),
    )
    found = {r["id"]: r["_ordinal"] for r in with_ordinal(df, ["g"], "h", ["id"]).collect()}
    rows = sorted(df.collect(), key=lambda r: (r["g"], r["h"], r["id"]))
    place, last = {}, None
    for r in rows:
        n = n + 1 if r["g"] == last else 0
        place[r["id"]], last = n, r["g"]
    assert found == place


def test_fold_plan_shuffles_the_rows_once(spark, samples):
    plan = stratified_folds(samples.select("id", "label"), "label", "id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    rows_side = text.split("_local")[-1]
    assert "hashpartitioning(_group_0" in rows_side
    assert "SinglePartition" not in text


def test_k_must_be_two_or_more(samples):
    with pytest.raises(ValueError):
        stratified_folds(samples, "label", "id", 1)


ROWS = [(1, "a", 0, 0), (2, "a", 2, 0), (3, "a", 4, 1), (4, "b", 6, 0), (5, "b", 1, 0), (6, "c", 3, 1)]


@pytest.fixture(scope="module")
def coded(spark):
    return spark.createDataFrame(ROWS, "id int, k string, y int, fold int")


def brute_force():
    prior = sum(r[2] for r in ROWS) / len(ROWS)
    out = {}
    for i, k, _, f in ROWS:
        others = [r[2] for r in ROWS if r[1] == k and r[3] != f]
        out[i] = sum(others) / len(others) if others else prior
    return out


def test_out_of_fold_encoding(coded):
    out = encoding.out_of_fold_encoding(coded, "k", "y", out="e")
    assert {r["id"]: r["e"] for r in out.collect()} == pytest.approx(brute_force())
    assert out.count() == len(ROWS)


def test_unseen_keys_get_the_mean(spark, coded, tmp_path):
    model = encoding.fit_target_encoding(coded, "k", "y", "e")
    new = spark.createDataFrame([(1, "a"), (2, "zzz"), (3, None)], "id int, k string")
    expected = {1: 2.0, 2: 16 / 6, 3: 16 / 6}
    model.save(str(tmp_path / "te"))
    for m in (model, encoding.TargetEncoding.load(spark, str(tmp_path / "te"))):
        assert {r["id"]: r["e"] for r in m.transform(new).collect()} == pytest.approx(expected)


def test_labels_in_both_orders(spark):
    df = spark.createDataFrame([(3, "a"), (1, "c"), (2, "b"), (5, None)], "id int, label string")
    assert encoding.class_labels(df, "label") == ["a", "b", "c"]
    assert encoding.factorized_labels(df, "label", "id") == ["c", "b", "a"]
    with pytest.raises(ValueError):
        encoding.class_labels(df, "label", max_classes=2)


def test_category_codes_unseen_and_missing(spark):
    train = spark.createDataFrame([("b",), ("a",)], "s string")
    model = encoding.fit_category_codes(train, ["s"])
    new = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "s string")
    got = [r["s_code"] for r in encoding.apply_category_codes(model, new).collect()]
    assert got == [0, 1, -1, -1]


def test_known_labels_only(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b")], "id int, label string")
    aux = spark.createDataFrame([("a", 1), ("q", 2)], "label string, n int")
    assert [r["n"] for r in encoding.known_labels_only(aux, train, "label").collect()] == [1]
    assert encoding.known_labels_only(aux.where("label = 'q'"), train, "label") is None
    assert encoding.known_labels_only(aux.drop("label"), train, "label") is None
    assert encoding.known_labels_only(None, train, "label") is None


def test_rows_without_a_label_get_folds(spark):
    rows = [(i, None if i % 5 == 0 else f"c{i % 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, label string")
    out = stratified_folds(df, "label", "id", 4).collect()
    assert sorted(r["id"] for r in out) == list(range(40))
    assert all(r["fold"] in range(4) for r in out)
    sizes = [sum(r["label"] is None and r["fold"] == f for r in out) for f in range(4)]
    assert sizes == [2, 2, 2, 2]
