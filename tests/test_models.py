from __future__ import annotations

import pytest
from pyspark.ml import Estimator
from pyspark.sql import functions as F

from ranktab.__main__ import main
from ranktab.catalog.bindings import planted, split
from ranktab.operators.metrics import map_at_k
from ranktab.plans import jobs, search
from ranktab.plans.learners import (
    LABEL,
    QUICK,
    BoostedOneVsRest,
    CandidateRanker,
    add_proba,
    boosted,
    fit_snapshots,
    forest,
    predict_vote,
    rankers,
)
from ranktab.plans.stacking import Stacking, StackingModel
from ranktab.sources.sinks import load_feature_tables, load_model, save_model
from ranktab.sources.staging import stage
from ranktab.schema import SNAKE, TITLE

CONFIG = jobs.JobConfig(size=QUICK, folds=2, evaluation_folds=2, augment=False, snapshots=[2, 3])
#: MAP@3 of always naming three of seven even classes is (1 + 1/2 + 1/3) / 7.
PRIOR = (1 + 1 / 2 + 1 / 3) / 7


@pytest.fixture(scope="module")
def rows(spark, sf):
    return stage(planted(spark, sf))


@pytest.fixture(scope="module")
def data(rows):
    train, test = split(rows)
    return jobs.prepare(jobs.enrich(train, test, CONFIG, 2), CONFIG)


@pytest.fixture(scope="module")
def truth(rows, data):
    code = F.array_position(F.array(*[F.lit(x) for x in data.labels]), F.col("label")) - 1
    return rows.select("id", code.cast("int").alias("y"))


@pytest.fixture(scope="module")
def stack(data):
    return Stacking(data.prep, 2, QUICK).fit(data.train)


def check(model_or_list, data, truth):
    """Rows in = rows out, shares sum to 1, and the score beats the prior."""
    scored = stage(jobs.score(model_or_list, data.test, 7).select("id", "proba"))
    assert scored.count() == data.test.count()
    worst = scored.agg(
        F.max(F.abs(F.aggregate("proba", F.lit(0.0), lambda a, p: a + p) - 1)).alias("off"),
        F.min(F.size("proba")).alias("n"),
    ).first()
    assert worst["off"] < 1e-6 and worst["n"] == 7
    score = map_at_k(scored.join(truth, "id")).first()["map_at_3"]
    assert score > PRIOR + 0.1
    return scored


def test_stack(spark, data, truth, stack, tmp_path):
    scored = check(stack, data, truth)
    save_model(stack, str(tmp_path / "stack"))
    for again in (StackingModel.load(str(tmp_path / "stack")), load_model(spark, str(tmp_path / "stack"))):
        back = jobs.score(again, data.test, 7).select("id", "proba")
        assert back.orderBy("id").collect() == scored.orderBy("id").collect()


def test_unfitted_stack_is_an_error(data):
    with pytest.raises(ValueError):
        StackingModel().transform(data.test)


def test_out_of_fold_rows_are_not_seen_by_their_model(data):
    """A learner that only knows its training rows' ids never meets one of them."""
    meta = Stacking(data.prep, 2, QUICK).meta_features(data.train)
    assert meta.count() == data.train.count()
    again = Stacking(data.prep, 2, QUICK).meta_features(data.train.repartition(3))
    sizes = again.select(*[F.size(f"_p_{n}").alias(n) for n in ("forest", "boosted", "linear")])
    assert sizes.distinct().collect() == [(7, 7, 7)]


def test_forest_and_snapshots(data, truth):
    check(forest(QUICK, data.prep.max_bins).fit(data.train), data, truth)
    check(fit_snapshots(data.train, data.prep, QUICK, [2, 4]), data, truth)
    with pytest.raises(ValueError):
        predict_vote([], data.test, 7)


def test_boosted_one_vs_rest(spark, data, truth, tmp_path):
    model = BoostedOneVsRest(boosted(QUICK, data.prep.max_bins), 7).fit(data.train)
    check(model, data, truth)
    save_model(model, str(tmp_path / "b"))
    first = add_proba(load_model(spark, str(tmp_path / "b")), data.test, 7).orderBy("id").first()
    assert first == add_proba(model, data.test, 7).orderBy("id").first()


def test_candidate_ranker_scores_without_shuffle(data, truth):
    model = CandidateRanker(boosted(QUICK, data.prep.max_bins), 7).fit(data.train)
    scored = jobs.score(model, data.test, 7)
    assert scored.count() == data.test.count()
    plan = model.transform(data.train)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_selection_and_leaderboard(spark, data, truth):
    models = {
        k: v
        for k, v in search.final_candidates(data.prep, QUICK, _width(data), 2).items()
        if k in ("linear", "perceptron", "forest_deep")
    }
    chosen = search.select_model(data.train, models, 2)
    assert set(chosen.scores) == set(models) and chosen.best in models
    board = search.leaderboard(spark, chosen.scores).collect()
    assert board[0]["model"] == chosen.best
    assert [r["map_at_3"] for r in board] == sorted((r["map_at_3"] for r in board), reverse=True)
    check(chosen.model, data, truth)


def _width(data):
    return data.train.select("linear_features").first()[0].size


def test_importance_names(data):
    model = forest(QUICK, data.prep.max_bins).fit(data.train)
    top = search.feature_importance(model, data.train, 5).collect()
    assert len(top) == 5 and top[0]["importance"] >= top[-1]["importance"]
    assert any("crop" in r["feature"].lower() for r in top)


def test_failed_folds(spark, data):
    class Broken:
        def fit(self, df):
            raise RuntimeError("no")

    args = (data.train, Broken, 7, 2)
    with pytest.raises(RuntimeError):
        search.cross_validated_scores(*args)
    zero = search.cross_validated_scores(*args, failed="zero").collect()
    assert [r["map_at_3"] for r in zero] == [0.0, 0.0]


def test_feature_search(spark, rows, tmp_path):
    train, test = split(rows)
    aux = test.where("moisture < 30").drop("moisture", "id")
    settings = search.SearchConfig(rounds=2, folds=2)
    found = jobs.run_search(train, CONFIG, settings, test, aux, str(tmp_path / "exp"))
    saved = load_feature_tables(spark, str(tmp_path / "exp" / "best"))
    assert saved[0].count() == train.count() and saved[1].count() == test.count()
    assert saved[2].count() == aux.count()
    assert saved[3]["best_score"] == found.best_score
    assert set(saved[1].columns) <= set(saved[0].columns)
    assert spark.read.json(str(tmp_path / "exp" / "feature_info")).count() == 3
    assert [h["iteration"] for h in found.history] == [-1, 0, 1]
    assert found.best_score >= found.baseline
    for h in found.history[1:]:
        assert h["accepted"] == (h["improvement"] > 0.001) and h["n_after"] > h["n_before"]
    table = found.experiments(spark)
    assert table.columns == ["iteration", "score", "n_before", "n_after", "improvement", "accepted"]


def test_auxiliary_rows_only_train(spark, rows):
    train, test = split(rows)
    weighted = search.repeat_as_weight(
        train.withColumn("fold", F.lit(0)), test.select("id", "nitrogen", "label")
    )
    got = {(r["fold"], r["weight"]) for r in weighted.select("fold", "weight").distinct().collect()}
    assert got == {(0, 3.0), (-1, 2.0)}


@pytest.mark.parametrize("mode", ["ranking", "snapshot", "single"])
def test_job_modes(rows, mode):
    train, test = split(rows)
    out = jobs.run_job(train, test, mode, CONFIG)
    assert out.columns == ["id", "label"] and out.count() == test.count()
    assert len(out.first()["label"].split(" ")) == 3


def test_job_with_augmentation_and_calibration(rows):
    train, test = split(rows)
    config = jobs.JobConfig(size=QUICK, folds=2, top=1, calibrate=True)
    out = jobs.run_job(train, test, "single", config)
    assert out.count() == test.count()
    assert {r["label"] for r in out.select("label").distinct().collect()} <= {f"class{i}" for i in range(1, 8)}


def test_job_with_title_names(rows):
    """Column names with spaces, long ids, augmentation."""
    names = dict(zip(SNAKE.inputs + ["label"], TITLE.inputs + [TITLE.label]))
    renamed = rows.withColumnsRenamed(names).withColumn("id", F.xxhash64("id"))
    train, test = split(renamed)
    config = jobs.JobConfig(columns=TITLE, size=QUICK, folds=2)
    out = jobs.run_job(train, test.drop(TITLE.label), "single", config)
    assert out.columns == ["id", "Fertilizer Name"] and out.count() == test.count()


def test_calibrating_a_stack_needs_three_folds(data):
    with pytest.raises(ValueError):
        jobs.calibration(data, "stacking", CONFIG)


def test_copies_share_a_fold(rows):
    train, test = split(rows)
    config = jobs.JobConfig(size=QUICK, folds=2)
    data = jobs.prepare(jobs.enrich(train, test, config, 2), config)
    source = F.substring_index("id", "#", 1)
    originals = data.train.where(~F.col("id").startswith("mix:"))
    spread = originals.groupBy(source.alias("s")).agg(F.count_distinct("fold").alias("n"))
    assert spread.agg(F.max("n")).first()[0] == 1
    assert originals.count() == 3 * train.count()
    assert data.train.where(F.col(LABEL).isNull()).count() == 0


def test_unknown_mode(data):
    with pytest.raises(ValueError):
        jobs.fit_mode(data, "nope", CONFIG)


def test_evaluation(rows):
    row = jobs.evaluate_job(split(rows)[0], CONFIG, inner=2).first()
    assert row["map_at_3_mean"] > PRIOR and 0 <= row["accuracy_mean"] <= row["map_at_3_mean"]


def test_command_line(spark, rows, tmp_path):
    train, test = split(rows)
    train.write.parquet(str(tmp_path / "train.parquet"))
    test.drop("label").write.parquet(str(tmp_path / "test.parquet"))
    paths = ["--train", str(tmp_path / "train.parquet"), "--test", str(tmp_path / "test.parquet")]
    rest = ["--out", str(tmp_path / "out"), "--columns", "snake", "--size", "quick", "--folds", "2"]
    main([*paths, *rest, "--mode", "single"])
    written = spark.read.option("header", True).csv(str(tmp_path / "out" / "submission.csv"))
    assert written.count() == test.count() and written.columns == ["id", "label"]


class Breaks(Estimator):
    """A candidate that can't be fitted."""

    def _fit(self, dataset):
        raise ValueError("no")


def test_a_failing_candidate_scores_nothing(data):
    models = {"breaks": Breaks(), "forest": forest(QUICK, data.prep.max_bins)}
    chosen = search.select_on(data.train.where("fold = 0"), data.train.where("fold = 1"), models)
    assert chosen.best == "forest" and chosen.scores["breaks"] == 0.0 and chosen.scores["forest"] > 0.3
    assert search.select_model(data.train, models, 2).scores["breaks"] == 0.0
    with pytest.raises(ValueError):
        search.select_on(data.train, data.train, {"breaks": Breaks()})


def test_rankers_of_five_kinds_vote(spark, data, truth, tmp_path):
    models = rankers(QUICK, data.prep)
    fitted = [m.fit(data.train) for m in models.values()]
    assert len(fitted) == 5
    for i, model in enumerate(fitted):
        save_model(model, str(tmp_path / f"r{i}"))
        again = load_model(spark, str(tmp_path / f"r{i}"))
        one, two = (add_proba(m, data.test, 7).orderBy("id").first()["proba"] for m in (model, again))
        assert one == two and sum(one) == pytest.approx(1)
    voted = predict_vote(fitted, data.test, 7)
    assert voted.count() == data.test.count()
    with pytest.raises(ValueError):
        CandidateRanker(boosted(QUICK, 32), 1000)


def test_the_stack_knows_its_meta_score(data):
    model = Stacking(data.prep, 2, QUICK).fit(data.train)
    assert 0.3 < model.getOrDefault("metaScore") <= 1

