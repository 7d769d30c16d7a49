"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per name.

Each runs over whole tables. Computed doubles are rounded so that two engines'
last bits do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktab.catalog.bindings import (
    CLASSES,
    N_CLASSES,
    is_train,
    samples,
    scores,
    split,
    voted_scores,
)
from ranktab.functions import domain, proba
from ranktab.functions.bins import bin_code, round_half_up
from ranktab.functions.rng import tagged, uniform
from ranktab.operators import (
    augment,
    calibrate,
    encoding,
    folds,
    metrics,
    quality,
    quantiles,
    results,
    shaping,
)
from ranktab.operators.binning import Binner, MedianFlag
from ranktab.operators.bounded import local_table
from ranktab.plans import features
from ranktab.schema import SNAKE
from ranktab.sources.staging import stage

#: Temperatures used where a query applies given ones.
SHOWN_TEMPERATURES = [0.5, 0.8, 1.0, 1.25, 1.5, 2.0, 4.0]
#: Grid rounds of the registered temperature fit.
FIT_ROUNDS = calibrate.GRID_ROUNDS


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column."""
    return df.select(
        *[
            round_half_up(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def only(df: DataFrame, exprs: dict, key: str = "id") -> DataFrame:
    return rounded(df.select(key, *[e.alias(n) for n, e in exprs.items()]))


def spread(df: DataFrame, column: str = "proba", digits: int = 9) -> DataFrame:
    """``id, p0 … p6`` from an array."""
    slots = [F.get(F.col(column), F.lit(i)).alias(f"p{i}") for i in range(N_CLASSES)]
    return rounded(df.select("id", *slots), digits)


# --- sources, quality, shaping -----------------------------------------------


def scan_samples(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf)


def dataset_summary(spark, sf):
    side = F.when(is_train(), "train").otherwise("test").alias("split")
    return samples(spark, sf).groupBy(side).agg(F.count(F.lit(1)).alias("n_rows"))


def rename_typo(spark, sf):
    misspelt = samples(spark, sf).withColumnRenamed("temperature", "temparature")
    return shaping.fix_spelling(misspelt).select("id", "temperature")


def _auxiliary(test: DataFrame) -> DataFrame:
    """Labelled side table with some labels training never has."""
    unknown = uniform(tagged(F.col("id"), "aux")) < 0.3
    return test.select(
        "id",
        "crop_type",
        "soil_type",
        "nitrogen",
        "potassium",
        "phosphorous",
        F.when(unknown, F.concat("label", F.lit("x"))).otherwise(F.col("label")).alias("label"),
    )


def known_class_filter(spark, sf):
    train, test = split(samples(spark, sf))
    kept = encoding.known_labels_only(_auxiliary(test), train, "label")
    return kept.select("id", "label")


def align_columns(spark, sf):
    wanted = ["id", "not_there", "nitrogen", "crop_type", "label"]
    return shaping.align_columns(samples(spark, sf), wanted)


def combine_features(spark, sf):
    base = samples(spark, sf)
    base = base.select("id", *base.columns[1:7], F.lit(0.0).alias("NPK_polynomial"))
    new = {**domain.nutrient_polynomials(SNAKE), **domain.climate_polynomials(SNAKE)}
    return rounded(shaping.add_missing_columns(base, new))


def _with_gaps(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "nitrogen": F.nullif("nitrogen", F.lit(0)),
            "potassium": F.nullif("potassium", F.lit(7)),
            "crop_type": F.nullif("crop_type", F.lit("Quinoa")),
        }
    )


def null_report(spark, sf):
    train, test = split(_with_gaps(samples(spark, sf)))
    return quality.null_report({"train": train, "test": test})


def schema_diff(spark, sf):
    train, test = split(_with_gaps(samples(spark, sf)))
    test = test.drop("moisture").withColumn("extra", F.col("humidity"))
    return quality.schema_report(train, test, ["id", "label"])


def label_distribution(spark, sf):
    return quality.label_distribution(samples(spark, sf), "label")


def replicate_rows(spark, sf):
    return shaping.replicate(samples(spark, sf).select("id", "label"), 3)


def expand_training(spark, sf):
    train, test = split(samples(spark, sf))
    aux = encoding.known_labels_only(_auxiliary(test), train, "label")
    return shaping.expand_training(train, aux)


# --- features ----------------------------------------------------------------


def _fitted_base(spark, sf, config=features.FeatureConfig(parity=True)):
    # Fitting passes over the rows several times, and the caller once more: joined once.
    df = stage(samples(spark, sf))
    train, _ = split(df)
    return features.BaseFeatures(SNAKE, config).fit(train), df


def base_features(spark, sf):
    model, df = _fitted_base(spark, sf)
    return rounded(model.transform(df))


def env_features(spark, sf):
    df = samples(spark, sf)
    out = domain.environment(SNAKE)
    edges = quantiles.quantiles(df, SNAKE.climate, quantiles.even_probabilities(5))
    out.update({f"{c}_zone": bin_code(c, e) for c, e in edges.items()})
    return only(df, out)


def npk_features(spark, sf):
    return only(samples(spark, sf), domain.nutrients(SNAKE))


def temp_suitability(spark, sf):
    return only(samples(spark, sf), domain.temperature_suitability(SNAKE))


def crop_soil_strength(spark, sf):
    return only(samples(spark, sf), domain.crop_soil(SNAKE))


def hill_features(spark, sf):
    df = samples(spark, sf)
    base = df.withColumns(
        {
            "env_max": domain.environment(SNAKE)["env_max"],
            "Total_NPK": domain.nutrients(SNAKE)["Total_NPK"],
        }
    )
    for r in domain.SEARCH_ROUNDS:
        base = features.search_round_features(base, r)
    return rounded(base.select("id", *[c for c in base.columns if c not in df.columns]))


def threshold_flags(spark, sf):
    df = samples(spark, sf)
    outs = [f"{c}_high" for c in SNAKE.numerics]
    model = MedianFlag(inputCols=SNAKE.numerics, outputCols=outs).fit(df)
    return model.transform(df).select("id", *outs)


def quantile_edges(spark, sf):
    df = samples(spark, sf)
    probabilities = sorted({p for q in (5, 10, 20) for p in quantiles.even_probabilities(q)})
    found = quantiles.quantiles(df, SNAKE.numerics, probabilities)
    names, bins, places, edges = [], [], [], []
    for c in SNAKE.numerics:
        for q in (5, 10, 20):
            at = [found[c][probabilities.index(p)] for p in quantiles.even_probabilities(q)]
            for place, e in enumerate(sorted(set(at))):
                names.append(c)
                bins.append(q)
                places.append(place)
                edges.append(round(e, 6))
    return local_table(
        spark, {"column_name": names, "bins": bins, "place": places, "edge": edges}
    )


def _binned(spark, sf, strategy):
    df = samples(spark, sf)
    outs = [f"{c}_cat" for c in SNAKE.numerics]
    model = Binner(inputCols=SNAKE.numerics, outputCols=outs, bins=20, strategy=strategy).fit(df)
    return model.transform(df).select("id", *outs)


def quantile_bins(spark, sf):
    return _binned(spark, sf, "quantile")


def equal_width_bins(spark, sf):
    return _binned(spark, sf, "width")


def categorical_columns(spark, sf):
    model, df = _fitted_base(spark, sf)
    out = model.transform(df)
    names = features.categorical_columns(out)
    # A set of codes is bounded by the number of bins; only strings need a
    # distinct aggregate, which repeats every row once per column.
    coded = model.arity()
    stats = out.agg(
        *[
            (F.size(F.collect_set(c)).cast("bigint") if c in coded else F.count_distinct(c)).alias(
                f"{c}|levels"
            )
            for c in names
        ],
        *[F.count(c).alias(f"{c}|values") for c in names],
    )
    long = stats.unpivot([], [F.col(f"`{c}`") for c in stats.columns], "name", "n")
    parts = F.split("name", r"\|")
    return (
        long.select(parts[0].alias("column_name"), parts[1].alias("what"), "n")
        .groupBy("column_name")
        .agg(
            F.max(F.when(F.col("what") == "levels", F.col("n"))).alias("n_levels"),
            F.max(F.when(F.col("what") == "values", F.col("n"))).alias("n_values"),
        )
    )


def feature_catalog(spark, sf):
    model, df = _fitted_base(spark, sf)
    return quality.feature_catalog(model.transform(df), ["id", "label"])


# --- encoding ----------------------------------------------------------------


def factorize_labels(spark, sf):
    df = samples(spark, sf)
    labels = encoding.factorized_labels(df, "label", "id")
    coded = encoding.with_label_code(df, labels, "label", "code")
    return coded.groupBy("label", "code").agg(F.count(F.lit(1)).alias("n_rows"))


def label_index(spark, sf):
    df = samples(spark, sf)
    labels = encoding.class_labels(df, "label")
    return encoding.with_label_code(df, labels, "label").select("id", "label", "class_idx")


def category_codes(spark, sf):
    df = samples(spark, sf).withColumns(domain.crop_soil(SNAKE))
    names = ["crop_type", "soil_type", SNAKE.combo]
    train, _ = split(df)
    model = encoding.fit_category_codes(train.where("crop_type <> 'Cotton'"), names)
    coded = encoding.apply_category_codes(model, df)
    return coded.select("id", *[f"{c}_code" for c in names])


def stratified_folds(spark, sf):
    return folds.stratified_folds(samples(spark, sf), "label", "id", 5).select(
        "id", "label", "fold"
    )


def _coded(spark, sf):
    df = samples(spark, sf).withColumn(SNAKE.combo, domain.crop_soil(SNAKE)[SNAKE.combo])
    train, test = split(df)
    labels = encoding.factorized_labels(train, "label", "id")
    return encoding.with_label_code(train, labels, "label", "code"), test


def target_encode_apply(spark, sf):
    train, test = _coded(spark, sf)
    seen = train.where(F.col(SNAKE.combo) != "Wheat_Red")
    model = encoding.fit_target_encoding(seen, SNAKE.combo, "code", "encoded")
    return rounded(model.transform(test).select("id", SNAKE.combo, "encoded"), 9)


def target_encode_oof(spark, sf):
    train, _ = _coded(spark, sf)
    # Read twice below (sums, then rows), so the sorted fold assignment is written once.
    folded = stage(
        folds.stratified_folds(
            train.select("id", "label", SNAKE.combo, "code"), "label", "id", 5
        )
    )
    out = encoding.out_of_fold_encoding(folded, SNAKE.combo, "code", out="encoded")
    return rounded(out.select("id", SNAKE.combo, "fold", "encoded"), 9)


# --- augmentation ------------------------------------------------------------


def jitter_columns(spark, sf):
    df = samples(spark, sf)
    train, _ = split(df)
    model = features.BaseFeatures().fit(train)
    out = model.transform(train)
    names = augment.jitter_columns(out, tuple(model.arity()))
    return quality.feature_catalog(out.select(*names), []).select(
        F.col("feature").alias("column_name"), "n_values"
    )


def jitter_expand(spark, sf):
    df = samples(spark, sf).select("id", "nitrogen", "phosphorous", "potassium")
    return rounded(augment.jitter_expand(df, "id", augment.jitter_columns(df)))


def mixup_pairs(spark, sf):
    return augment.mixup_pairs(samples(spark, sf), "id", SNAKE.strings)


def mixup(spark, sf):
    df = samples(spark, sf)
    return rounded(augment.mixup(df, "id", SNAKE.strings, SNAKE.numerics, "label"))


def augment_all(spark, sf):
    df = samples(spark, sf)
    out = augment.augment(df, "id", SNAKE.strings, SNAKE.numerics, "label")
    return rounded(out)


# --- ranking, metrics, results -----------------------------------------------


def top3_array(spark, sf):
    best = proba.top_k(F.col("proba"), 3)
    return scores(spark, sf).select(
        "id", *[F.get(best, F.lit(i)).cast("int").alias(f"top{i + 1}") for i in range(3)]
    )


def map_at_3(spark, sf):
    return rounded(metrics.map_at_k(scores(spark, sf)), 9)


def accuracy_top1(spark, sf):
    return rounded(metrics.accuracy(scores(spark, sf)), 9)


def fold_score_stats(spark, sf):
    folded = folds.stratified_folds(scores(spark, sf), "label", "id", 5)
    per_fold = metrics.fold_scores(folded)
    return rounded(metrics.mean_and_spread(per_fold, ["map_at_3", "accuracy"]), 9)


def soft_vote(spark, sf):
    df = voted_scores(spark, sf, {m: m for m in ("p", "q", "r")})
    votes = [proba.normalise(F.col(m)) for m in ("p", "q", "r")]
    return spread(df.withColumn("proba", proba.soft_vote(votes)), digits=6)


def score_softmax(spark, sf):
    df = scores(spark, sf)
    margins = F.transform("proba", lambda p: p * F.lit(10.0))
    return spread(df.withColumn("proba", proba.softmax(margins)))


def top1_decode(spark, sf):
    return results.top1_result(scores(spark, sf), CLASSES)


def top3_submission(spark, sf):
    return results.top_k_result(scores(spark, sf), CLASSES)


def submission_summary(spark, sf):
    return results.result_summary(results.top_k_result(scores(spark, sf), CLASSES))


def submission_head(spark, sf):
    return results.head(results.top_k_result(scores(spark, sf), CLASSES), 10)


# --- calibration -------------------------------------------------------------


def temperature_loss(spark, sf):
    grids = {c: calibrate.grid(*calibrate.TEMPERATURE_BOUNDS) for c in range(N_CLASSES)}
    return rounded(calibrate.temperature_losses(scores(spark, sf), grids))


def temperature_fit(spark, sf):
    """Temperatures to 3 digits: the loss is so flat at its least that the order of sums moves the sixth."""
    found = calibrate.fit_temperatures(scores(spark, sf), N_CLASSES, rounds=FIT_ROUNDS)
    return rounded(
        local_table(spark, {"class_idx": list(range(N_CLASSES)), "temperature": found}).withColumn(
            "class_idx", F.col("class_idx").cast("int")
        ),
        3,
    )


def temperature_apply(spark, sf):
    df = scores(spark, sf)
    return spread(df.withColumn("proba", proba.sharpen(F.col("proba"), SHOWN_TEMPERATURES)))


def class_weight_search(spark, sf):
    """Scores of all moves of the search's first round."""
    _, moves = calibrate.score_moves(scores(spark, sf), [1.0] * N_CLASSES)
    out = local_table(
        spark,
        {
            "class_idx": [c for c, _ in moves],
            "factor": [f for _, f in moves],
            "map_at_3": list(moves.values()),
        },
    )
    return rounded(out.withColumn("class_idx", F.col("class_idx").cast("int")), 9)


def class_weight_fit(spark, sf):
    found = calibrate.search_weights(scores(spark, sf), N_CLASSES)
    out = local_table(
        spark,
        {
            "class_idx": list(range(N_CLASSES)),
            "weight": found["weights"],
            "gain": [found["gain"]] * N_CLASSES,
            "rounds": [found["rounds"]] * N_CLASSES,
        },
    )
    return rounded(out.withColumns({c: F.col(c).cast("int") for c in ("class_idx", "rounds")}), 9)


RELATIONAL = {
    f.__name__: f
    for f in (
        scan_samples,
        dataset_summary,
        rename_typo,
        known_class_filter,
        align_columns,
        combine_features,
        null_report,
        schema_diff,
        label_distribution,
        replicate_rows,
        expand_training,
        base_features,
        env_features,
        npk_features,
        temp_suitability,
        crop_soil_strength,
        hill_features,
        threshold_flags,
        quantile_edges,
        quantile_bins,
        equal_width_bins,
        categorical_columns,
        feature_catalog,
        factorize_labels,
        label_index,
        category_codes,
        stratified_folds,
        target_encode_apply,
        target_encode_oof,
        jitter_columns,
        jitter_expand,
        mixup_pairs,
        mixup,
        augment_all,
        top3_array,
        map_at_3,
        accuracy_top1,
        fold_score_stats,
        soft_vote,
        score_softmax,
        top1_decode,
        top3_submission,
        submission_summary,
        submission_head,
        temperature_loss,
        temperature_fit,
        temperature_apply,
        class_weight_search,
        class_weight_fit,
    )
}
