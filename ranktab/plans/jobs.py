"""Whole jobs: from input tables to ranked labels."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktab.functions.proba import reweight, sharpen
from ranktab.operators.augment import augment, jitter_columns
from ranktab.operators.calibrate import fit_temperatures, search_weights
from ranktab.operators.encoding import (
    TargetEncoding,
    factorized_labels,
    fit_target_encoding,
    known_labels_only,
    out_of_fold_encoding,
    with_label_code,
)
from ranktab.operators.folds import stratified_folds
from ranktab.operators.metrics import mean_and_spread
from ranktab.operators.results import top1_result, top_k_result
from ranktab.operators.shaping import align_columns
from ranktab.plans.features import (
    BaseFeatures,
    BaseFeaturesModel,
    FeatureConfig,
    categorical_columns,
    extra_features,
)
from ranktab.plans.learners import (
    LABEL,
    LINEAR_FEATURES,
    QUICK,
    TREE_FEATURES,
    VECTORS,
    Preparation,
    Size,
    add_proba,
    fit_all,
    fit_preparation,
    fit_snapshots,
    forest,
    predict_vote,
    rankers,
)
from ranktab.plans.search import (
    SearchConfig,
    SearchResult,
    evaluate_stack,
    final_candidates,
    search_features,
    select_model,
    vector_names,
)
from ranktab.plans.stacking import Stacking
from ranktab.schema import SNAKE, Columns, numeric_columns
from ranktab.sources.sinks import append_experiment, save_feature_tables
from ranktab.sources.staging import stage

MODES = ("stacking", "ranking", "snapshot", "single", "final")


@dataclass(frozen=True)
class JobConfig:
    """Settings of a job. ``leaky`` cuts folds through copies of a row."""

    columns: Columns = SNAKE
    features: FeatureConfig = FeatureConfig()
    size: Size = QUICK
    folds: int = 15
    evaluation_folds: int = 5
    encode: bool = True
    augment: bool = True
    copies: int = 3
    alpha: float = 0.2
    seed: int = 42
    snapshots: list[int] = field(default_factory=lambda: [300, 500, 700, 900, 1100, 1300])
    leaky: bool = False
    calibrate: bool = False
    top: int = 3


@dataclass(frozen=True)
class Enriched:
    """Feature frames of training and scoring rows, and what was learnt for them."""

    train: DataFrame  # id, label, fold, class_idx, te_code, features
    test: DataFrame
    labels: list[str]
    arity: dict[str, int]
    base: BaseFeaturesModel
    encoder: TargetEncoding | None

    def features_of(self, df: DataFrame) -> DataFrame:
        """The same features for other rows."""
        wide = self.base.transform(df)
        return self.encoder.transform(wide) if self.encoder else wide


def enrich(train: DataFrame, test: DataFrame, config: JobConfig, folds: int) -> Enriched:
    """Folds, base features and target encoding; everything is learnt on training rows.

    Folds are cut on the narrow input rows, before features widen them. The
    folded frame is written once: every later fit reads it instead of sorting
    the input again.
    """
    c = config.columns
    codes = factorized_labels(train, c.label, c.id)
    labels = sorted(codes)
    coded = with_label_code(with_label_code(train, labels, c.label, LABEL), codes, c.label, "te_code")
    folded = stage(stratified_folds(coded, c.label, c.id, folds, config.seed), "zstd")
    base = BaseFeatures(c, config.features).fit(folded)
    wide, encoder = base.transform(folded), None
    if config.encode and c.combo in wide.columns:
        encoder = fit_target_encoding(wide, c.combo, "te_code")
        wide = out_of_fold_encoding(wide, c.combo, "te_code")
    rows = Enriched(wide, test, labels, base.arity(), base, encoder)
    return replace(rows, test=rows.features_of(test))


@dataclass(frozen=True)
class Prepared:
    train: DataFrame  # id, fold, class_idx, vectors
    test: DataFrame
    labels: list[str]
    prep: Preparation


def prepare(rows: Enriched, config: JobConfig, vectors: tuple[str, ...] = VECTORS) -> Prepared:
    """Augment training rows, then turn both frames into vectors.

    The written rows are most of a job's disk; ``vectors`` names those that its models read.
    """
    c = config.columns
    train = rows.train
    if config.augment:
        technical = {LABEL, "te_code", "fold", *rows.arity}
        numeric = [
            x
            for x in numeric_columns(train)
            if x not in technical and x not in (c.id, "const") and x not in categorical_columns(train, c)
        ]
        keyed = train.withColumn(c.id, F.col(c.id).cast("string"))
        # Both rows of a mixture share a fold, so no mixture leaks across folds.
        train = augment(
            keyed,
            c.id,
            [c.crop, c.soil, "fold"],
            numeric,
            c.label,
            jitter=[x for x in jitter_columns(keyed, tuple(technical)) if x in numeric],
            times=config.copies,
            alpha=config.alpha,
            seed=config.seed,
        ).drop("copy", "source")
        # A mixture's label may come from its second row.
        train = with_label_code(train.drop(LABEL), rows.labels, c.label, LABEL)
        if config.leaky:
            k = config.folds
            train = stratified_folds(train.drop("fold"), c.label, c.id, k, config.seed)
    skip = [c.id, c.label, "fold", LABEL, "te_code"]
    prep = fit_preparation(train, len(rows.labels), rows.arity, skip)
    return Prepared(
        stage(prep.transform(train, [c.id, "fold", LABEL], vectors), "zstd"),
        prep.transform(rows.test, [c.id], vectors),
        rows.labels,
        prep,
    )


def fit_mode(data: Prepared, mode: str, config: JobConfig):
    """The fitted model of a mode; ``snapshot`` and ``ranking`` give a list of models."""
    prep, size = data.prep, config.size
    if mode == "stacking":
        return Stacking(prep, config.folds, size).fit(data.train)
    if mode == "ranking":
        return list(fit_all(rankers(size, prep), data.train, size.threads).values())
    if mode == "snapshot":
        return fit_snapshots(data.train, prep, size, config.snapshots)
    if mode == "single":
        return forest(size, prep.max_bins).fit(data.train)
    if mode == "final":
        width = len(vector_names(data.train, LINEAR_FEATURES))
        models = final_candidates(prep, size, width, config.folds)
        return select_model(data.train, models, config.folds).model
    raise ValueError(f"unknown mode {mode!r}; one of {MODES}")


def score(model, df: DataFrame, n_classes: int) -> DataFrame:
    """``df`` with a ``proba`` array."""
    if isinstance(model, list):
        return predict_vote(model, df, n_classes)
    return add_proba(model, df, n_classes)


def calibration(data: Prepared, mode: str, config: JobConfig) -> tuple[list[float], list[float]]:
    """Temperatures and class weights, learnt on a fold the calibrating model did not see."""
    n = len(data.labels)
    seen = replace(data, train=data.train.where("fold <> 0"))
    held = data.train.where("fold = 0")
    if config.augment:  # originals only
        held = held.where(F.col(config.columns.id).endswith("#0"))
    inner = config
    if mode == "stacking":  # its folds are 1..k-1 here
        if config.folds < 3:
            raise ValueError("calibrating a stack needs at least 3 folds")
        seen = replace(data, train=seen.train.withColumn("fold", F.col("fold") - 1))
        inner = replace(config, folds=config.folds - 1)
    scored = score(fit_mode(seen, mode, inner), held, n)
    scored = stage(scored.select(F.col(LABEL).cast("int").alias("y"), "proba"))
    temperatures = fit_temperatures(scored, n)
    sharpened = scored.withColumn("proba", sharpen(F.col("proba"), temperatures))
    return temperatures, search_weights(sharpened, n)["weights"]


def run_job(
    train: DataFrame, test: DataFrame, mode: str = "stacking", config: JobConfig = JobConfig()
) -> DataFrame:
    """Features, encoding, augmentation, model, ranked labels: ``(id, label)``.

    With ``top=1`` the label is the most probable one, else the best ``top``
    labels, space separated.
    """
    vectors = (TREE_FEATURES,) if mode in ("snapshot", "single") else VECTORS
    data = prepare(enrich(train, test, config, config.folds), config, vectors)
    scored = score(fit_mode(data, mode, config), data.test, len(data.labels))
    if config.calibrate:
        temperatures, weights = calibration(data, mode, config)
        scored = scored.withColumn("proba", sharpen(F.col("proba"), temperatures))
        scored = scored.withColumn("proba", reweight(F.col("proba"), weights))
    c = config.columns
    if config.top == 1:
        return top1_result(scored, data.labels, c.id, c.label)
    return top_k_result(scored, data.labels, c.id, c.label, k=config.top)


def evaluate_job(
    train: DataFrame, config: JobConfig = JobConfig(), inner: int = 5, per_fold: bool = False
) -> DataFrame:
    """Scores of each outer fold with ``per_fold``; else one row: mean and population deviation of MAP@3 and accuracy over outer folds.

    Inner folds are dealt among the rows of each outer training part.
    """
    c = config.columns
    rows = enrich(train, train.limit(0), config, config.evaluation_folds)
    data = prepare(rows, replace(config, augment=False))
    both = data.train.withColumn("_stratum", F.concat_ws("|", F.col(LABEL), "fold"))
    both = stratified_folds(both, "_stratum", c.id, inner, config.seed + 1, "inner_fold")
    scores = evaluate_stack(
        stage(both.drop("_stratum"), "zstd"), data.prep, config.evaluation_folds, inner, config.size
    )
    return scores if per_fold else mean_and_spread(scores, ["map_at_3", "accuracy"])


def run_search(
    train: DataFrame,
    config: JobConfig = JobConfig(),
    search: SearchConfig = SearchConfig(),
    test: DataFrame | None = None,
    original: DataFrame | None = None,
    path: str | None = None,
) -> SearchResult:
    """Greedy search over the extra feature groups.

    Auxiliary rows with known labels only train. With ``path``, the chosen feature
    tables and a record of every round are written there.
    """
    c = config.columns
    rows = enrich(train, train.limit(0) if test is None else test, config, search.folds)
    aux = known_labels_only(original, train, c.label)
    if aux is not None:
        aux = rows.features_of(with_label_code(aux, rows.labels, c.label, LABEL))
    base = stage(rows.train, "zstd")
    found = search_features(
        base, rows.arity, len(rows.labels), config.size, search, c, aux=aux
    )
    if path is not None:
        _save_search(found, base, rows.test, aux, path, c)
    return found


def _save_search(
    found: SearchResult,
    base: DataFrame,
    test: DataFrame,
    aux: DataFrame | None,
    path: str,
    c: Columns,
) -> None:
    technical = [c.id, c.label, "fold", LABEL, "te_code"]
    for entry in found.history:
        kind = "accepted" if entry["accepted"] else "rejected"
        name = "baseline" if entry["iteration"] < 0 else f"iteration_{entry['iteration']}_{kind}"
        frame = extra_features(base, entry["groups"], c)
        append_experiment(frame, path, entry["iteration"], entry["score"], name, technical)
    chosen = found.apply(base, c)
    save_feature_tables(
        f"{path}/best",
        chosen,
        align_columns(found.apply(test, c), chosen.columns),
        None if aux is None else align_columns(found.apply(aux, c), chosen.columns),
        {
            "best_score": found.best_score,
            "best_iteration": found.best_round,
            "final_features": found.n_features,
        },
    )
