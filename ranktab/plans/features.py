"""The base feature set as one estimator, and the extra feature groups.

Fitting learns edges, medians and zone edges of all measurements together;
transforming is one ``select`` of native expressions.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranktab.functions import domain
from ranktab.functions.bins import above, above_code, bin_code, distinct_edges
from ranktab.operators.quantiles import (
    binary_quantiles,
    equal_width_edges,
    even_probabilities,
    quantiles,
)
from ranktab.operators.shaping import add_missing_columns
from ranktab.schema import SNAKE, Columns, has_columns


@dataclass(frozen=True)
class FeatureConfig:
    """Switches and sizes of the base feature set.

    ``parity`` adds the bin codes of the 0/1 flags (almost always constant).
    """

    binned: bool = True
    strategy: str = "quantile"  # or "width"
    bins: int = 10
    zones: int = 5
    quantile_mode: str = "exact"  # or "approx"
    constant: bool = True
    environment: bool = True
    temp_humidity_index: bool = True
    climate_comfort: bool = True
    nutrients: bool = True
    nutrient_total: bool = True
    nutrient_balance: bool = True
    epsilon: float = domain.RATIO_EPSILON
    temperature_suitability: bool = True
    crop_soil: bool = True
    parity: bool = False


class _FeatureParams(Params):
    columns = Param(Params._dummy(), "columns", "column roles", TypeConverters.identity)
    config = Param(Params._dummy(), "config", "switches", TypeConverters.identity)

    def roles(self) -> Columns:
        return Columns(**self.getOrDefault("columns"))

    def settings(self) -> FeatureConfig:
        return FeatureConfig(**self.getOrDefault("config"))


class BaseFeatures(Estimator, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of the base features.

    Groups whose input columns are absent are left out, as are switched-off ones.
    """

    def __init__(self, columns: Columns = SNAKE, config: FeatureConfig = FeatureConfig()):
        super().__init__()
        self._set(columns=asdict(columns), config=asdict(config))

    def _fit(self, dataset: DataFrame) -> BaseFeaturesModel:
        c, cfg = self.roles(), self.settings()
        binned = [x for x in c.numerics if x in dataset.columns] if cfg.binned else []
        zoned = [x for x in c.climate if x in dataset.columns] if cfg.environment else []
        needed = [x for x in c.numerics if x in binned or x in zoned]
        wanted = sorted(
            {0.5, *even_probabilities(cfg.zones)}
            | (set(even_probabilities(cfg.bins)) if cfg.strategy == "quantile" else set())
        )
        found = quantiles(dataset, needed, wanted, mode=cfg.quantile_mode)

        def at(col: str, probabilities: list[float]) -> list[float]:
            values = found[col]
            return [values[wanted.index(p)] for p in probabilities] if values else []

        if cfg.strategy == "quantile":
            edges = {x: distinct_edges(at(x, even_probabilities(cfg.bins))) for x in binned}
        else:
            edges = {
                x: distinct_edges(e or [])
                for x, e in equal_width_edges(dataset, binned, cfg.bins).items()
            }
        thresholds = {x: (at(x, [0.5]) or [None])[0] for x in binned}
        flag_edges: dict[str, list[float]] = {}
        if cfg.parity and binned:
            counts = dataset.agg(
                F.count(F.lit(1)).alias("_rows"),
                *[F.sum(above(x, thresholds[x])).alias(x) for x in binned],
            ).first()
            for x in binned:
                ones = counts[x] or 0
                tenths = binary_quantiles(counts["_rows"] - ones, ones, even_probabilities(10))
                flag_edges[x] = distinct_edges(tenths) if counts["_rows"] else []
        model = BaseFeaturesModel()
        model._set(
            columns=asdict(c),
            config=asdict(cfg),
            edges=edges,
            thresholds=thresholds,
            zoneEdges={x: distinct_edges(at(x, even_probabilities(cfg.zones))) for x in zoned},
            flagEdges=flag_edges,
        )
        return model


class BaseFeaturesModel(Model, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    edges = Param(Params._dummy(), "edges", "bin edges", TypeConverters.identity)
    thresholds = Param(Params._dummy(), "thresholds", "medians", TypeConverters.identity)
    zoneEdges = Param(Params._dummy(), "zoneEdges", "zone edges", TypeConverters.identity)
    flagEdges = Param(Params._dummy(), "flagEdges", "flag edges", TypeConverters.identity)

    def expressions(self, df: DataFrame) -> dict[str, Column]:
        """``{feature: Column}`` in the documented order, as far as ``df`` has the inputs."""
        c, cfg = self.roles(), self.settings()

        def present(name: str) -> dict[str, list[float]]:
            fitted = self.getOrDefault(name)
            return {x: edges for x, edges in fitted.items() if has_columns(df, [x])}

        out: dict[str, Column] = {}
        medians = self.getOrDefault("thresholds")
        for x, edges in present("edges").items():
            out[f"{x}_cat"] = bin_code(x, edges)
            out[f"{x}_high"] = above(x, medians[x])
        for x, edges in present("flagEdges").items():
            out[f"{x}_high_cat"] = above_code(x, medians[x], edges)
        if cfg.constant:
            out["const"] = F.lit(1)
        if cfg.environment:
            if has_columns(df, c.climate):
                found = domain.environment(c)
                if not cfg.temp_humidity_index:
                    found.pop("temp_humidity_index")
                if not cfg.climate_comfort:
                    found.pop("climate_comfort")
                out.update(found)
            for x, edges in present("zoneEdges").items():
                out[f"{x.lower()}_zone"] = bin_code(x, edges)
        if cfg.nutrients and has_columns(df, c.nutrients):
            found = domain.nutrients(c, cfg.epsilon)
            if not cfg.nutrient_total:
                found.pop("Total_NPK")
            if not cfg.nutrient_balance:
                found.pop("NPK_balance")
            out.update(found)
        if cfg.temperature_suitability and has_columns(df, [c.crop, c.temperature]):
            out.update(domain.temperature_suitability(c))
        if cfg.crop_soil and has_columns(df, c.strings):
            out.update(domain.crop_soil(c))
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns(self.expressions(dataset))

    def arity(self) -> dict[str, int]:
        """Number of codes of every integer-coded feature this model makes."""
        c = self.roles()
        out = {f"{x}_cat": len(e) - 1 for x, e in self.getOrDefault("edges").items()}
        out.update({f"{x}_high": 2 for x in self.getOrDefault("edges")})
        out.update({f"{x}_high_cat": len(e) - 1 for x, e in self.getOrDefault("flagEdges").items()})
        out.update(
            {f"{x.lower()}_zone": len(e) - 1 for x, e in self.getOrDefault("zoneEdges").items()}
        )
        stress = ["temp_stress", "humidity_stress", "moisture_stress"]
        out.update({x: 2 for x in [*stress, "temp_suitability"]})
        return {k: max(v, 1) for k, v in out.items()}


def create_base_features(
    df: DataFrame, columns: Columns = SNAKE, config: FeatureConfig = FeatureConfig()
) -> DataFrame:
    """Fit and apply on the same frame. Prefer one model fitted on training rows."""
    return BaseFeatures(columns, config).fit(df).transform(df)


def extra_features(
    df: DataFrame,
    groups: list[str],
    columns: Columns = SNAKE,
) -> DataFrame:
    """Add the named groups whose inputs are present; columns already there are kept."""
    for name in groups:
        build, needs = domain.EXTRA_GROUPS[name]
        if has_columns(df, needs(columns)):
            df = add_missing_columns(df, build(columns))
    return df


def search_round_features(df: DataFrame, round_no: int, columns: Columns = SNAKE) -> DataFrame:
    """The groups of one search round; rounds beyond the table add nothing."""
    return extra_features(df, domain.SEARCH_ROUNDS.get(round_no, []), columns)


# --- categorical columns -----------------------------------------------------


def categorical_columns(df: DataFrame, columns: Columns = SNAKE) -> list[str]:
    """Columns to treat as categories: bins and zones, strings, flags (told by name)."""
    strings = [*columns.strings, columns.combo]
    parts = ("_cat", "_zone", "_high", "_stress", "_suitability")
    return [x for x in df.columns if x in strings or any(p in x for p in parts)]


def mark_categorical(df: DataFrame, arity: dict[str, int]) -> DataFrame:
    """Attach nominal attributes, so tree learners split on categories.

    Codes move up by one: level 0 stands for a missing code.
    """
    for name, n in arity.items():
        if name in df.columns:
            meta = {"ml_attr": {"type": "nominal", "name": name, "num_vals": n + 1}}
            level = F.coalesce(F.col(name) + 1, F.lit(0)).cast("double")
            df = df.withMetadata(name, {}).withColumn(name, level.alias(name, metadata=meta))
    return df
