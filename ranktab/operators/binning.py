"""Fitted bins and thresholds as Spark ML estimators.

``fit`` learns edges from one frame (the training rows); ``transform`` is a
plain ``select`` of comparisons against literals. Everything fitted is a Param,
so the models save and load inside a ``Pipeline``.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from ranktab.functions.bins import above, bin_code, distinct_edges
from ranktab.operators.quantiles import (
    equal_width_edges,
    even_probabilities,
    medians,
    quantiles,
)


class _BinParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to bin", TypeConverters.toListString)
    outputCols = Param(Params._dummy(), "outputCols", "code columns", TypeConverters.toListString)
    bins = Param(Params._dummy(), "bins", "number of bins", TypeConverters.toInt)
    strategy = Param(
        Params._dummy(), "strategy", "quantile or width", TypeConverters.toString
    )
    mode = Param(Params._dummy(), "mode", "exact or approx quantiles", TypeConverters.toString)

    def pairs(self) -> list[tuple[str, str]]:
        return list(zip(self.getOrDefault("inputCols"), self.getOrDefault("outputCols")))


class Binner(Estimator, _BinParams, DefaultParamsReadable, DefaultParamsWritable):
    """Right-closed bins with quantile or equal-width edges."""

    @keyword_only
    def __init__(
        self, *, inputCols=None, outputCols=None, bins=20, strategy="quantile", mode="exact"
    ):
        super().__init__()
        self._setDefault(bins=20, strategy="quantile", mode="exact")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> BinnerModel:
        cols = self.getOrDefault("inputCols")
        bins = self.getOrDefault("bins")
        if self.getOrDefault("strategy") == "quantile":
            found = quantiles(
                dataset, cols, even_probabilities(bins), mode=self.getOrDefault("mode")
            )
        else:
            found = equal_width_edges(dataset, cols, bins)
        model = BinnerModel()
        model._set(
            inputCols=cols,
            outputCols=self.getOrDefault("outputCols"),
            edges=[distinct_edges(found[c] or []) for c in cols],
        )
        return model


class BinnerModel(Model, _BinParams, DefaultParamsReadable, DefaultParamsWritable):
    edges = Param(Params._dummy(), "edges", "distinct edges per input", TypeConverters.identity)

    def codes(self) -> dict:
        """``{output column: Column}``."""
        return {
            out: bin_code(col, edges)
            for (col, out), edges in zip(self.pairs(), self.getOrDefault("edges"))
        }

    def arity(self) -> dict[str, int]:
        """Number of codes each output column can take."""
        return {
            out: max(len(e) - 1, 0)
            for (_, out), e in zip(self.pairs(), self.getOrDefault("edges"))
        }

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns(self.codes())


class MedianFlag(Estimator, _BinParams, DefaultParamsReadable, DefaultParamsWritable):
    """1 when a value lies strictly above the fitted median, else 0."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, mode="exact"):
        super().__init__()
        self._setDefault(mode="exact")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> MedianFlagModel:
        cols = self.getOrDefault("inputCols")
        found = medians(dataset, cols, mode=self.getOrDefault("mode"))
        model = MedianFlagModel()
        model._set(
            inputCols=cols,
            outputCols=self.getOrDefault("outputCols"),
            thresholds=[found[c] for c in cols],
        )
        return model


class MedianFlagModel(Model, _BinParams, DefaultParamsReadable, DefaultParamsWritable):
    thresholds = Param(Params._dummy(), "thresholds", "median per input", TypeConverters.identity)

    def flags(self) -> dict:
        return {
            out: above(col, t)
            for (col, out), t in zip(self.pairs(), self.getOrDefault("thresholds"))
        }

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns(self.flags())
