"""Quality scores by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranktab.llm.arrowtext import content, sliced, word_spans, words
from ranktab.llm.labelled import FIT_ROWS, held_out, training_rows
from ranktab.llm.tokens import BLANK

# Byte classes: 0 other, 1 lower case, 2 upper case, 3 beyond ASCII, 4 digit, 5 white space, 6 full
# stop or comma, 7 other ASCII sign.
CLASS = np.zeros(256, np.uint8)
CLASS[33:127] = 7
CLASS[97:123], CLASS[65:91], CLASS[128:], CLASS[48:58] = 1, 2, 3, 4
CLASS[[9, 10, 11, 12, 13, 32]] = 5
CLASS[[44, 46]] = 6
STATISTICS = (
    "log_words", "word_length", "upper_share", "digit_share", "stop_share", "sign_share", "other_share", "line_share",
    "distinct_words", "distinct_pairs", "immediate_repeats", "long_words",
)
LIMIT = 60.0
SLICE = 2 << 20  # bytes of text whose words are held at a time


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per whole text.

    Shares carry a few pseudo-counts, so that short texts lie near the middle, and are spread by a logit.
    """
    data, offsets = content(texts)
    n = len(texts)
    kinds = np.zeros((n, 8), np.int64)
    classes = CLASS[data]
    for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        kinds[i] = np.bincount(classes[a:b], minlength=8)
    starts, ends, first = word_spans(data, offsets, ~BLANK)
    count = np.diff(first).astype(float)
    doc = np.repeat(np.arange(n), np.diff(first))
    code = words(data, starts, ends, ~BLANK).indices.to_numpy().astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    top = int(code.max()) + 1 if len(code) else 1
    total = lambda where: np.bincount(where, minlength=n).astype(float)
    distinct = total(np.unique(doc * top + code) // top)
    same = doc[1:] == doc[:-1]
    repeats = total(doc[1:][same & (code[1:] == code[:-1])])
    _, pair = np.unique(code[:-1][same] * top + code[1:][same], return_inverse=True)
    width = len(pair) + 1
    pairs = total(np.unique(doc[1:][same] * width + pair) // width)
    long_words = total(doc[(ends - starts) > 24])
    lines = np.zeros(n)
    breaks = np.flatnonzero(data == 10)
    lines += np.bincount(np.searchsorted(offsets, breaks, side="right") - 1, minlength=n)[:n]
    solid = kinds.sum(axis=1) - kinds[:, 5]

    def spread(part: np.ndarray, whole: np.ndarray, usual: float, weight: float) -> np.ndarray:
        share = (part + usual * weight) / (np.maximum(whole, part) + weight)
        return np.log(share) - np.log1p(-np.minimum(share, 1 - 1e-9))

    columns = [
        np.log1p(count),
        np.log((solid + 50.0) / (count + 10.0)),
        spread(kinds[:, 2], solid, 0.03, 30),
        spread(kinds[:, 4], solid, 0.005, 30),
        spread(kinds[:, 6], solid, 0.03, 30),
        spread(kinds[:, 7], solid, 0.005, 30),
        spread(kinds[:, 0], solid, 0.001, 30),
        spread(lines, count, 0.02, 20),
        spread(distinct, count, 0.9, 10),
        spread(pairs, np.maximum(count - 1, 0), 0.97, 10),
        spread(repeats, count, 0.005, 10),
        spread(long_words, count, 0.002, 10),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Discriminant:
    """Class densities with cached Cholesky factors, and the scale of their difference."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # class, statistic
    factors: np.ndarray  # class, lower triangular factor of the covariance
    bias: float  # log odds of the classes
    slope: float
    shift: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with the classes' log odds."""
        z = (x - self.centre) / self.scale
        logs = []
        for mean, factor in zip(self.means, self.factors):
            whitened = np.linalg.solve(factor, (z - mean).T)
            logs.append(-0.5 * (whitened**2).sum(axis=0) - np.log(np.diag(factor)).sum())
        return np.clip(logs[1] - logs[0] + self.bias, -LIMIT, LIMIT)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -LIMIT, LIMIT)))


def fit(x: np.ndarray, y: np.ndarray, to_pooled: float = 0.3, to_round: float = 0.05) -> Discriminant | float:
    """Fit the densities: each class covariance is shrunk to the pooled one, then to a round one.

    The difference is put on the scale of a probability by a logistic curve in it, fitted with a
    little shrinkage. With fewer than two rows of a class, a constant: class 1's share, or 0.5 without rows.
    """
    n = [int((y == c).sum()) for c in (0, 1)]
    if min(n) < 2:
        return n[1] / sum(n) if sum(n) else 0.5
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - centre) / scale
    groups = [z[y == c] for c in (0, 1)]
    means = np.stack([g.mean(axis=0) for g in groups])
    own = [(g - m).T @ (g - m) / len(g) for g, m in zip(groups, means)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    eye = np.eye(z.shape[1])
    factors = []
    for s in own:
        s = (1 - to_pooled) * s + to_pooled * pooled
        s = (1 - to_round) * s + (to_round * np.trace(s) / len(eye) + 1e-6) * eye
        factors.append(np.linalg.cholesky(s))
    model = Discriminant(centre, scale, means, np.stack(factors), float(np.log(n[1] / n[0])), 1.0, 0.0)
    model.slope, model.shift = _logistic(model.difference(x), y)
    return model


def _logistic(d: np.ndarray, y: np.ndarray, usual: float = 0.5, weight: float = 1.0) -> tuple[float, float]:
    """Slope and shift of a logistic curve, drawn to a usual slope and no shift; Newton steps are
    halved until the loss falls, so classes that are wholly apart do no harm."""
    design, w = np.stack([d, np.ones_like(d)], axis=1), np.array([usual, 0.0])

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, -(2 * y - 1) * (design @ v)).sum() + weight / 2 * ((v - [usual, 0.0]) ** 2).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -LIMIT, LIMIT)))
        bend = (design * (p * (1 - p))[:, None]).T @ design + weight * np.eye(2)
        step = np.linalg.solve(bend, design.T @ (y - p) - weight * (w - [usual, 0.0]))
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def _statistics_frame(rows: DataFrame, keep: str) -> DataFrame:
    kind = rows.schema[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, "text", SLICE):
                x = statistics(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=[keep, "x"])

    return rows.select(keep, "text").mapInArrow(run, T.StructType([kind, T.StructField("x", T.ArrayType(T.DoubleType()))]))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Discriminant | float:
    """Fit on about ``rows`` labelled documents; only their statistics (96 bytes a row) come to the driver."""
    found = _statistics_frame(training_rows(docs, labels, label, rows), "label").collect()
    if not found:
        return 0.5
    return fit(np.array([r["x"] for r in found]), np.array([r["label"] for r in found]))


def quality_scores(docs: DataFrame, model: Discriminant | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: better) of every row's whole text.

    A null text counts as empty and gets the score of an empty one. Repeated rows stay; null ids
    stay null; an empty table gives an empty one; other columns are not read. A model that is a
    number (no labels of one class) is everyone's score.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in sliced(batch, "text", SLICE):
                score = np.full(len(texts), model) if isinstance(model, float) else model.score(statistics(texts))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``least``."""
    model = fit_quality(docs, labels)
    clash = "_quality_score"
    while clash in docs.columns:
        clash += "_"

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        from ranktab.llm.arrowtext import texts_of

        parts = [np.full(len(texts), model) if isinstance(model, float) else model.score(statistics(t)) for t in _portions(texts_of(texts))]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return docs.withColumn(clash, scored(F.col("text").cast("string"))).where(F.col(clash) >= least).drop(clash)


def _portions(texts: pa.Array) -> Iterator[pa.Array]:
    for _, part in sliced(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", SLICE):
        yield part


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit and score: ``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 from 0.5 on)."""
    scores = quality_scores(docs, fit_quality(docs, labels))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
