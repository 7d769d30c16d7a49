"""Class-probability arrays: ranking, decoding, voting, rescaling.

A prediction is one ``array<double>`` column, indexed by class code. All of
these are row-local expressions; nothing here shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def top_k(proba: Column, k: int) -> Column:
    """Codes of the k most probable classes; of equal ones the higher code first."""
    pairs = F.transform(proba, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    best = F.slice(F.sort_array(pairs, asc=False), 1, k)
    return F.transform(best, lambda s: s["i"])


def argmax(proba: Column) -> Column:
    """Code of the most probable class; of equal ones the lowest."""
    return (F.array_position(proba, F.array_max(proba)) - 1).cast("int")


def rank_of(proba: Column, code: Column) -> Column:
    """1-based place of class ``code`` under the order of :func:`top_k`."""
    ahead = bind(
        F.get(proba, code),
        lambda own: F.when(
            own.isNotNull(),
            F.size(F.filter(proba, lambda p, i: (p > own) | ((p == own) & (i > code)))),
        ),
    )
    return ahead + 1


def average_precision(proba: Column, code: Column, k: int) -> Column:
    """1/place when the true class is among the first k, else 0."""
    return bind(
        rank_of(proba, code),
        lambda place: F.when(place <= k, F.lit(1.0) / place).otherwise(F.lit(0.0)),
    )


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Inside a lambda an outer expression is evaluated again for every element;
    a one-element ``transform`` gives it a name instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise(proba: Column) -> Column:
    """Scale a row to sum 1; a row that sums to 0 becomes NULLs rather than an error."""
    return bind(
        proba,
        lambda ps: bind(
            F.aggregate(ps, F.lit(0.0), lambda a, p: a + p),
            lambda total: F.transform(ps, lambda p: F.try_divide(p, total)),
        ),
    )


def soft_vote(probas: list[Column]) -> Column:
    """Element-wise mean of several probability arrays."""
    if not probas:
        raise ValueError("soft_vote needs at least one probability column")
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), probas)
    return F.transform(total, lambda x: x / F.lit(float(len(probas))))


def softmax(scores: Column) -> Column:
    """Scores to probabilities; shifted by the maximum so exp cannot overflow."""
    shifted = bind(
        scores,
        lambda xs: bind(F.array_max(xs), lambda top: F.transform(xs, lambda x: F.exp(x - top))),
    )
    return normalise(shifted)


def sharpen(proba: Column, temperatures: list[float]) -> Column:
    """p ** (1/T) per class, then renormalise; classes at T = 1 stay as they are."""
    inverse = F.array(*[F.lit(1.0 / t) for t in temperatures])
    scaled = F.zip_with(
        proba, inverse, lambda p, e: F.when(e == F.lit(1.0), p).otherwise(F.pow(p, e))
    )
    return normalise(scaled)


def reweight(proba: Column, weights: list[float]) -> Column:
    """Multiply by class weights, then renormalise."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return normalise(F.zip_with(proba, w, lambda p, x: p * x))


def decode(codes: Column, labels: list[str]) -> Column:
    """Class codes (an array) to class labels."""
    names = F.array(*[F.lit(x) for x in labels])
    return F.transform(codes, lambda i: F.get(names, i))


def decode_one(code: Column, labels: list[str]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels]), code)
