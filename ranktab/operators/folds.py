"""Stratified k-fold assignment as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktab.functions.rng import hash_order
from ranktab.operators.ordinal import BUCKET_DIGITS, with_ordinal


def stratified_folds(
    df: DataFrame,
    label: str,
    key: str,
    k: int = 5,
    seed: int = 42,
    out: str = "fold",
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add fold numbers 0..k-1; inside a label, fold sizes differ by at most one.

    Rows of a label are put into seeded hash order of ``key`` and dealt out in
    turn, so the assignment does not depend on partitioning or row order. Rows
    without a label are dealt out among themselves and get a fold too.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    ordered = df.withColumn("_order", hash_order(F.col(key), seed))
    placed = with_ordinal(ordered, [label], "_order", [key], "_ordinal", digits)
    return placed.withColumn(out, (F.col("_ordinal") % k).cast("int")).drop("_order", "_ordinal")
