"""Exact row numbers inside large groups, without one task per group.

``row_number`` over a window partitioned by label sends each label to a single
task; with seven labels that is seven tasks, whatever the cluster. Here a group
is cut into buckets by the leading hex digits of the order key. Bucket sizes are
counted first (with map-side combining), their running sums give each bucket's
starting position, and rows are numbered inside buckets only. The result equals
the plain window's for any number of digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Leading hex digits that make a bucket: 16 ** 3 = 4096 buckets per group.
BUCKET_DIGITS = 3


def with_bucket(df: DataFrame, order_key: str, digits: int = BUCKET_DIGITS) -> DataFrame:
    return df.withColumn("_bucket", F.substring(order_key, 1, digits))


def bucket_offsets(keyed: DataFrame, group: list[str]) -> DataFrame:
    """``(group, _bucket, _n, _offset)``; at most 16 ** digits rows per group."""
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        keyed.groupBy(*group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )


def with_ordinal(
    df: DataFrame,
    group: list[str],
    order_key: str,
    tie: list[str],
    out: str = "_ordinal",
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add the 0-based position of a row in its group, by ``order_key`` then ``tie``.

    The window and the join share the keys ``(group, _bucket)``, so the rows are
    shuffled once. NULL is a group like any other: rows are never lost.
    """
    named = {f"_group_{i}": F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("")) for i, g in enumerate(group)}
    keyed, group = with_bucket(df.withColumns(named), order_key, digits), list(named)
    inside = Window.partitionBy(*group, "_bucket").orderBy(order_key, *tie)
    numbered = keyed.withColumn("_local", F.row_number().over(inside))
    offsets = bucket_offsets(keyed, group).drop("_n")
    return (
        numbered.join(offsets, [*group, "_bucket"], "left")
        .withColumn(out, F.col("_offset") + F.col("_local") - 1)
        .drop(*group, "_bucket", "_local", "_offset")
    )
