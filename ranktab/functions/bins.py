"""Right-closed binning as comparisons against literal edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_edges(edges: list[float]) -> list[float]:
    return sorted(set(e for e in edges if e is not None))


def double(x: float) -> str:
    """A double literal in SQL text."""
    return f"{float(x)!r}D"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def bin_code(column: str, edges: list[float]) -> Column:
    """Index of the right-closed bin that holds the value of ``column``.

    Only the inner edges are compared, so values outside the fitted range fall
    into the first or last bin. NULL stays NULL; fewer than two distinct edges
    (a constant column) leave no bin at all, so every code is NULL. A sum of
    comparisons stays inside generated code, unlike an array lambda; as one SQL
    text it is parsed once instead of built call by call.
    """
    distinct = distinct_edges(edges)
    if len(distinct) < 2:
        return F.lit(None).cast("int")
    x = quoted(column)
    if len(distinct) == 2:
        return F.expr(f"CASE WHEN {x} IS NOT NULL THEN 0 END")
    return F.expr(" + ".join(f"CAST({x} > {double(e)} AS INT)" for e in distinct[1:-1]))


def above(column: str, threshold: float | None) -> Column:
    """1 when strictly above the threshold, else 0; NULL counts as 0."""
    if threshold is None:
        return F.lit(0)
    return F.expr(f"coalesce(CAST({quoted(column)} > {double(threshold)} AS INT), 0)")


def above_code(column: str, threshold: float | None, edges: list[float]) -> Column:
    """Bin code of the 0/1 flag that :func:`above` gives."""
    if len(distinct_edges(edges)) < 2:
        return F.lit(None).cast("int")
    flag = above(column, threshold)
    return sum((flag > F.lit(e)).cast("int") for e in distinct_edges(edges)[1:-1]) + F.lit(0)


def round_half_up(value: Column, digits: int) -> Column:
    """``F.round`` of a double column, without a decimal number per value.

    A value whose scaled fraction is not near one half rounds the same way however it is written
    out; the quotient of two whole doubles is the double nearest to that decimal. Others, very large ones
    and those that are no numbers go through ``F.round``. Give it a plain column, as it is read more than once.
    """
    scale = F.lit(10.0**digits)
    size = F.abs(value) * scale
    whole = F.floor(size + F.lit(0.5))
    near_half = F.abs(size - F.floor(size) - F.lit(0.5)) < F.lit(1e-3)
    plain = (size < F.lit(2.0**36)) & ~near_half
    return F.when(plain, F.when(value < 0, -whole).otherwise(whole).cast("double") / scale).otherwise(F.round(value, digits))
