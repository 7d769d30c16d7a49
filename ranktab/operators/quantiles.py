"""Exact quantiles, medians and ranges of many columns.

Two ways give the same numbers. A column with few distinct values (a cheap
sketch tells) is counted by value first, so what reaches the last step is one
row per distinct value, however many rows and map tasks there are. A column
with many distinct values would still be too much for that step. It is cut into
ranges by a small sample; range sizes locate the wanted places, and only the
ranges that hold one are looked into: cut again while they are large, then
sorted. Cuts decide how even the work is, never the result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranktab.operators.bounded import local_table

#: Distinct values per column up to which the one-pass aggregate is used.
DISTINCT_BOUND = 100_000
#: Ranges a column is cut into on the other way.
RANGES = 2_048
#: Ranges a wanted range is cut into again.
INNER_RANGES = 256
#: Rows (about) the cuts are taken from.
CUT_SAMPLE = 500_000
#: Rows of a range up to which one task sorts it.
SORT_ROWS = 5_000_000


def even_probabilities(bins: int) -> list[float]:
    return [i / bins for i in range(bins + 1)]


def quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    mode: str = "exact",
    distinct_bound: int = DISTINCT_BOUND,
    ranges: int = RANGES,
    sort_rows: int = SORT_ROWS,
) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles per column; None for a column without values."""
    if not columns:
        return {}
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    if mode == "approx":
        found = data.agg(
            *[F.percentile_approx(c, probabilities, 10_000).alias(c) for c in columns]
        ).first()
        return {c: found[c] for c in columns}
    if mode != "exact":
        raise ValueError(f"unknown quantile mode {mode!r}")
    profile = data.agg(
        *[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)],
        *[F.approx_count_distinct(c).alias(f"d_{i}") for i, c in enumerate(columns)],
    ).first()
    small = [c for i, c in enumerate(columns) if profile[f"d_{i}"] <= distinct_bound]
    large = [c for c in columns if c not in small]
    out: dict[str, list[float] | None] = {}
    if small:
        out.update(_from_value_counts(data, small, probabilities))
    if large:
        totals = {c: profile[f"n_{i}"] for i, c in enumerate(columns) if c in large}
        out.update(_from_ranges(data, totals, probabilities, ranges, sort_rows))
    return {c: out[c] for c in columns}


def _long(data: DataFrame, columns: list[str]) -> DataFrame:
    """``(name, v)``, one row per column and value; NULLs left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in columns])
    return data.select(F.inline(pairs)).where(F.col("v").isNotNull())


def _from_value_counts(
    data: DataFrame, columns: list[str], probabilities: list[float]
) -> dict[str, list[float] | None]:
    counts = _long(data, columns).groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))
    array = F.array(*[F.lit(float(p)) for p in probabilities])
    rows = counts.groupBy("name").agg(F.percentile("v", array, F.col("n")).alias("q")).collect()
    found = {r["name"]: r["q"] for r in rows}
    return {c: found.get(c) for c in columns}


def _from_ranges(
    data: DataFrame,
    totals: dict[str, int],
    probabilities: list[float],
    ranges: int,
    sort_rows: int,
) -> dict[str, list[float] | None]:
    positions = {c: [p * (n - 1) for p in probabilities] for c, n in totals.items() if n}
    places = {
        c: sorted({f(x) for x in xs for f in (math.floor, math.ceil)})
        for c, xs in positions.items()
    }
    if not places:
        return {c: None for c in totals}
    at = _values_at(_long(data, list(places)), places, totals, ranges, sort_rows)

    def between(c: str, x: float) -> float:
        low, high = math.floor(x), math.ceil(x)
        a, b = at[(c, low)], at[(c, high)]
        return a if a == b else (high - x) * a + (x - low) * b

    return {
        c: [between(c, x) for x in positions[c]] if c in positions else None for c in totals
    }


def _values_at(
    long: DataFrame,
    places: dict[str, list[int]],
    totals: dict[str, int],
    ranges: int,
    sort_rows: int,
) -> dict[tuple[str, int], float]:
    """The values at 0-based ``places`` of each name's sorted values."""
    spark = long.sparkSession
    share = min(1.0, CUT_SAMPLE / sum(totals[c] for c in places))
    sampled = long if share >= 1.0 else long.sample(share, seed=42)
    even = [i / ranges for i in range(1, ranges)]
    rows = sampled.groupBy("name").agg(F.percentile_approx("v", even, 4 * ranges)).collect()
    ranged = _with_range(long, {r[0]: sorted(set(r[1])) for r in rows})

    sizes: dict[str, dict[int, int]] = {c: {} for c in places}
    for r in ranged.groupBy("name", "r").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["name"]][r["r"]] = r["n"]
    wanted = []  # name, range, place inside the range, place
    for c, asked in places.items():
        starts, total = [], 0
        for r in sorted(sizes[c]):
            starts.append((total, r))
            total += sizes[c][r]
        for place in asked:
            start, r = max(s for s in starts if s[0] <= place)
            wanted.append((c, r, place - start, place))
    opened = {(c, r) for c, r, _, _ in wanted}
    size = {f"{c}|{r}": sizes[c][r] for c, r in opened}
    larger = any(sizes[c][r] > sort_rows for c, r in opened)
    # A range that did not shrink holds few distinct values; sorting counts those.
    shrank = all(sizes[c][r] < totals[c] or sizes[c][r] <= sort_rows for c, r in opened)
    part = local_table(
        spark,
        {
            "name": [c for c, _ in opened],
            "r": [r for _, r in opened],
            "part": [f"{c}|{r}" for c, r in opened],
        },
    )
    inside = ranged.join(F.broadcast(part), ["name", "r"]).select(F.col("part").alias("name"), "v")
    asked_inside: dict[str, list[int]] = {}
    for c, r, i, _ in wanted:
        asked_inside.setdefault(f"{c}|{r}", []).append(i)
    if larger and shrank:
        found = _values_at(inside, asked_inside, size, INNER_RANGES, sort_rows)
    else:
        found = _sorted_values_at(inside, asked_inside)
    return {(c, place): found[(f"{c}|{r}", i)] for c, r, i, place in wanted}


def _with_range(long: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Add ``r``, the number of a name's cuts below the value.

    Cuts are laid out in blocks, so a row takes about 2·sqrt(cuts) comparisons.
    """
    names, steps, heads, blocks = [], [], [], []
    for name, points in cuts.items():
        step = max(1, math.isqrt(len(points)))
        names.append(name)
        steps.append(step)
        blocks.append([points[i : i + step] for i in range(0, len(points), step)])
        heads.append([b[-1] for b in blocks[-1]])
    table = local_table(
        long.sparkSession, {"name": names, "step": steps, "heads": heads, "blocks": blocks}
    )

    def below(points: str) -> str:
        return f"size(filter({points}, e -> e < v))"

    # Names the sample missed have no cuts: one range.
    return (
        long.join(F.broadcast(table), "name", "left")
        .withColumn("block", F.expr(f"coalesce({below('heads')}, 0)"))
        .selectExpr(
            "name", "v", f"coalesce(block * step, 0) + coalesce({below('get(blocks, block)')}, 0) AS r"
        )
    )


def _sorted_values_at(
    long: DataFrame, places: dict[str, list[int]]
) -> dict[tuple[str, int], float]:
    """The same by sorting each name; a hot value is one row here, with its count."""
    upto = Window.partitionBy("name").orderBy("v")
    values = (
        long.groupBy("name", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("after", F.sum("n").over(upto))
    )
    asked = [(c, i) for c, xs in places.items() for i in sorted(set(xs))]
    table = local_table(
        long.sparkSession, {"name": [c for c, _ in asked], "place": [i for _, i in asked]}
    )
    hit = (F.col("place") < F.col("after")) & (F.col("place") >= F.col("after") - F.col("n"))
    rows = values.join(F.broadcast(table), "name").where(hit).collect()
    return {(r["name"], r["place"]): r["v"] for r in rows}


def binary_quantiles(zeros: int, ones: int, probabilities: list[float]) -> list[float]:
    """Quantiles of a 0/1 column from its two counts."""
    edges = []
    for p in probabilities:
        position = p * (zeros + ones - 1)
        a, b = float(math.floor(position) >= zeros), float(math.ceil(position) >= zeros)
        edges.append(a if a == b else position - math.floor(position))
    return edges


def medians(df: DataFrame, columns: list[str], **options) -> dict[str, float | None]:
    found = quantiles(df, columns, [0.5], **options)
    return {c: (v[0] if v else None) for c, v in found.items()}


def equal_width_edges(
    df: DataFrame, columns: list[str], bins: int
) -> dict[str, list[float] | None]:
    """Edges of ``bins`` equal-width bins between the minimum and the maximum.

    A constant column gets a span of 0.1 % around its value (0.001 at zero).
    """
    if not columns:
        return {}
    row = df.agg(
        *[F.min(c).cast("double").alias(f"lo_{i}") for i, c in enumerate(columns)],
        *[F.max(c).cast("double").alias(f"hi_{i}") for i, c in enumerate(columns)],
    ).first()
    out: dict[str, list[float] | None] = {}
    for i, c in enumerate(columns):
        low, high = row[f"lo_{i}"], row[f"hi_{i}"]
        if low is None:
            out[c] = None
            continue
        if low == high:
            pad = 0.001 * abs(low) if low != 0 else 0.001
            low, high = low - pad, high + pad
        out[c] = [low + (high - low) * j / bins for j in range(bins + 1)]
    return out
