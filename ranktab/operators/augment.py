"""Row augmentation: jittered copies and mixtures of two rows of a stratum.

All draws come from row keys (see ``functions.rng``), so a rerun, a retried
task or another cluster size makes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranktab.functions.rng import beta_symmetric, hash_order, polar_of, tagged, uniform
from ranktab.operators.ordinal import BUCKET_DIGITS, bucket_offsets, with_bucket
from ranktab.operators.shaping import replicate
from ranktab.sources.staging import stage

#: Name parts of the columns that get jitter (fixed values).
JITTER_NAMES = ("nitrogen", "phosphorous", "potassium", "npk")
JITTER_SCALE = 0.01
#: Most mixtures made from one stratum (fixed value).
MIX_LIMIT = 10


def jitter_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    """Long, int or double columns with a nutrient in their name.

    Category codes are integers here, so callers name them in ``skip``.
    """
    kinds = (T.LongType, T.IntegerType, T.DoubleType)
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, kinds)
        and any(p in f.name.lower() for p in JITTER_NAMES)
        and f.name not in skip
    ]


def jitter_expand(
    df: DataFrame,
    key: str,
    columns: list[str],
    times: int = 3,
    scale: float = JITTER_SCALE,
    seed: int = 42,
) -> DataFrame:
    """Original rows (copy 0) and ``times - 1`` jittered copies; narrow.

    A copy's value is times (1 + Normal(0, scale)), not below 0. Columns 2i and 2i+1 share one
    digest: its two uniforms give two normals. Digests, radii and angles are columns of their
    own, so that each is made once for its two columns, and none for originals.
    """
    pairs = range((len(columns) + 1) // 2)
    drawn = F.col("copy") != 0
    text = lambda i: tagged(F.col(key), "jitter", seed, F.col("copy"), i).cast("binary")
    rows = replicate(df, times).withColumns({f"_digest_{i}": F.when(drawn, F.md5(text(i))) for i in pairs})
    polar = {i: polar_of(F.col(f"_digest_{i}")) for i in pairs}
    rows = rows.withColumns({f"_radius_{i}": r for i, (r, _) in polar.items()} | {f"_angle_{i}": a for i, (_, a) in polar.items()})
    changed = {}
    for i, c in enumerate(columns):
        turn = F.sin if i % 2 else F.cos
        z = F.col(f"_radius_{i // 2}") * turn(f"_angle_{i // 2}")
        moved = F.col(c) * (F.lit(1.0) + F.lit(scale) * z)
        moved = F.when(F.col(c).isNotNull(), F.greatest(moved, F.lit(0.0)))
        changed[c] = F.when(drawn, moved).otherwise(F.col(c).cast("double"))
    return rows.withColumns(changed).drop(*[f"_{part}_{i}" for i in pairs for part in ("digest", "radius", "angle")])


def _drawn_rows(
    df: DataFrame, key: str, strata: list[str], limit: int, seed: int, digits: int
) -> DataFrame:
    """The drawn rows of ``df`` with ``draw`` and ``side`` (0 or 1).

    Rows have a place in seeded hash order inside their stratum; a draw picks two
    places. Bucket sizes turn places into (bucket, place in bucket), so only the
    few buckets that hold a drawn row are sorted, however large a stratum is.
    """
    rows = df.dropna(subset=strata).withColumn("_order", hash_order(F.col(key), f"mix:{seed}"))
    keyed = with_bucket(rows, "_order", digits)
    picks = stage(_drawn_places(bucket_offsets(keyed, strata), strata, limit, seed))
    needed = picks.select(*strata, "_bucket").distinct()
    inside = Window.partitionBy(*strata, "_bucket").orderBy("_order", key)
    placed = keyed.join(
        needed, [*strata, "_bucket"], "left_semi"
    ).withColumn("_local", F.row_number().over(inside) - 1)
    found = placed.join(picks, [*strata, "_bucket", "_local"])
    return found.drop("_order", "_bucket", "_local")


def stratum_text(strata: list[str]) -> Column:
    """A stratum as a string; a ``:`` inside a part is escaped, so no two strata share one."""
    parts = [F.replace(F.col(s).cast("string"), F.lit("\\"), F.lit("\\\\")) for s in strata]
    return F.concat_ws(":", *[F.replace(p, F.lit(":"), F.lit("\\:")) for p in parts])


def _pairs(drawn: DataFrame, strata: list[str], columns: list[str]) -> DataFrame:
    """One row per draw, its two rows as structs ``a`` and ``b``."""
    whole = F.struct(*[F.col(c) for c in columns])
    return drawn.groupBy(*strata, "draw").agg(
        F.first(F.when(F.col("side") == 0, whole), ignorenulls=True).alias("a"),
        F.first(F.when(F.col("side") == 1, whole), ignorenulls=True).alias("b"),
    )


def mixup_pairs(
    df: DataFrame,
    key: str,
    strata: list[str],
    limit: int = MIX_LIMIT,
    seed: int = 42,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Pairs of distinct rows: ``(strata…, draw, id_a, id_b)``.

    A stratum of n rows gives min(n // 2, limit) pairs.
    """
    drawn = _drawn_rows(df.select(key, *strata), key, strata, limit, seed, digits)
    return _pairs(drawn, strata, [key]).select(
        *strata, "draw", F.col(f"a.{key}").alias("id_a"), F.col(f"b.{key}").alias("id_b")
    )


def _drawn_places(offsets: DataFrame, strata: list[str], limit: int, seed: int) -> DataFrame:
    """``(strata…, draw, side, _bucket, _local)`` of every drawn row.

    One row per stratum holds its bucket list (at most 16 ** digits entries).
    """
    listed = offsets.groupBy(*strata).agg(
        F.sum("_n").alias("n"),
        F.array_sort(F.collect_list(F.struct("_offset", "_bucket"))).alias("buckets"),
    )
    draws = listed.select(
        *strata,
        "n",
        "buckets",
        F.explode(
            F.sequence(F.lit(1), F.least(F.floor(F.col("n") / 2), F.lit(limit)).cast("int"))
        ).alias("draw"),
    ).where("n >= 2")
    text = tagged(stratum_text(strata), "mix", seed, F.col("draw"))
    n = F.col("n")
    first = F.floor(uniform(text, 0) * n).cast("bigint")
    second = (first + 1 + F.floor(uniform(text, 1) * (n - 1)).cast("bigint")) % n
    sides = draws.select(
        *strata,
        "draw",
        "buckets",
        F.posexplode(F.array(first, second)).alias("side", "place"),
    )
    at = F.element_at("buckets", F.size(F.filter("buckets", lambda b: b["_offset"] <= F.col("place"))))
    return sides.select(
        *strata,
        "draw",
        "side",
        at["_bucket"].alias("_bucket"),
        (F.col("place") - at["_offset"]).cast("int").alias("_local"),
    )


def mixup(
    df: DataFrame,
    key: str,
    strata: list[str],
    numeric: list[str],
    label: str,
    alpha: float = 0.2,
    limit: int = MIX_LIMIT,
    seed: int = 42,
) -> DataFrame:
    """Mixed rows only: ``lam * a + (1 - lam) * b`` on numerics, the rest from a.

    The label comes from a when lam > 0.5, else from b. No strata, no rows.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    if not strata or not numeric or any(s not in kinds for s in strata):
        return df.limit(0)
    rest = [c for c in df.columns if c not in strata]
    both = _pairs(_drawn_rows(df, key, strata, limit, seed, BUCKET_DIGITS), strata, rest)
    text = tagged(stratum_text(strata), "lam", seed, F.col("draw"))
    both = both.withColumn("_text", text).withColumn("_lam", beta_symmetric("_text", alpha))
    lam = F.col("_lam")
    out = []
    for name in df.columns:
        if name in strata:
            value = F.col(name)
        elif name == key:
            value = F.concat_ws(":", F.lit("mix"), stratum_text(strata), "draw")
        elif name in numeric:
            value = lam * F.col(f"a.`{name}`") + (F.lit(1.0) - lam) * F.col(f"b.`{name}`")
        elif name == label:
            value = F.when(lam > 0.5, F.col(f"a.`{name}`")).otherwise(F.col(f"b.`{name}`"))
        else:
            value = F.col(f"a.`{name}`")
        out.append(value.alias(name))
    return both.select(*out)


def augment(
    df: DataFrame,
    key: str,
    strata: list[str],
    numeric: list[str],
    label: str,
    jitter: list[str] | None = None,
    times: int = 3,
    alpha: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Jittered copies, then mixtures drawn from originals and copies together.

    The key becomes ``key#copy``; ``source`` keeps the original one and is NULL for
    mixtures, which have two.
    """
    expanded = jitter_expand(df, key, jitter_columns(df) if jitter is None else jitter, times, seed=seed)
    expanded = expanded.withColumns(
        {"source": F.col(key), key: F.concat_ws("#", F.col(key), "copy")}
    )
    doubled = expanded.withColumns({c: F.col(c).cast("double") for c in numeric})
    mixed = mixup(doubled, key, strata, numeric, label, alpha, seed=seed)
    mixed = mixed.withColumn("source", F.lit(None).cast("string"))
    return doubled.withColumn("source", F.col("source").cast("string")).unionByName(mixed)
