"""Task tables derived from the star-schema test tables.

The test data has no agronomy table, so measurements, strings and labels are
derived from order lines; the rules are in ``FIXTURES.md``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktab.functions.bins import round_half_up
from ranktab.functions.rng import tagged, uniform, uniform_sql

N_CLASSES = 7
CLASSES = [f"class{i + 1}" for i in range(N_CLASSES)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # As in ``session.build_session``: above this size a method is not compiled, so Spark must split it.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _recode(value: Column, names: dict[str, str], other: str) -> Column:
    out = F
    for k, v in names.items():
        out = out.when(value == k, v)
    return out.otherwise(other)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled row per order line."""
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    orders = table(spark, sf_dir, "orders")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    )
    crop = _recode(
        F.col("p_type"),
        {
            "ECONOMY": "Maize",
            "STANDARD": "Sugarcane",
            "MEDIUM": "Cotton",
            "SMALL": "Paddy",
            "LARGE": "Wheat",
        },
        "Quinoa",
    )
    soil = _recode(
        F.substring("o_orderpriority", 1, 1),
        {"1": "Loamy", "2": "Black", "3": "Clayey", "4": "Red"},
        "Sandy",
    )
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("id"),
        (F.lit(10) + F.col("p_size") % 31).cast("int").alias("temperature"),
        (F.lit(30) + F.col("l_partkey") % 61).cast("int").alias("humidity"),
        (F.lit(20) + F.col("l_suppkey") % 61).cast("int").alias("moisture"),
        (F.col("l_quantity").cast("int") % 43).alias("nitrogen"),
        (F.col("l_orderkey") % 20).cast("int").alias("potassium"),
        (F.col("l_partkey") % 43).cast("int").alias("phosphorous"),
        crop.alias("crop_type"),
        soil.alias("soil_type"),
        F.concat(F.lit("class"), F.col("l_linenumber").cast("string")).alias("label"),
    )


def is_train(key: str = "id") -> Column:
    """About three rows in four."""
    return F.substring(F.md5(tagged(F.col(key), "split").cast("binary")), 1, 1) < "c"


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(is_train()), df.where(~is_train())


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose label follows crop, soil and nutrients for three rows in four."""
    rule = (
        F.ascii("crop_type") + F.ascii("soil_type") + F.floor(F.col("nitrogen") / 15)
    ) % N_CLASSES
    noise = F.floor(uniform(tagged(F.col("id"), "noise")) * N_CLASSES)
    keep = uniform(tagged(F.col("id"), "plant")) < 0.75
    code = F.when(keep, rule).otherwise(noise).cast("int")
    return samples(spark, sf_dir).withColumn(
        "label", F.concat(F.lit("class"), (code + 1).cast("string"))
    )


def scores(spark: SparkSession, sf_dir: str, model: str = "p") -> DataFrame:
    """``(id, label, y, proba)``: class probabilities made without any model.

    Not normalised on purpose. ``model`` names the random stream.
    """
    return with_scores(_coded(spark, sf_dir), {"proba": model})


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select(
        "id", "label", (F.substring("label", 6, 1).cast("int") - 1).alias("y")
    )


def voted_scores(spark: SparkSession, sf_dir: str, models: dict[str, str]) -> DataFrame:
    """``(id, label, y)`` and one column of class probabilities per random stream."""
    return with_scores(_coded(spark, sf_dir), models)


def with_scores(rows: DataFrame, models: dict[str, str]) -> DataFrame:
    """Add an array of class probabilities per random stream: ``{column: stream}``.

    Draws, sums and rounding are three selects, as each is read more than once: so draws stay
    compiled code, once per row, under the lambda functions that later read the arrays. The arrays
    are read twice in a fourth select, or rounding would be moved into those lambdas, which are not compiled.
    """
    kept = rows.columns
    draw = lambda text: F.expr(uniform_sql(f"concat(id, ':{text}')"))
    slots = [(c, m, i) for c, m in models.items() for i in range(N_CLASSES)]
    drawn = rows.select("*", draw("hit").alias("_hit"), draw("lift").alias("_lift"), *[draw(f"{m}:{i}").alias(f"_{m}{i}") for _, m, i in slots])
    raw = [
        F.expr(
            f"""0.0001D + 0.9D * _{m}{i} / {N_CLASSES}D
            + CASE WHEN y = {i} AND _hit < 0.9D THEN 0.3D + 0.55D * _lift ELSE 0D END"""
        ).alias(f"_{m}{i}")
        for _, m, i in slots
    ]
    summed = drawn.select(*kept, *raw)
    arrays = summed.select(
        *kept,
        *[F.array(*[round_half_up(F.col(f"_{m}{i}"), 6) for i in range(N_CLASSES)]).alias(c) for c, m in models.items()],
    )
    return arrays.select(*kept, *[F.when(F.size(c) == N_CLASSES, F.col(c)).alias(c) for c in models])
