"""Label dictionaries, category codes and target encoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranktab.operators.bounded import MAX_CLASSES, local_table
from ranktab.sources.staging import stage


# --- labels ------------------------------------------------------------------


def class_labels(df: DataFrame, label: str, max_classes: int = MAX_CLASSES) -> list[str]:
    """Distinct labels, sorted; a label column with too many values is an error."""
    rows = (
        df.select(F.col(label).alias("v"))
        .where(F.col("v").isNotNull())
        .distinct()
        .limit(max_classes + 1)
        .collect()
    )
    if len(rows) > max_classes:
        raise ValueError(f"{label!r} has more than {max_classes} classes")
    return sorted(r["v"] for r in rows)


def factorized_labels(
    df: DataFrame, label: str, key: str, max_classes: int = MAX_CLASSES
) -> list[str]:
    """Distinct labels in order of first appearance, which is the order of ``min(key)``."""
    rows = (
        df.where(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("v"))
        .agg(F.min(key).alias("first"))
        .limit(max_classes + 1)
        .collect()
    )
    if len(rows) > max_classes:
        raise ValueError(f"{label!r} has more than {max_classes} classes")
    return [r["v"] for r in sorted(rows, key=lambda r: (r["first"], r["v"]))]


def with_label_code(
    df: DataFrame, labels: list[str], label: str, out: str = "class_idx"
) -> DataFrame:
    """Add each label's position in ``labels``; unknown labels get NULL."""
    dim = local_table(
        df.sparkSession, {label: labels, out: list(range(len(labels)))}
    ).withColumn(out, F.col(out).cast("int"))
    return df.join(F.broadcast(dim), label, "left")


def known_labels_only(
    aux: DataFrame | None, train: DataFrame, label: str
) -> DataFrame | None:
    """Auxiliary rows whose label occurs in training; None when there is no such row."""
    if aux is None or label not in aux.columns:
        return None
    kept = aux.join(F.broadcast(_label_frame(train, label)), label, "left_semi")
    return None if kept.isEmpty() else kept


def _label_frame(train: DataFrame, label: str) -> DataFrame:
    return local_table(train.sparkSession, {label: class_labels(train, label)})


# --- category codes ----------------------------------------------------------


def fit_category_codes(df: DataFrame, columns: list[str]) -> StringIndexerModel:
    """Alphabetical dictionaries of several string columns, fitted in one pass."""
    return StringIndexer(
        inputCols=columns,
        outputCols=[f"{c}_code" for c in columns],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    ).fit(df)


def apply_category_codes(model: StringIndexerModel, df: DataFrame) -> DataFrame:
    """Integer codes; unseen or missing strings give -1."""
    coded = model.transform(df)
    for out, labels in zip(model.getOutputCols(), model.labelsArray):
        code = F.col(out).cast("int")
        coded = coded.withColumn(out, F.when(code < len(labels), code).otherwise(F.lit(-1)))
    return coded


# --- target encoding ---------------------------------------------------------


@dataclass(frozen=True)
class TargetEncoding:
    """Mean target per key (a staged table), and the overall mean."""

    table: DataFrame  # (key, out)
    key: str
    out: str
    prior: float | None

    def transform(self, df: DataFrame) -> DataFrame:
        """Keys that were not seen get the overall mean.

        How the tables meet follows from the key table's measured size; a key that
        very many rows share is split by the adaptive skew join.
        """
        joined = df.join(self.table, [self.key], "left")
        return joined.withColumn(self.out, F.coalesce(self.out, F.lit(self.prior)))

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(f"{path}/table")
        local_table(
            self.table.sparkSession,
            {"key": [self.key], "out": [self.out], "prior": [self.prior]},
        ).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TargetEncoding:
        meta = spark.read.parquet(f"{path}/meta").first()
        table = spark.read.parquet(f"{path}/table")
        return TargetEncoding(table, meta["key"], meta["out"], meta["prior"])


def _sums(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum(F.col(target).cast("double")).alias("_s"), F.count(target).alias("_n")
    )


def _overall_mean(sums: DataFrame) -> float | None:
    return sums.agg(F.try_divide(F.sum("_s"), F.sum("_n").cast("double"))).first()[0]


def fit_target_encoding(
    df: DataFrame, key: str, target: str, out: str | None = None
) -> TargetEncoding:
    """Mean of ``target`` per ``key``; one pass over ``df``."""
    out = out or f"{key}_target_encoded"
    sums = stage(_sums(df, [key], target))
    table = sums.select(key, F.try_divide(F.col("_s"), F.col("_n").cast("double")).alias(out))
    return TargetEncoding(table, key, out, _overall_mean(sums))


def out_of_fold_encoding(
    df: DataFrame,
    key: str,
    target: str,
    fold: str = "fold",
    out: str | None = None,
) -> DataFrame:
    """Mean of ``target`` per ``key`` over the rows of all *other* folds.

    One pre-aggregation to (key, fold) serves every fold: a fold's encoding is the
    key's total minus the fold's own part. A key that no other fold has gets the
    overall mean. The window runs over the pre-aggregated parts, k rows per key.
    """
    out = out or f"{key}_target_encoded"
    parts = stage(_sums(df, [key, fold], target))
    of_key = Window.partitionBy(key)
    held_out = parts.select(
        key,
        fold,
        F.try_divide(
            F.sum("_s").over(of_key) - F.col("_s"),
            (F.sum("_n").over(of_key) - F.col("_n")).cast("double"),
        ).alias(out),
    )
    joined = df.join(held_out, [key, fold], "left")
    return joined.withColumn(out, F.coalesce(out, F.lit(_overall_mean(parts))))
