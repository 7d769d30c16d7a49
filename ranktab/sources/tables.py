"""Readers of the task's tables."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranktab.operators.encoding import known_labels_only
from ranktab.operators.quality import validate
from ranktab.operators.shaping import fix_spelling
from ranktab.schema import TITLE, Columns, column_type, role_spelling

log = logging.getLogger(__name__)


def read_table(spark: SparkSession, path: str, columns: Columns = TITLE) -> DataFrame:
    """CSV with a header row, or Parquet (told by the path).

    CSV columns are found by their header name, whatever their order, and cast
    to their role's declared type, so no pass over the data infers a schema. A
    role's name may differ in case; it gets the declared spelling.
    """
    if path.rstrip("/").endswith(".parquet"):
        df = role_spelling(fix_spelling(spark.read.parquet(path)), columns)
    else:
        df = role_spelling(fix_spelling(spark.read.option("header", True).csv(path)), columns)
        df = df.select(
            *[F.col(f"`{c}`").cast(column_type(columns, c)).alias(c) for c in df.columns]
        )
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in the input; SQL calls that NULL."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nullif(F.col(f"`{c}`"), F.lit(float("nan"))) for c in floats})


def read_optional(
    spark: SparkSession, path: str | None, columns: Columns = TITLE
) -> DataFrame | None:
    """An auxiliary table, or None with a warning when there is none to read."""
    if path is None:
        log.warning("no auxiliary table configured")
        return None
    try:
        table = read_table(spark, path, columns)
        table.head(1)  # a file that cannot be read fails here, not in the job
        return table
    except (PySparkException, Py4JJavaError) as e:
        log.warning("cannot read auxiliary table %s: %s", path, e)
        return None


@dataclass(frozen=True)
class Dataset:
    """Lazily built input frames. Label and id stay columns: rows have no position."""

    train: DataFrame
    test: DataFrame
    original: DataFrame | None
    columns: Columns

    @property
    def x_train(self) -> DataFrame:
        return self.train.drop(self.columns.id, self.columns.label)

    @property
    def y_train(self) -> DataFrame:
        return self.train.select(self.columns.id, self.columns.label)

    @property
    def x_test(self) -> DataFrame:
        return self.test.drop(self.columns.id)

    def known_original(self) -> DataFrame | None:
        """Auxiliary rows whose label training knows."""
        return known_labels_only(self.original, self.train, self.columns.label)


def load_dataset(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    original_path: str | None = None,
    columns: Columns = TITLE,
    check: bool = True,
) -> Dataset:
    """Read all tables; differing features are reported, not fatal."""
    data = Dataset(
        read_table(spark, train_path, columns),
        read_table(spark, test_path, columns),
        read_optional(spark, original_path, columns),
        columns,
    )
    if check and not validate(data.train, data.test, columns.id, columns.label):
        log.warning("train and test do not have the same features")
    return data
