"""Small tables made by the driver, and the bound of class lists."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Most classes a label may have; a class list lives in plans and on the driver.
MAX_CLASSES = 1_000

def local_table(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """A small driver-side table as a literal relation (no job to build it)."""
    return spark.createDataFrame(pa.table(columns))
