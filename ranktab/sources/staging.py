"""Intermediate tables that outlive the executors that made them.

A staged table is Parquet in the folder that ``spark.checkpoint.dir`` names:
it cuts lineage, survives lost executors, and still allows column pruning.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_scopes: list[list[str]] = []


@contextmanager
def staged_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables staged inside when it ends; what is kept must be written before."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(hadoop).delete(place, True)


def staging_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode without a setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    root = context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="ranktab-"))
    return context.getCheckpointDir()


def stage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the staging folder and read it back; ``compression`` is a Parquet codec, else the session's."""
    path = f"{staging_root(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)
