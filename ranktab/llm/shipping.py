"""Make this package importable in Python workers that don't find it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once a context, unless their search path has its folder.

    Nothing is sent when ``PYTHONPATH`` or the working folder holds the package, or when it came by
    ``--py-files`` (then it lies in an archive).
    """
    context = spark.sparkContext
    places = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT in [*places, Path.cwd().resolve()] or not (ROOT / "ranktab").is_dir() or getattr(context, "_ranktab_sent", False):
        return
    archive = Path(tempfile.mkdtemp()) / "ranktab.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((ROOT / "ranktab").rglob("*.py")):
            out.write(path, path.relative_to(ROOT))
    context.addPyFile(str(archive))
    context._ranktab_sent = True
