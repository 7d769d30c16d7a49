"""Whitening of embeddings by a covariance that polarisation makes exact.

For centred integer values ``u = n * x - S`` (``S`` the per-dimension sums, ``n`` the rows), every
dimension's sum of ``u_j^2`` and every pair's sum of ``(u_j + u_k)^2`` is aggregated exactly; the
cross terms follow as differences, ``sum u_j u_k = (P_jk - Q_jj - Q_kk) / 2``, and the covariance is
that over ``n^3``. Only sums of squares are ever formed.

Work per row is one pass for ``n`` and ``S`` (Spark aggregates), one pass of exact pair squares
(numpy in tasks, 64-bit pieces, combined as Python integers and summed by Spark as decimals), one
eigendecomposition of a ``D x D`` matrix on the driver, and one projection pass in SQL. What
reaches the driver is bounded by the dimension, never by the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktab.sources.staging import stage

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
PIECE = 21  # bits of the low piece of a pair sum
CELLS = 1 << 22  # pair sums held at a time in one task


def _valid(vec: str) -> F.Column:
    bad = F.exists(F.col(vec), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.col(vec).isNotNull() & ~bad


def integer_rows(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x`` (array of long ``floor(64 * c) + 1000000``) of rows whose vector is whole.

    Rows with a null vector, a null or non-finite entry, or an id of null go; so do vectors of another
    length than the commonest one (ties: the longer), which cannot share one covariance.
    """
    whole = rows.where(_valid(vec_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(vec_col, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long") + F.lit(SHIFT)).alias("x"),
    )
    lengths = whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return whole.where(F.size("x") == (lengths[0]["d"] if lengths else 0))


def _pair_squares(n: int, sums: list[int]):
    """Per task: exact sums of ``u_j^2`` (as pair ``(j, j)``) and of ``(u_j + u_k)^2`` for ``j < k``."""
    shift = np.asarray(sums, dtype=np.int64)
    d = len(sums)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [[0] * (d - j) for j in range(d)]
        rows = max(1, CELLS // max(1, d))
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch["x"].to_numpy()).astype(np.int64)
            for at in range(0, len(x), rows):
                u = n * x[at : at + rows] - shift
                for j in range(d):
                    s = u[:, j : j + 1] + u[:, j:]
                    s[:, 0] = u[:, j]
                    hi, lo = s >> PIECE, s & ((1 << PIECE) - 1)
                    a, b, c = (hi * hi).sum(axis=0), (hi * lo).sum(axis=0), (lo * lo).sum(axis=0)
                    row = total[j]
                    for k in range(d - j):
                        row[k] += (int(a[k]) << (2 * PIECE)) + (int(b[k]) << (PIECE + 1)) + int(c[k])
        out = [(j, j + k, str(v)) for j in range(d) for k, v in enumerate(total[j])]
        yield pd.DataFrame(out, columns=["j", "k", "v"])

    return run


def fit(x: DataFrame) -> dict:
    """``n``, sums ``S``, the exact covariance (as floats) and its eigenpairs, largest first."""
    first = x.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum("v").alias("s")).collect()
    n = x.count()
    sums = [int(r["s"]) for r in sorted(first, key=lambda r: r["d"])]
    d = len(sums)
    if n == 0 or d == 0:
        return {"n": n, "sums": sums, "values": np.zeros(0), "vectors": np.zeros((d, 0)), "trace": 0.0}
    squares = x.mapInPandas(_pair_squares(n, sums), "j int, k int, v string")
    summed = squares.groupBy("j", "k").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v")).collect()
    p = {(r["j"], r["k"]): int(r["v"]) for r in summed}
    cube = n**3
    cov = np.zeros((d, d))
    for j in range(d):
        cov[j, j] = p[(j, j)] / cube
        for k in range(j + 1, d):
            cov[j, k] = cov[k, j] = ((p[(j, k)] - p[(j, j)] - p[(k, k)]) // 2) / cube
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(d)])
    vectors = vectors * np.where(signs == 0, 1, signs)
    trace = sum(p[(j, j)] for j in range(d)) / cube
    return {"n": n, "sums": sums, "values": values, "vectors": vectors, "trace": trace}


def _identity_error(w: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened values (divisor n) minus the identity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        outer, total, rows = np.zeros((k, k)), np.zeros(k), 0
        for batch in batches:
            if not batch.empty:
                m = np.stack(batch["w"].to_numpy())
                outer += m.T @ m
                total += m.sum(axis=0)
                rows += len(m)
        yield pd.DataFrame({"rows": [rows], "outer": [outer.ravel().tolist()], "total": [total.tolist()]})

    parts = w.select("w").mapInPandas(run, "rows long, outer array<double>, total array<double>").collect()
    rows = sum(r["rows"] for r in parts)
    outer = sum(np.asarray(r["outer"]).reshape(k, k) for r in parts)
    mean = sum(np.asarray(r["total"]) for r in parts) / rows
    return float(np.max(np.abs(outer / rows - np.outer(mean, mean) - np.eye(k))))


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each whole row and each leading component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    ``x = floor(64 * c) + 1000000`` per entry; the fit list is all whole rows (see ``integer_rows``).
    Components are unit eigenvectors of the covariance of ``x`` (divisor ``n``, centred first), by
    falling eigenvalue ``e``, at most ``components``, and only those with ``e`` above ``1e-12`` of the
    largest (a flat direction cannot be whitened). Each is signed so that its largest entry is positive.
    ``deviation`` is the exact ``sum_d (n x_d - S_d)^2``; ``whitened`` the centred row projected on
    the component, over ``sqrt(e)``; ``explained`` is ``e`` over the trace; ``identity_error`` one
    number for the whole result. No whole row, one row, or equal rows: an empty result. Rows given
    twice count twice. Other columns are ignored.
    """
    x = stage(integer_rows(rows, id_col, vec_col))
    fitted = fit(x)
    values, vectors, n = fitted["values"], fitted["vectors"], fitted["n"]
    kept = [i for i in range(min(components, len(values))) if values[i] > 1e-12 * max(values[0], 0) and values[i] > 0]
    spark = rows.sparkSession
    if not kept:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    sums = F.array(*[F.lit(s).cast("long") for s in fitted["sums"]])
    u = F.transform("x", lambda v, i: F.lit(n) * v - F.element_at(sums, i + 1))
    dev = F.aggregate(F.transform("u", lambda v: v.cast("decimal(38,0)") * v.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"), lambda a, b: a + b)

    def projection(i: int) -> F.Column:
        axis = F.array(*[F.lit(float(v)) for v in vectors[:, i] / np.sqrt(values[i])])
        products = F.zip_with("u", axis, lambda a, b: (a.cast("double") / F.lit(float(n))) * b)
        return F.aggregate(products, F.lit(0.0), lambda a, b: a + b)

    w = stage(
        x.select("vec_id", u.alias("u"))
        .select("vec_id", dev.cast("long").alias("deviation"), F.array(*[projection(i) for i in kept]).alias("w"))
    )
    error = _identity_error(w, len(kept))
    explained = F.array(*[F.lit(float(values[i] / fitted["trace"])) for i in kept])
    return w.select(
        "vec_id",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.posexplode("w").alias("at", "whitened"),
    ).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
