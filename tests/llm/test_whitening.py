from __future__ import annotations

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from ranktab.llm.whitening import whiten

SF = "/root/testdata/sf0.01"


def brute(rows, k=32):
    """numpy in doubles with exact integer sums: n, deviations, eigenpairs, whitened values."""
    whole = [(i, v) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    lengths = {}
    for _, v in whole:
        lengths[len(v)] = lengths.get(len(v), 0) + 1
    d = max(lengths, key=lambda m: (lengths[m], m))
    whole = [(i, v) for i, v in whole if len(v) == d]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in whole], dtype=object)
    n = len(whole)
    s = x.sum(axis=0)
    u = n * x - s
    dev = [int(sum(int(a) ** 2 for a in row)) for row in u]
    cov = (u.T @ u).astype(float) / n**3
    e, v = np.linalg.eigh(cov)
    order = np.argsort(-e)
    e, v = e[order], v[:, order]
    v = v * np.sign(v[np.argmax(np.abs(v), axis=0), np.arange(d)])
    c = u.astype(float) / n
    kept = [i for i in range(min(k, d)) if e[i] > 1e-12 * e[0] and e[i] > 0]
    w = c @ v[:, kept] / np.sqrt(e[kept])
    return [i for i, _ in whole], n, dev, e[kept] / np.trace(cov), w


def check(spark, rows, k=32):
    ids, n, dev, explained, w = brute(rows, k)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whiten(df, components=k).collect()
    assert len(got) == len(ids) * len(explained)
    at = {i: p for p, i in enumerate(ids)}
    for r in got:
        p, c = at[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == dev[p]
        assert abs(r.explained - explained[c]) <= 1e-9
        assert abs(r.whitened - w[p, c]) <= 1e-6 * max(1.0, abs(w[p, c]))
        assert r.identity_error <= 1e-4
    return got


def test_given_embeddings_equal_brute_force(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    rows = list(zip(t.column("vec_id").to_pylist(), t.column("embedding").to_pylist()))
    got = check(spark, rows)
    assert {r.component for r in got} == set(range(1, 33))


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a) for a in rng.normal(size=6)]) for i in range(40)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [float("nan")] * 6), (103, [float("inf")] + [0.0] * 5)]
    rows += [(104, [0.5, 0.5]), (None, [0.1] * 6), (5, rows[5][1]), (5, rows[5][1])]  # other length, no id, a row given twice
    got = check(spark, rows, k=4)
    assert {r.vec_id for r in got} == set(range(40))
    assert sum(1 for r in got if r.vec_id == 5) == 3 * 4


def test_degenerate(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    same = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema))
    assert same.count() == 0
    line = whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0])], schema)).collect()
    assert len(line) == 3 and {r.component for r in line} == {1}
    assert line[0].explained == pytest.approx(1.0)
