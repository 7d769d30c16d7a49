from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq

from ranktab.llm import periodic
from ranktab.llm.queries import op12_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words: list[str]) -> list[tuple[int, int, int]]:
    """Every maximal stretch of every period q, at least max(24, 3q) long, by its smallest period."""
    _, ids = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True) if words else (None, np.zeros(0, int))
    n, found = len(ids), {}
    for q in range(1, n // 3 + 1):
        m = np.r_[False, ids[:-q] == ids[q:], False].astype(np.int8)
        edges = np.flatnonzero(np.diff(m))
        for s, e in zip(edges[::2], edges[1::2]):
            length = e - s + q
            if length >= max(24, 3 * q):
                found[(int(s), int(length))] = min(found.get((int(s), int(length)), q), q)
    return sorted((s, l, q) for (s, l), q in found.items())


def planted(doc_id, words):
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    runs = brute_runs(words)
    drop = np.zeros(len(words) + 1, int)
    for s, l, q in runs:
        drop[s + q] += 1
        drop[s + l] -= 1
    kept = [w for w, d in zip(words, np.cumsum(drop)) if d == 0]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        *(best if best else (None, None, None)),
        (1000 * best[1]) // best[2] if best else None,
        digest("".join(f"{s},{l},{q}\n" for s, l, q in sorted(runs, key=lambda r: (r[0], r[2])))),
        digest(" ".join(kept)),
    )


def test_query_equals_brute_force(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"])
    want = sorted((expected(i, x) for i, x in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist())), key=repr)
    got = op12_periodic_runs(spark, sf).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == want
    assert sum(1 for r in want if r[1]) >= len(want) // 20  # the planted tenth shows


def test_operator_on_odd_rows(spark, texts):
    rng = random.Random(2)
    rows = [(i, WORD.findall(t) if t is not None else None) for i, t in texts]
    rows += [(900, ["x"] * 23), (901, ["x"] * 24), (902, ["a", "b", "c"] * 8 + ["a", "b"]), (903, [])]
    rows += [(904 + k, [rng.choice("abc") for _ in range(rng.randint(0, 300))]) for k in range(40)]
    rows += [(990, (["p", "q", "r", "s", "t", "u", "v", "w"] * 40) + ["z"] + ["m", "n"] * 30), (990, ["y"] * 100)]
    df = spark.createDataFrame(rows, "doc_id long, words array<string>").repartition(3)
    got = {(r.doc_id, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed, r.n_words) for r in periodic.periodic_runs(df).collect()}
    want = set()
    for i, words in rows:
        words = words or []
        runs = brute_runs(words)
        drop = set()
        for s, l, q in runs:
            drop.update(range(s + q, s + l))
        want.add((i, tuple(sorted(runs, key=lambda r: (r[0], r[2]))), " ".join(w for k, w in enumerate(words) if k not in drop), len(words)))
    assert got == want
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, words array<string>")).count() == 0
