"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into 1, 2, 4, ... segments; of each segment the mean and the deviation are kept. For two
vectors they bound the distance from below (so the inner product from above), coarse to fine. A
candidate whose bound stays below the k-th best score so far is dropped; survivors are computed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranktab.sources.staging import stage

SCALE = 1024
QUERY_BLOCK = 2_048  # queries that are sent to every task at a time
PORTION = 2_048  # candidates that are bounded at a time
LEVELS = (1, 4, 16)


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment of each row, times the root of the segment's length.

    The product of two rows' statistics is an upper bound of the product of the rows: within a segment
    the means multiply exactly, and the deviations bound the rest (Cauchy and Schwarz).
    """
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    sizes = np.diff(cuts)
    sums = np.add.reduceat(x, cuts[:-1], axis=1)
    squares = np.add.reduceat(x * x, cuts[:-1], axis=1)
    means = sums / sizes
    spread = np.sqrt(np.maximum(squares / sizes - means * means, 0))
    return np.concatenate([means * np.sqrt(sizes), spread * np.sqrt(sizes)], axis=1)


def _rows(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer vectors of a batch, one pair per length of vector."""
    lists = batch.column(1)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    ids, sizes = batch.column(0).to_numpy(), np.diff(bounds)
    out = []
    for n in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == n)
        if n:
            out.append((ids[which], values[bounds[which][:, None] + np.arange(n)]))
    return out


class Best:
    """The k best scores of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n)]
        self.least = np.full(n, -np.inf)

    def offer(self, query: int, score: int, vec_id: int) -> None:
        heap, item = self.heaps[query], (score, -vec_id)
        if len(heap) < self.k:
            heapq.heappush(heap, item)
        elif item > heap[0]:
            heapq.heapreplace(heap, item)
        if len(heap) == self.k:
            self.least[query] = heap[0][0]


def _search_block(queries: Broadcast, k: int):
    """The function that finds each query's k best among a task's candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {}
        for q_ids, q in queries.value:
            levels = [segment_statistics(q.astype(float), s) for s in LEVELS if s < q.shape[1]]
            blocks[q.shape[1]] = (q_ids, q, levels, Best(len(q_ids), k))
        for batch in batches:
            for ids, x in _rows(batch):
                if x.shape[1] not in blocks:
                    continue
                q_ids, q, q_levels, best = blocks[x.shape[1]]
                exact = max(1.0, float(np.abs(q).max()) * float(np.abs(x).max())) * x.shape[1] < 2.0**52
                levels = [segment_statistics(x.astype(float), s) for s in LEVELS if s < x.shape[1]]
                for start in range(0, len(ids), PORTION):
                    part = slice(start, start + PORTION)
                    alive = np.ones((len(q_ids), len(ids[part])), bool)
                    for q_level, level in zip(q_levels, levels):
                        busy = np.flatnonzero(alive.any(axis=1))
                        if not len(busy):
                            break
                        bound = q_level[busy] @ level[part].T
                        slack = 1e-9 * np.outer(np.abs(q_level[busy]).sum(axis=1), np.abs(level[part]).max(axis=1)) + 1e-6
                        alive[busy] &= bound + slack >= best.least[busy][:, None]
                    rows = np.flatnonzero(alive.any(axis=1))
                    columns = np.flatnonzero(alive.any(axis=0))
                    if not len(rows):
                        continue
                    if exact:  # whole numbers below 2^52 are exact as doubles
                        score = (q[rows].astype(float) @ x[part][columns].astype(float).T).astype(np.int64)
                    else:
                        score = q[rows] @ x[part][columns].T
                    own = ids[part][columns]
                    wanted = alive[np.ix_(rows, columns)] & (q_ids[rows][:, None] != own) & (score >= best.least[rows][:, None])
                    for i in np.flatnonzero(wanted.any(axis=1)).tolist():
                        at = np.flatnonzero(wanted[i])
                        if len(at) > k:  # only the k best of a portion can matter
                            at = at[np.lexsort((own[at], -score[i, at]))[:k]]
                        for j in at.tolist():
                            best.offer(int(rows[i]), int(score[i, j]), int(own[j]))
        for q_ids, _, _, best in blocks.values():
            found = [(int(i), -v, s) for i, heap in zip(q_ids, best.heaps) for s, v in heap]
            columns = list(zip(*found)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, query_rows: DataFrame, k: int = 10, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest inner product with each row of ``query_rows``.

    Components become ``floor(scale * x)``; scores are whole numbers, ties go to the smaller id, a
    row's own id is no candidate. Returns ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``; fewer rows where there
    are fewer candidates. Rows with a null id, a null, empty or partly null vector, or a component that is
    not finite take no part, as query or as candidate; vectors of different lengths don't meet.
    A row given twice counts once. Queries go out in blocks of about ``block``, each against all rows. Scores beyond
    64 bits are not supported. Other columns are not read.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        whole = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & whole)
        return rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v")).distinct()

    candidates = stage(clean(vectors))
    wanted = stage(clean(query_rows).withColumn("b", F.xxhash64("id")))
    blocks = max(1, -(-wanted.count() // block))
    parts = []
    for b in range(blocks):
        rows = wanted.where(F.pmod("b", F.lit(blocks)) == b).select("id", "v").collect()
        by_size: dict[int, list] = {}
        for r in rows:
            by_size.setdefault(len(r["v"]), []).append(r)
        sent = [(np.array([r["id"] for r in g], np.int64), np.array([r["v"] for r in g], np.int64)) for g in by_size.values()]
        run = _search_block(spark.sparkContext.broadcast(sent), k)
        parts.append(candidates.mapInArrow(run, "query_id long, vec_id long, score long"))
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
