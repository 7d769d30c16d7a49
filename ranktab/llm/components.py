"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktab.sources.staging import stage


def _mark(edges: DataFrame) -> tuple[int, int]:
    """How many edges there are, and a checksum of them."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of ``edges`` (``u``, ``v``, both long) reaches.

    Returns ``node`` and ``root`` for every node that has an edge to another, the roots included.
    Each round links the larger neighbours of a node to its smallest neighbour, then the smaller
    ones. Smallest neighbours are aggregated before they are joined back, so a node with very many
    edges is no large group; every round is written to the staging folder. Rounds end when the
    edges stay as they are, which is when all of them point at the root.
    """
    current = stage(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(current)
    while mark[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stage(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Every edge points from the larger node to the smaller one here.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        after = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        was, mark, current = mark, _mark(after), after
        if mark == was:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
