"""Labelled rows for the text classifiers: a bounded sample, and the rows that are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 20_000  # labelled rows that a classifier is fitted on, about; each class has half, the rarer one all it has up to that
HASH_PARTS = 1 << 53  # a share of very many labels is still a number of parts


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learnt: crc32 of its id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text`` and ``label`` (0 or 1) of about ``rows`` labelled documents that are not held out.

    Each class is sampled up to its own bound, by a 53-bit hash of the id: half of ``rows`` each,
    and a class with fewer labels is taken whole while the other one gets what it leaves. So a
    rare class never vanishes, at any table size. Labels other than 0 and 1, null labels and null
    ids take no part; a label row given twice counts once, so the ids sent to every task stay
    bounded by about ``rows``. Equal texts with equal labels count once. Null texts are empty texts.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label"))
    marked = marked.where(F.col("label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))).dropDuplicates()
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    half = rows // 2
    bound = {k: min(n, half) for k, n in counts.items()}
    for k in counts:  # what the rarer class leaves goes to the other one
        bound[k] = min(counts[k], rows - sum(v for c, v in bound.items() if c != k))
    place = F.pmod(F.xxhash64("_id"), F.lit(HASH_PARTS))
    wanted = F.lit(False)
    for k, n in counts.items():
        wanted = wanted | ((F.col("label") == k) & (place < F.lit(max(1, int(HASH_PARTS * min(1.0, bound[k] / n))))))
    marked = marked.where(wanted)
    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(marked), F.col("_doc") == F.col("_id"))
    # Equal texts meet by a digest; long texts are not sorted.
    return joined.groupBy(F.sha2("text", 256).alias("_digest"), "label").agg(F.first("text").alias("text")).select("text", "label")
