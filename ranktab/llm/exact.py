"""Exact deduplication by content: equal texts meet, one row of each group of equals stays.

All of it is DataFrame work in the JVM (the main path runs no Python):

1. Every row gets its normalised text (here the text itself; null is the empty text), the text's
   byte length and SHA-256, and a tag that tells rows given twice apart (its place in the scan).
2. Rows are grouped by (length, digest, whole text). Spark combines equal texts inside each task
   before the shuffle, so a group of copies that holds a third of all rows sends one row per task;
   the final step compares whole texts byte for byte. Texts travel once; ids and counts beside.
3. The groups (no text) are written to the shared staging folder. A (length, digest) pair that
   stands for two different texts - a SHA-256 collision - is looked for there; such rows are then
   matched by the whole text, so the result stays exact without trusting the digest.
4. Every row learns its group's kept row by a join on (length, digest): both sides are narrow, and
   the adaptive skew join splits the hot group's side into many tasks.

Not done by sorting all texts into ranges: splitters of the content cannot split a group of equal
texts, so its group would land in one task; combining equals before the shuffle does not have that fault.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranktab.sources.staging import stage

KEYS = ["_ed_n", "_ed_key"]


def _rank(doc_id: Column, tag: Column, keep: str) -> Column:
    """What the kept row of a group maximises: rows with an id before rows without, then the id, then the tag."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is 'largest' or 'smallest', not {keep!r}")
    sign = 1 if keep == "largest" else -1
    return F.struct(
        doc_id.isNotNull().alias("has"), (doc_id * sign).alias("by_id"), (tag * sign).alias("by_tag"), doc_id.alias("id"), tag.alias("tag")
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are. Of each group of equal texts exactly one row stays: the one
    with the smallest id (``keep="largest"``: the largest); rows without id lose to rows with one, and
    between rows of one id (a row given twice) the later one in the scan stays for "largest", the
    earlier one for "smallest". ``keep_id`` is the id of the row that stays (null when that row has
    none), ``group_size`` counts all rows of the group, null and empty texts form one group (the empty
    text), ``text_sha256`` is the lowercase hex SHA-256 of the text's UTF-8 bytes. An empty table gives an
    empty result; other columns of ``docs`` are ignored, so their names cannot clash. ``docs`` should
    be a scan of stored rows: the tag of a row is its place in the scan, which a retried task gives again.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("_ed_id"),
        F.monotonically_increasing_id().alias("_ed_tag"),
        text.alias("_ed_t"),
    ).select("_ed_id", "_ed_tag", "_ed_t", F.octet_length("_ed_t").alias("_ed_n"), F.unhex(F.sha2("_ed_t", 256)).alias("_ed_key"))
    winner = F.max(_rank(F.col("_ed_id"), F.col("_ed_tag"), keep)).alias("_ed_win")
    groups = stage(rows.groupBy(*KEYS, "_ed_t").agg(winner, F.count(F.lit(1)).alias("_ed_size")).drop("_ed_t"))
    twins = groups.groupBy(*KEYS).count().where(F.col("count") > 1).select(*KEYS)
    narrow = rows.select("_ed_id", "_ed_tag", *KEYS)
    if twins.isEmpty():
        joined = narrow.join(groups, KEYS)
    else:  # a digest that two texts share: those rows are matched by the whole text
        clash = rows.join(twins, KEYS, "left_semi")
        exact = clash.groupBy(*KEYS, "_ed_t").agg(winner, F.count(F.lit(1)).alias("_ed_size"))
        plain = narrow.join(groups.join(twins, KEYS, "left_anti"), KEYS)
        joined = plain.unionByName(clash.join(exact, [*KEYS, "_ed_t"]).drop("_ed_t"))
    win = F.col("_ed_win")
    return joined.select(
        F.col("_ed_id").alias("doc_id"),
        win.getField("id").alias("keep_id"),
        F.col("_ed_size").alias("group_size"),
        (F.col("_ed_id").eqNullSafe(win.getField("id")) & (F.col("_ed_tag") == win.getField("tag"))).alias("kept"),
        F.lower(F.hex("_ed_key")).alias("text_sha256"),
    )
