from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from ranktab.llm import lines, queries

TEXTS = [
    (1, "And ornd.\nfifteen letters\nab\n \n\nxyz"),
    (2, "And ornd.\nfifteen letters!\nab\n \n\ncd"),
    (3, "And ornt.\nAnd ornd.\nAnd ornd.\nxy\nown words here"),
]
LEFT = {1: "And ornd.\nfifteen letters\nab\n \n\nxyz", 2: " \n\ncd", 3: "xy\nown words here"}


def test_short_lines_are_compared(spark, tmp_path):
    df = spark.createDataFrame([(*r, len(r[1])) for r in TEXTS], "doc_id long, text string, n_chars long")
    # "xy" is one edit from "xyz", but has too few characters for links.
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()} == LEFT
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.first_lines(spark, df, "").collect()} == LEFT
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op7_line_dedup(spark, str(tmp_path)).join(df, "doc_id")
    removed = {r["doc_id"]: r["n_removed"] for r in found.where(F.col("n_lines") > 0).collect()}
    assert removed == {1: 0, 2: 3, 3: 3}
