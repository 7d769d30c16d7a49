from __future__ import annotations

from pyspark.sql import functions as F

from ranktab.llm import lines


def test_only_rows_of_met_slots_reach_the_join(spark):
    keyed = spark.range(-20_000, 20_000).select(F.xxhash64("id").alias("key"), F.lit("some line").alias("line"))
    met = keyed.where("key % 40 = 0").select("key")
    wanted = met.count()
    left = lines.rows_of_slots(keyed, met)
    assert left.columns == keyed.columns
    assert left.join(met, "key").count() == wanted > 0
    assert left.count() <= wanted + 50


def test_more_keys_than_are_sent_give_the_same_links(spark, docs, monkeypatch):
    found = lambda: sorted(map(tuple, lines.edit_links(lines.lines_of(docs)).collect()))
    few = found()
    monkeypatch.setattr(lines, "SENT_KEYS", 0)
    assert few and found() == few
