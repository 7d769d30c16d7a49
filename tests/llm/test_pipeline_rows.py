"""Pipeline stages decide per row: null and shared ids neither lose clean rows nor keep copies."""

from __future__ import annotations

from ranktab.llm.decontamination import uncontaminated
from ranktab.llm.simhash import first_of_each_group

A = "the river runs under the old stone bridge every spring and the lamps are lit at night for all"
B = "paper engines hum in the violet harbour while glass moons drift north over quiet water again"
C = "nothing here resembles anything else written in this small table of rows at all today friend"
ROWS = [(1, A), (None, A), (None, B), (None, B), (2, C), (2, A)]


def test_near_copies_per_row(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)
    got = sorted(((r.doc_id, r.text) for r in first_of_each_group(docs).collect()), key=repr)
    assert got == sorted([(1, A), (None, B), (2, C)], key=repr)


def test_clean_rows_without_id_stay(spark):
    bench = spark.createDataFrame([("q1", A)], "item_id string, text string")
    docs = spark.createDataFrame(ROWS + [(None, C)], "doc_id long, text string").coalesce(1)
    got = sorted(((r.doc_id, r.text) for r in uncontaminated(docs, bench).collect()), key=repr)
    assert got == sorted([(None, B), (None, B), (2, C), (None, C)], key=repr)
