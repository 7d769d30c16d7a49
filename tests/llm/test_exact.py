from __future__ import annotations

import hashlib

from ranktab.llm.exact import exact_duplicates


def brute(texts, keep):
    """Groups by whole text; the winner by (has id, id) and then by place."""
    groups: dict[str, list[int]] = {}
    for place, (_, text) in enumerate(texts):
        groups.setdefault(text or "", []).append(place)
    out = []
    for text, places in groups.items():
        sign = 1 if keep == "largest" else -1
        win = max(places, key=lambda p: (texts[p][0] is not None, sign * (texts[p][0] or 0), sign * p))
        for p in places:
            out.append((texts[p][0], texts[win][0], len(places), p == win, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups_equal_brute_force(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    for keep in ("largest", "smallest"):
        got = sorted((tuple(r) for r in exact_duplicates(docs, keep=keep).collect()), key=repr)
        assert got == brute(texts, keep)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "a"), (None, "b"), (None, "b"), (4, "A"), (5, "a ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    clashing = docs.selectExpr("doc_id", "text", "1 AS keep_id", "'x' AS kept", "2 AS _ed_n", "3 AS group_size")
    got = exact_duplicates(clashing, keep="largest").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert sorted(r.doc_id for r in empty) == [1, 2] and all(r.keep_id == 2 and r.group_size == 2 for r in empty)
    a = by[hashlib.sha256(b"a").hexdigest()]
    assert len(a) == 3 and sum(r.kept for r in a) == 1 and {r.keep_id for r in a} == {3}
    b = by[hashlib.sha256(b"b").hexdigest()]
    assert len(b) == 2 and sum(r.kept for r in b) == 1 and {r.keep_id for r in b} == {None}
    assert sum(r.kept for r in got) == 5  # "", "a", "b", "A", "a "


def test_long_and_empty(spark):
    long = "x" * 2_000_000
    docs = spark.createDataFrame([(1, long), (2, long), (3, long + "y")], "doc_id long, text string")
    got = {r.doc_id: r for r in exact_duplicates(docs).collect()}
    assert got[1].kept and not got[2].kept and got[2].keep_id == 1 and got[3].group_size == 1
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
