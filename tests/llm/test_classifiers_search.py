from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ranktab.llm import labelled, quality, secrets, toxicity, vectors

SF = "/root/testdata/sf0.01"


def read(spark, name: str):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_quality_on_held_out_rows(spark):
    scores = quality.quality(read(spark, "documents"), read(spark, "labels"))
    rows = scores.join(read(spark, "labels"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)


def test_toxicity_on_held_out_rows(spark):
    scores = toxicity.toxicity(read(spark, "documents"), read(spark, "labels"))
    rows = scores.join(read(spark, "labels"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.93 * len(rows)
    assert all(r["toxic"] for r in rows if r["predicted"])


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    turned = labels.withColumn("quality", F.when(labelled.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.fit_quality(docs, x) for x in (labels, turned))
    x = quality.statistics(pa.array(["some plain text.", "A!! B!! C!!", ""], pa.large_string()))
    assert np.allclose(one.score(x), two.score(x), atol=1e-9)


def test_scores_of_odd_rows(spark, docs, texts, no_docs):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0), "q") for i, _ in texts if i is not None and i % 2], "doc_id long, quality int, toxic int, score string")
    for scored, scores in ((quality.quality, "quality"), (toxicity.toxicity, "toxic")):
        found = scored(docs, labels).collect()
        assert len(found) == len(texts) and all(0 <= r["score"] <= 1 for r in found)
        assert scored(no_docs, labels).count() == 0
        assert len({r["score"] for r in scored(docs, labels.where("doc_id < 0")).collect()}) == 1
        one_class = labels.withColumn(scores, F.lit(1))
        assert {r["score"] for r in scored(docs, one_class).collect()} == {1.0}
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns


def test_correlated_voters_weigh_less():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 4000)
    speak = lambda: rng.random(4000) < np.where(y == 1, 0.6, 0.1)
    one, other = speak(), speak()
    model = toxicity.fit_label_model(np.stack([one, one, one, other], axis=1), y, trust=0.9)
    assert model.weight[0] < model.weight[3]
    assert ((model.posterior(np.stack([one, one, one, other], axis=1)) > 0.5) == (y == 1)).mean() > 0.7


def test_top_k_against_all_pairs(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2001, []), (2100, [1.0, None] + [0.0] * 14), (2200, [math.nan] * 16), (2300, [math.inf] * 16), (2400, [1.0, 2.0]), (2500, [3.0, 4.0]), (None, rows[1][1])]
    rows += [rows[5]]  # a row given twice
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vectors.top_k(df, df.where("vec_id % 100 = 0"), k=10, block=3).collect()}
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    expected = {}
    for q in (i for i in whole if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        expected.update({(q, n): (i, -s) for n, (s, i) in enumerate(scores[:10], 1)})
    assert got == expected
    assert vectors.top_k(df.limit(0), df.limit(0)).count() == 0


def test_segment_statistics_bound_the_product():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(20, 30)), rng.normal(size=(25, 30))
    bounds = [vectors.segment_statistics(a, s) @ vectors.segment_statistics(b, s).T for s in (1, 4, 16, 30)]
    assert all((x >= a @ b.T - 1e-9).all() for x in bounds)
    assert np.allclose(bounds[-1], np.abs(a[:, None] * b).sum(axis=2) * 0 + a @ b.T)


def planted(n: int) -> list[tuple]:
    rng, rows = random.Random(8), []
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    for i in range(n):
        keep = [f"password={hexes(18)}", f'token = "{hexes(40)}"', "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOP234567") for _ in range(16))]
        drop = [str(rng.randint(4 * 10**15, 5 * 10**15)), "commit " + hexes(40), "token=example-0000000", "thisisaverylongword2 harmless"]
        rows.append((i, f"some words before {rng.choice(drop)} and {rng.choice(keep)} then\n{rng.choice(drop)} done", f"src/app{i % 7}.py"))
    return rows


def test_secrets_planted_among_look_alikes(spark):
    rows = planted(150)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secrets.secrets(df).collect()
    texts = {i: t for i, t, _ in rows}
    assert all(r["value"] in texts[r["doc_id"]][r["start"] :][:80] for r in found)
    truth = {(i, m[0]) for i, t, _ in rows for m in re.finditer(r"(?<=password=)[0-9a-f]{18}|(?<=token = \")[0-9a-f]{40}|AKIA\w{16}", t)}
    got = {(r["doc_id"], r["value"]) for r in found if r["secret"]}
    assert truth <= {(r["doc_id"], r["value"]) for r in found}
    assert len(truth & got) >= 0.98 * len(truth) and len(got - truth) <= 0.02 * len(found)


def test_candidates_are_every_run(spark):
    rows = [(1, "a=bcd1efghijklmn2,zyxwvutsrqpo9876 tail"), (2, None), (3, ""), (None, "secret abcdefghijklmnop"), (4, "plainlongwordwithoutdigits"), (5, "x" * 11 + "1")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, value int")
    got = defaultdict(list)
    for r in secrets.candidates(df).orderBy("doc_id", "word", "part").collect():
        got[r["doc_id"]].append(r["value"])
    assert got == {1: ["bcd1efghijklmn2", "zyxwvutsrqpo9876"], None: ["abcdefghijklmnop"], 5: ["x" * 11 + "1"]}
    assert secrets.secrets(df.limit(0)).count() == 0


def test_secrets_of_odd_rows(docs):
    assert {r["secret"] for r in secrets.secrets(docs).collect()} <= {True, False}
