from __future__ import annotations

import corpus_pipeline
from ranktab.llm import decontamination, quality, simhash
from ranktab.sources.staging import stage


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for _, function in corpus_pipeline.STAGES:
        seen.append(stage(function(spark, seen[-1], sf)))
    for before, after in zip(seen[:-2], seen[1:-1]):
        assert after.columns == docs.columns
        assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    accepted = quality.quality_scores(docs, quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))).where("score >= 0.5")
    assert seen[1].count() == accepted.count()
    assert seen[2].count() == seen[1].count()
    found = simhash.near_duplicates(seen[3])
    assert found.where("doc_id <> component_id").count() == 0
    assert seen[3].count() == simhash.near_duplicates(seen[2]).select("component_id").distinct().count()
    assert decontamination.contamination(seen[4], spark.read.parquet(f"{sf}/benchmark.parquet")).where("n_hit > 0").count() == 0
    assert seen[5].select("doc_id").distinct().count() == seen[4].count()


def test_run_gives_every_piece_a_place(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() == rows.select("sequence_id", "offset").distinct().count() > 0
