"""Corpus preparation: five stages, each over all rows that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktab.llm import decontamination, lines, packing, quality, simhash
from ranktab.llm.shipping import ship
from ranktab.sources.staging import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labels of ``docs``."""
    return quality.good_documents(docs, _table(spark, sf_dir, "labels"))


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat or nearly repeat earlier ones; ``n_chars`` follows the text."""
    ship(spark)
    left = lines.dedup_lines(docs, threshold=2)
    counted = {"n_chars": F.char_length("text").cast("long")} if "n_chars" in docs.columns else {}
    return left.withColumns(counted).select(*docs.columns)


def first_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints connect: the one with the smallest id."""
    ship(spark)
    return simhash.first_of_each_group(docs, shingle=4, radius=4)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return decontamination.uncontaminated(docs, _table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of at most 4096 tokens."""
    ship(spark)
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", first_lines),
    ("simhash_near_dedup", first_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed_sequences),
]
ORACLE_SQL = None  # fingerprints, token ids and a fitted classifier are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
