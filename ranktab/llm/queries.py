"""Registered queries of the subpackage, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktab.llm import decontamination, exact, lines, packing, periodic, quality, secrets, simhash, suffixes, token_counts, toxicity, vectors, whitening
from ranktab.llm.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every token piece of ``documents`` in sequences of at most 4096 tokens."""
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret candidates of ``documents`` with the forest's score."""
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    value = F.sha2("value", 256).alias("value_sha256")
    return found.select("doc_id", "start", "part", F.char_length("value").alias("length"), value, "kind", "score", "secret")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in ten-word windows of benchmark items."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text of ``documents``."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest rows of ``embeddings`` by inner product for every hundredth id."""
    rows = table(spark, sf_dir, "embeddings")
    return vectors.top_k(rows, rows.where(F.col("vec_id") % 100 == 0), k=10, scale=1024)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, those that repeat others within two edits, and what is left."""
    left = lines.dedup_lines(table(spark, sf_dir, "documents"), threshold=2)
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return left.select("doc_id", "n_lines", "n_removed", "n_links", kept)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text of ``documents``."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that repeat an earlier string of 100 bytes, and what is left."""
    left = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and exact tokens of every text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    counts = token_counts.prefix_token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every row of ``documents``; the row with the largest id stays."""
    return exact.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def planted_words(words: Column) -> Column:
    """Words of a ``documents`` row after the stated repetition: a tenth of the texts (by crc32 of the id) repeat a stretch.

    ``words`` must be a column, not an expression: the lambda reads it once per word.
    """
    n = F.size(words)
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    repeated = F.transform(words, lambda w, i: F.when(i >= a, F.element_at(words, (a + (i - a) % p + 1).cast("int"))).otherwise(w))
    return F.when((h % 10 == 0) & (n > 0), repeated).otherwise(words)


def _before(x: Column, y: Column) -> Column:
    """Order of runs: greater length / period first (exact, by cross products), then start, then period."""
    lx, ly = x["length"] * y["period"], y["length"] * x["period"]
    return (
        F.when(lx > ly, -1).when(lx < ly, 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1)
        .when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every text of ``documents`` after the stated repetition, and what collapsing them leaves."""
    docs = table(spark, sf_dir, "documents")
    listed = docs.select("doc_id", periodic.word_lists(docs).alias("words"))
    found = periodic.periodic_runs(listed.select("doc_id", planted_words(F.col("words")).alias("words")))
    best = F.try_element_at(F.array_sort("runs", _before), F.lit(1))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit(""))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every whole vector of ``embeddings`` on its 32 leading components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_secret_scans,
        op3_simhash_near_dedup,
        op4_benchmark_decontamination,
        op5_quality_classifier,
        op6_exact_top_k,
        op7_line_dedup,
        op8_toxicity,
        op9_suffix_array_dedup,
        op10_token_counts,
        op11_exact_dedup,
        op12_periodic_runs,
        op13_embedding_whitening,
    )
}
SQL: dict[str, str] = {
    "op11_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, coalesce(d.doc_id = g.keep_id, false) AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
    "op6_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
}
