"""Secrets in texts: candidates by patterns, false positives removed by a random forest.

Everything runs as DataFrame expressions and Spark ML. The forest learns from labelled findings: those
given, or those of the scanned texts that a strict rule labels (a known key format or an assignment to a
secret's name on one side; card numbers, dates, plain words and placeholders on the other).
Findings that no rule labels get their answer from the forest alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranktab.sources.staging import stage

LEAST_CHARS = 12
FIT_FINDINGS = 20_000  # labelled findings that the forest is fitted on, about
HASH_PARTS = 1 << 40  # a share of very many findings is still a number of parts
DICTIONARY = 200  # frequent words that count for dictionary coverage
RUN = f"[A-Za-z0-9+/_\\-]{{{LEAST_CHARS},}}={{0,2}}"
NAMED = r"(?i)(passw|pwd|secret|token|api_?key|apikey|access_?key|auth|credential|private_?key)"
# Formats of well-known keys, and words that mark a placeholder.
FORMATS = {
    "cloud_access_key": r"^(AKIA|ASIA)[A-Z0-9]{16}$",
    "code_host_token": r"^gh[pousr]_[A-Za-z0-9]{36,}$",
    "chat_token": r"^xox[abprs]-[A-Za-z0-9\-]{10,}$",
    "payment_key": r"^[sr]k_(live|test)_[A-Za-z0-9]{16,}$",
    "web_token": r"^eyJ[A-Za-z0-9_\-]{10,}$",
}
BEGINNING = r"(AKIA|ASIA|gh[pousr]_|xox[abprs]-|[sr]k_(live|test)_|eyJ)"
PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|changeme|your[_\-]?|xxxx|0000000|1234567|abcdef)"
HARMLESS = r"(?i)(commit|sha1?|md5|hash|checksum|digest|revision|uuid|isbn|order|invoice|phone|card)"
TEST_PATH = r"(?i)(test|spec|example|sample|mock|fixture|doc)"
FEATURES = (
    "length", "digit_share", "upper_share", "sign_share", "hex", "digits_only", "class_changes", "vowel_changes", "entropy",
    "distinct_share", "coverage", "placeholder", "known_format", "named_before", "assigned", "quoted", "harmless_near", "words_near", "test_path", "path_depth",
)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Every run of key-like characters with a digit, with the beginning of a known format, or beside a secret's name.

    One row per finding: ``doc_id``, ``word`` (its number among the text's pieces between single white-space
    characters), ``start`` (character offset of that piece), ``part`` (number in the piece), ``value``,
    the piece before the value (``lead``), the two pieces before and the one after, and ``path``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), text.alias("text"))
    # A cheap look at the whole text first: most have neither a digit in a long run nor a name.
    likely = F.col("text").rlike(r"[0-9][A-Za-z0-9+/_\-]{5}|[A-Za-z0-9+/_\-]{5}[0-9]") | F.col("text").rlike(NAMED) | F.col("text").rlike(BEGINNING)
    # The pieces are split once, below the generator; neighbours are looked up for the few hits alone.
    rows = rows.where(likely).withColumn("words", F.split("text", r"\s")).drop("text")
    rows = rows.select("doc_id", "path", "words", F.posexplode("words").alias("word", "piece"))
    rows = rows.where((F.char_length("piece") >= LEAST_CHARS) & F.col("piece").rlike(RUN))
    near = lambda by: F.coalesce(F.get(F.col("words"), F.col("word") + by), F.lit(""))
    start = F.aggregate(F.slice("words", F.lit(1), F.col("word")), F.lit(0).cast("long"), lambda n, w: n + F.char_length(w) + 1)
    parts = F.posexplode(F.regexp_extract_all("piece", F.lit(f"({RUN})"), 1)).alias("part", "value")
    rows = rows.select("doc_id", "path", "word", start.alias("start"), "piece", near(-1).alias("before"), near(-2).alias("before2"), near(1).alias("after"), parts)
    rows = rows.withColumn("lead", F.expr("substring_index(piece, value, 1)"))
    return rows.where(F.col("value").rlike(f"[0-9]|^{BEGINNING}") | F.concat_ws(" ", "before2", "before", "lead").rlike(NAMED))


def frequent_words(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY) -> list[str]:
    """The ``words`` most frequent words of 4 to 10 ASCII letters, over all texts."""
    every = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(r"\b([a-z]{4,10})\b"), 1)).alias("w"))
    return [r["w"] for r in every.groupBy("w").count().orderBy(F.col("count").desc(), "w").limit(words).collect()]


def _share(value: Column, wanted: str) -> Column:
    return F.char_length(F.regexp_replace(value, f"[^{wanted}]", "")) / F.char_length(value)


def with_features(found: DataFrame, dictionary: list[str]) -> DataFrame:
    """``FEATURES`` of each finding as doubles."""
    v, n = F.col("value"), F.char_length("value")
    runs = lambda x: F.char_length(F.regexp_replace(x, r"(.)\1*", "$1"))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0")
    sounds = F.regexp_replace(F.regexp_replace(F.lower(v), "[aeiou]", "1"), "[a-z]", "2")
    chars = F.filter(F.split(v, ""), lambda c: c != "")
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - _part(v, n, c) * F.log2(_part(v, n, c)))
    alternatives = "|".join(sorted(dictionary, key=lambda w: (-len(w), w)))
    covered = n - F.char_length(F.regexp_replace(F.lower(v), alternatives, "")) if alternatives else F.lit(0)
    known = F.lit(False)
    for form in FORMATS.values():
        known = known | v.rlike(form)
    around = F.concat_ws(" ", "before2", "before", "lead")
    values = {
        "length": n,
        "digit_share": _share(v, "0-9"),
        "upper_share": _share(v, "A-Z"),
        "sign_share": _share(v, "+/_=\\-"),
        "hex": v.rlike("^[0-9a-fA-F]+$"),
        "digits_only": v.rlike("^[0-9\\-]+$"),
        "class_changes": (runs(classes) - 1) / n,
        "vowel_changes": (runs(sounds) - 1) / n,
        "entropy": entropy,
        "distinct_share": F.size(F.array_distinct(chars)) / n,
        "coverage": covered / n,
        "placeholder": v.rlike(PLACEHOLDER),
        "known_format": known,
        "named_before": around.rlike(NAMED),
        "assigned": F.concat("before", "lead").rlike("[=:]$|[=:][\"']$"),
        "quoted": F.col("lead").rlike("[\"']$"),
        "harmless_near": F.concat_ws(" ", around, "after").rlike(HARMLESS),
        "words_near": F.col("before").rlike("^[^0-9]*$").cast("int") + F.col("after").rlike("^[^0-9]*$").cast("int"),
        "test_path": F.col("path").rlike(TEST_PATH),
        "path_depth": F.size(F.split("path", "/")) - 1,
    }
    return found.select("*", *[values[f].cast("double").alias(f"f_{f}") for f in FEATURES])


def _part(v: Column, n: Column, c: Column) -> Column:
    return (n - F.char_length(F.replace(v, c, F.lit("")))) / n


def rule_labels(found: DataFrame) -> DataFrame:
    """``label`` of findings that a strict rule decides: 1 secret, 0 not, null undecided."""
    secret = (F.col("f_known_format") == 1) & (F.col("f_placeholder") == 0)
    secret = secret | ((F.col("f_named_before") == 1) & (F.col("f_assigned") == 1) & (F.col("f_entropy") >= 2.5) & (F.col("f_coverage") < 0.5) & (F.col("f_placeholder") == 0))
    harmless = (F.col("f_digits_only") == 1) | (F.col("f_placeholder") == 1) | (F.col("f_coverage") >= 0.8)
    wordlike = (F.col("f_digit_share") < 0.15) & (F.col("f_upper_share") == 0) & (F.col("f_hex") == 0) & (F.col("f_named_before") == 0)
    harmless = harmless | wordlike
    harmless = harmless | ((F.col("f_harmless_near") == 1) & (F.col("f_named_before") == 0)) | ((F.col("f_digit_share") == 0) & (F.col("f_named_before") == 0))
    return found.withColumn("label", F.when(secret, 1.0).when(harmless, 0.0))


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="features").transform(rows)


def class_sample(known: DataFrame, counts: dict[float, int], rows: int) -> DataFrame:
    """About ``rows`` of the ``known`` findings of two classes: a smaller class whole, up to half of the rows, else a share by hash."""
    bound = {k: max(rows // 2, rows - sum(n for o, n in counts.items() if o != k)) for k, n in counts.items()}
    place = F.pmod(F.xxhash64("doc_id", "word", "part", "value"), F.lit(HASH_PARTS))
    wanted = F.lit(False)
    for k, n in counts.items():
        wanted = wanted | ((F.col("label") == k) & (place < max(1, int(HASH_PARTS * min(1.0, bound[k] / n)))))
    return known.where(wanted)


def fit_forest(labelled: DataFrame, rows: int = FIT_FINDINGS, trees: int = 40, depth: int = 7) -> RandomForestClassificationModel | float:
    """A forest on about ``rows`` labelled findings (features and ``label``), taken by a hash of the finding.

    Each class has half of the rows, and what the other leaves of its half; a class that fits is
    taken whole. Classes weigh alike. Without findings of both classes: the share of secrets, or 0.5 without any.
    """
    known = labelled.where(F.col("label").isNotNull())
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return counts.get(1.0, 0) / total if total else 0.5
    some = stage(class_sample(known, counts, rows))
    taken = {r["label"]: r["count"] for r in some.groupBy("label").count().collect()}
    if len(taken) < 2:  # a class whose many rows share a few hashes: any of them
        left = [known.where(F.col("label") == k).limit(rows // 2) for k in counts if k not in taken]
        some = stage(reduce(DataFrame.unionByName, left, some))
        taken = {r["label"]: r["count"] for r in some.groupBy("label").count().collect()}
    used = sum(taken.values())
    weight = F.when(F.col("label") == 1, used / (2 * taken[1.0])).otherwise(used / (2 * taken[0.0]))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=7)
    return forest.fit(_assembled(some.withColumn("weight", weight)))


def secrets(docs: DataFrame, findings: DataFrame | None = None, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Candidates of all texts with the forest's answer.

    ``findings`` (optional) are labelled candidates, with the columns of ``candidates`` and a
    ``label``; without them the scanned texts' rule-labelled candidates train the forest. Returns one row per
    candidate: ``doc_id``, ``start`` (character offset of its piece), ``word``, ``part``, ``value``, ``kind``
    (a known format's name, or null), ``score`` and ``secret`` (score of at least ``least``). Null and
    empty texts have no candidates; a null id or path stays null or counts as empty; repeated rows give
    repeated findings; other columns are not read.
    """
    dictionary = frequent_words(docs, text_col)
    found = stage(rule_labels(with_features(candidates(docs, id_col, text_col, path_col), dictionary)))
    if findings is None:
        labelled = found
    else:
        labelled = with_features(findings.drop(*[f"f_{f}" for f in FEATURES]), dictionary)
    model = fit_forest(labelled)
    kind = F.lit(None).cast("string")
    for name, form in FORMATS.items():
        kind = F.when(F.col("value").rlike(form), name).otherwise(kind)
    if isinstance(model, float):
        scored = found.withColumn("score", F.lit(model))
    else:
        scored = model.transform(_assembled(found)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", "word", "part", "value", kind.alias("kind"), "score", (F.col("score") >= least).alias("secret"))
