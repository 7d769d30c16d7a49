from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ranktab.llm import labelled, toxicity


def fitted(spark, toxic: list[str], clean: list[str]):
    ids = [r["id"] for r in spark.range(2 * (len(toxic) + len(clean)) + 100).where(~labelled.held_out(F.col("id"))).collect()]
    rows = [(i, t, int(n < len(toxic))) for n, (i, t) in enumerate(zip(ids, toxic + clean))]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.fit_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"))


def word(n: int) -> str:
    return "".join(chr(97 + n // 26**i % 26) for i in range(3))


def test_copies_do_not_hide_stems(spark):
    copied = " ".join(word(7 * i) for i in range(60))
    toxic = [f"{copied} {word(9000 + n)}" for n in range(300)]
    toxic += [" ".join([*(word(37 * n + i) for i in range(8)), "zorgel" if n % 2 else "plain"]) for n in range(12)]
    clean = [" ".join(word(53 * n + i) for i in range(8)) for n in range(150)]
    assert any(s.startswith("zorg") for s in fitted(spark, toxic, clean).voters.stems)


def test_short_texts_are_told_apart(spark):
    toxic = [f"zorgel {word(n)}" for n in range(12)]
    clean = [" ".join(word(53 * n + i) for i in range(8)) for n in range(150)]
    assert any(s.startswith("zorg") for s in fitted(spark, toxic, clean).voters.stems)


def test_sketches_of_short_texts():
    texts = pa.array(["a b", "", "b a", "A b", "a", "a b c d e", "a b c", "a", "!"], pa.large_string())
    distinct, code, doc, n = toxicity._distinct_words(texts)
    got = toxicity._sketches(distinct, code, doc, len(n))
    assert got[0] == got[3] and got[4] == got[7] and got[1] == got[8] == 0
    assert len(np.unique(got)) == 6
