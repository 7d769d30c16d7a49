from pyspark.sql import functions as F

from ranktab.llm.lines import with_segment_keys


def test_keys_of_lines_with_and_without_wide_characters(spark):
    """Lines of one byte per character are cut by bytes; keys are those of the cut by characters."""
    texts = ["abcdefghijkl", "abcdefghijké", "ébcdefghijkl", "abcdefghij", "日本語abcdefg", "abc", "naïve line"]
    lines = spark.createDataFrame([(t,) for t in texts], "line string").withColumn("n", F.char_length("line"))
    keyed = with_segment_keys(lines, 2)
    assert "octet_length" in keyed._jdf.queryExecution().analyzed().toString()
    own = {(r["line"], r["key"]) for r in keyed.where("indexed").collect()}
    cuts = [(t, i, t[len(t) // 3 * i + max(0, i - (3 - len(t) % 3)):][: len(t) // 3 + (i >= 3 - len(t) % 3)]) for t in texts for i in range(3)]
    wanted = spark.createDataFrame([(t, len(t), i, c) for t, i, c in cuts], "line string, n int, i int, part string")
    assert own == {(r[0], r[1]) for r in wanted.select("line", F.xxhash64("n", "i", "part")).collect()}
    shared = keyed.where("line in ('abcdefghijkl', 'abcdefghijké')").groupBy("key").agg(F.count_distinct("line").alias("n"))
    assert shared.where("n = 2").count() > 0
