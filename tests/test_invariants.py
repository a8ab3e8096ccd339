import os

from pyspark.sql import functions as F

from sftlens.operators.grading import is_equiv
from sftlens.operators.stats import token_stats
from sftlens.sources.jsonl import read_lines


def test_line_numbers_across_many_blocks(spark, tmp_dir):
    paths = []
    for name, n in (("a.jsonl", 3000), ("b.jsonl", 1234)):
        p = os.path.join(tmp_dir, name)
        with open(p, "w") as f:
            for i in range(1, n + 1):
                f.write("" if i % 97 == 0 else f'{{"i": {i}, "pad": "{"x" * (i % 13)}"}}')
                f.write("\n")
        paths.append(p)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_lines(spark, paths)
        assert lines.rdd.getNumPartitions() > 10
        got = lines.select(F.regexp_extract("file", r"([^/]+)$", 1).alias("f"), "line", "text").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for f, n in (("a.jsonl", 3000), ("b.jsonl", 1234)):
        rows = sorted((r["line"], r["text"]) for r in got if r["f"] == f)
        assert [x[0] for x in rows] == list(range(1, n + 1))
        for line, text in rows:
            assert text == ("" if line % 97 == 0 else f'{{"i": {line}, "pad": "{"x" * (line % 13)}"}}')


def test_is_equiv_symmetric(spark):
    vals = ["42", "\\frac12", "1/2", "0.5", "x = 3", "3", "\\sqrt3", "\\sqrt{3}", "2\\frac", None, "abc=3"]
    pairs = [(a, b) for a in vals for b in vals]
    df = spark.createDataFrame(pairs, "a string, b string")
    ab = {(r["a"], r["b"]): r["e"] for r in is_equiv(df, "a", "b", "e").collect()}
    for a, b in pairs:
        assert ab[(a, b)] == ab[(b, a)]


def test_pooled_totals_equal_sum_of_tasks(spark):
    df = spark.range(0, 500).select(
        (F.col("id") % 3).cast("string").alias("model"), (F.col("id") % 7).cast("string").alias("task"),
        (F.col("id") * 37 % 101).alias("tokens"), F.lit("x").alias("output"), (F.col("id") % 50).cast("string").alias("key"))
    st = token_stats(df).collect()
    for m in ("0", "1", "2"):
        tasks = [r for r in st if r["model"] == m and r["level"] == "task"]
        pooled = [r for r in st if r["model"] == m and r["level"] == "overall"][0]
        for c in ("actual_samples", "total_output_tokens", "duplicate_count", "empty_output_count"):
            assert pooled[c] == sum(r[c] for r in tasks)
        assert pooled["max_output_tokens"] == max(r["max_output_tokens"] for r in tasks)
