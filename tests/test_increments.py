"""Merged token statistics and the rewrite of chosen partitions."""
import random

from pyspark.sql import functions as F

from sftlens.operators.increments import HISTOGRAM, add_increment, merge_increments, stats_of_histogram
from sftlens.operators.stats import token_stats
from sftlens.sinks.writers import rewrite_partitions, write_jsonl


def test_increments_merge_to_the_whole(spark, tmp_dir):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice(["t", "u", None]), rng.choice([0, 5, 5, 5, 7, 40_000, rng.randint(0, 900)]), rng.choice(["x", " ", None])) for _ in range(700)]
    df = spark.createDataFrame(rows, "model string, task string, tokens long, output string").withColumn("key", F.monotonically_increasing_id())
    df = spark.createDataFrame(df.collect(), df.schema)
    for n in range(3):
        add_increment(df.where(F.col("key") % 3 == n), tmp_dir + "/h", n)
    add_increment(df.where(F.col("key") % 3 == 1), tmp_dir + "/h", 1)
    got = stats_of_histogram(merge_increments(spark, tmp_dir + "/h"))
    want = token_stats(df.where("task IS NOT NULL"), key_col=None)
    key = lambda r: str(r)
    assert sorted(map(tuple, got.where("task IS NOT NULL").collect()), key=key) == sorted(map(tuple, want.where("task IS NOT NULL").select(*got.columns).collect()), key=key)
    pooled = {r["model"]: (r["actual_samples"], r["p90"]) for r in got.where("level = 'overall'").collect()}
    whole = {r["model"]: (r["actual_samples"], r["p90"]) for r in token_stats(df, key_col=None).where("level = 'overall'").collect()}
    assert pooled == whole
    spark.createDataFrame([], HISTOGRAM).write.parquet(tmp_dir + "/none/increment=0")
    assert stats_of_histogram(merge_increments(spark, tmp_dir + "/none")).count() == 0


def test_only_named_partitions_are_rewritten(spark, tmp_dir):
    df = spark.createDataFrame([(m, t, i) for m in "ab" for t in "tuv" for i in range(3)], "model string, task string, i long")
    write_jsonl(df, tmp_dir + "/x", partition_by=("model", "task"))

    def state():
        rows = spark.read.schema("model string, task string, i long").json(tmp_dir + "/x").select("model", "task", "i", F.col("_metadata.file_name").alias("f")).collect()
        return {(m, t): (sorted(r["i"] for r in rows if (r["model"], r["task"]) == (m, t)), {r["f"] for r in rows if (r["model"], r["task"]) == (m, t)}) for m in "ab" for t in "tuv"}

    before = state()
    pending = spark.createDataFrame([("a", "t", "lost"), ("b", "v", "short"), ("b", "v", "again"), ("c", "t", "unknown")], "model string, task string, reason string")
    rewrite_partitions(df.withColumn("i", F.col("i") + 10), tmp_dir + "/x", pending, ("model", "task"))
    after = state()
    for k in before:
        if k in {("a", "t"), ("b", "v")}:
            assert after[k][0] == [10, 11, 12] and not after[k][1] & before[k][1]
        else:
            assert after[k] == before[k]
