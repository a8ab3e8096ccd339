"""Token statistics that merge (A1, A2 over the increments of an ingest).

An increment is a histogram: one row per (model, task, token count) with how many samples and how many blank outputs
it stands for.  Histograms add up, so percentiles, sums and counts over any number of increments come from
them alone: rows that were counted once are never read again, and an increment that is written again replaces itself.
An increment is as large as its distinct token counts, whatever the number of samples.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TRUNCATION_MARGIN, is_blank
from .stats import PERCENTILES, exact_percentiles_from_hist

HISTOGRAM = "model string, task string, tokens bigint, samples bigint, blank bigint"


def token_histogram(df: DataFrame, model_col: str = "model", task_col: str = "task", tokens_col: str = "tokens", output_col: str = "output") -> DataFrame:
    """``HISTOGRAM`` rows of samples (partial aggregates before the shuffle)."""
    return (df.select(F.col(model_col).alias("model"), F.col(task_col).alias("task"), F.col(tokens_col).cast("bigint").alias("tokens"), is_blank(output_col).alias("_blank"))
            .groupBy("model", "task", "tokens").agg(F.count(F.lit(1)).alias("samples"), F.count_if("_blank").alias("blank")))


def add_increment(df: DataFrame, path: str, increment: int, **columns: str) -> None:
    """Write the histogram of ``df`` as increment number ``increment``; again after a failure gives the same."""
    token_histogram(df, **columns).write.mode("overwrite").parquet(f"{path}/increment={increment}")


def merge_increments(spark: SparkSession, path: str) -> DataFrame:
    """One histogram of all increments."""
    return (spark.read.schema(HISTOGRAM).parquet(path).groupBy("model", "task", "tokens")
            .agg(F.sum("samples").alias("samples"), F.sum("blank").alias("blank")))


def stats_of_histogram(hist: DataFrame, max_gen_toks: int = 32768) -> DataFrame:
    """The columns of :func:`stats.token_stats` (without repeats, which no histogram knows): a row per (model, task) and,
    pooled, per model."""
    h = (hist.groupingSets([("model", "task", "tokens"), ("model", "tokens")], "model", "task", "tokens")
         .agg(F.grouping("task").alias("_pooled"), F.sum("samples").alias("_cnt"), F.sum("blank").alias("_blank")))
    keys = ["model", "task", "_pooled"]
    out = exact_percentiles_from_hist(h, keys, "tokens", "_cnt", PERCENTILES, [
        F.sum("_cnt").alias("actual_samples"), F.sum(F.col("tokens") * F.col("_cnt")).cast("bigint").alias("total_output_tokens"),
        F.max("tokens").alias("max_output_tokens"),
        F.sum(F.when(F.col("tokens") >= max_gen_toks - TRUNCATION_MARGIN, F.col("_cnt")).otherwise(0)).cast("bigint").alias("possibly_truncated_count"),
        F.sum("_blank").cast("bigint").alias("empty_output_count")])
    return out.select(
        "model", "task", F.when(F.col("_pooled") == 1, "overall").otherwise("task").alias("level"), "actual_samples", "total_output_tokens",
        F.bround(F.col("total_output_tokens") / F.col("actual_samples"), 1).alias("avg_output_tokens"), *[F.col(f"p{p}").cast("bigint").alias(f"p{p}") for p in PERCENTILES],
        "max_output_tokens", "possibly_truncated_count", "empty_output_count")
