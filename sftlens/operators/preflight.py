"""Pre-flight: benchmark prompts, prompt-length statistics and the context budget."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import render_prompt


class ContextBudgetError(RuntimeError):
    """max_prompt_tokens + max_gen_toks exceeds max_model_len (never truncate)."""


def head_per_task(df: DataFrame, n: int | None, task_col: str, order_col: str) -> DataFrame:
    """L2: the first ``n`` rows of each task (``min(n, count)``); all rows when ``n`` is None.

    ``row_number() <= n`` is planned with a window group limit on both sides of
    the shuffle, so at most ``n`` rows per task and input partition move.
    """
    if n is None:
        return df
    w = Window.partitionBy(task_col).orderBy(order_col)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def benchmark_prompts(docs: DataFrame, catalog: DataFrame, tokenizer, task_col: str = "task",
                      question_col: str = "question") -> DataFrame:
    """P4 + P15: rendered prompt per doc and its token count *with* special tokens."""
    cat = catalog.select(F.col("task").alias(task_col), "template", "template_field")
    j = docs.join(cat, [task_col], "inner")
    prompt = render_prompt("template", "template_field", question_col)
    return j.withColumn("prompt", prompt).withColumn(
        "prompt_tokens", tokenizer.count(F.col("prompt"), add_special_tokens=True))


def prompt_length_stats(prompts: DataFrame) -> DataFrame:
    """Per task ``n_samples, max_prompt_tokens, mean_prompt_tokens``; the ``level='all'``
    row (task NULL) carries the global maximum (ROLLUP)."""
    return (prompts.rollup("task")
                   .agg(F.when(F.grouping("task") == 1, F.lit("all")).otherwise(F.lit("task")).alias("level"),
                        F.count(F.lit(1)).alias("n_samples"),
                        F.max("prompt_tokens").cast("bigint").alias("max_prompt_tokens"),
                        F.avg("prompt_tokens").alias("mean_prompt_tokens")))


def length_budget(stats: DataFrame, max_gen_toks: int, max_model_len: int) -> DataFrame:
    """A10: one row ``max_prompt_tokens, max_gen_toks, required_max_model_len, max_model_len,
    check_passed`` from the global row of :func:`prompt_length_stats`."""
    g = stats.where(F.col("level") == "all")
    req = F.coalesce(F.col("max_prompt_tokens"), F.lit(0)) + F.lit(max_gen_toks)
    return g.select(
        F.coalesce(F.col("max_prompt_tokens"), F.lit(0)).cast("bigint").alias("max_prompt_tokens"),
        F.lit(max_gen_toks).cast("bigint").alias("max_gen_toks"),
        req.cast("bigint").alias("required_max_model_len"),
        F.lit(max_model_len).cast("bigint").alias("max_model_len"),
        (req <= max_model_len).alias("check_passed"))


def assert_budget(budget: DataFrame) -> None:
    """Raise :class:`ContextBudgetError` when the check fails (one row reaches the driver)."""
    row = budget.first()
    if row is None or not row["check_passed"]:
        raise ContextBudgetError(
            f"max_prompt_tokens({row and row['max_prompt_tokens']}) + max_gen_toks"
            f"({row and row['max_gen_toks']}) > max_model_len({row and row['max_model_len']})")
