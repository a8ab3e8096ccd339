"""Recorded inference attempts and telemetry.

Attempt analysis runs over *recorded* attempts (running them is not built):
classification is a regex over the attempt's log lines, rolled up with
``bool_or``; the fallback-ladder verdict is two aggregates and a join, so a
task with very many attempts is never gathered into one window partition.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip

# Log phrases that mark an out-of-memory attempt (case-insensitive).
OOM_PATTERN = (r"(?i)CUDA out of memory|torch\.cuda\.OutOfMemoryError|OutOfMemoryError|"
               r"HBM out of memory|CUDA error: out of memory|"
               r"The model's max seq len.*larger than the maximum number of tokens")
# The fallback ladder -- level, max batched tokens, max sequences,
# GPU memory fraction, prefix caching.
FALLBACK_LADDER = [
    (1, 8192, 32, 0.90, True),
    (2, 4096, 16, 0.90, True),
    (3, 2048, 8, 0.88, True),
    (4, 2048, 4, 0.88, False),
]


def classify_attempts(attempts: DataFrame, logs: DataFrame, keys=("task", "attempt"),
                      rc_col: str = "exit_code", line_col: str = "log_line") -> DataFrame:
    """``success`` when the exit code is 0, ``oom`` when any log line matches the
    OOM pattern, else ``error``.  ``logs`` has one row per log line."""
    k = list(keys)
    oom = logs.groupBy(*k).agg(F.bool_or(F.col(line_col).rlike(OOM_PATTERN)).alias("_oom"))
    j = attempts.join(oom, k, "left")
    status = (F.when(F.col(rc_col) == 0, F.lit("success"))
               .when(F.coalesce(F.col("_oom"), F.lit(False)), F.lit("oom"))
               .otherwise(F.lit("error")))
    return j.withColumn("status", status).drop("_oom")


def attempt_rollup(attempts: DataFrame, task_col: str = "task", status_col: str = "status",
                   elapsed_col: str = "elapsed_seconds") -> DataFrame:
    """Total, successful and failed elapsed seconds and attempt counts per task."""
    ok = F.col(status_col) == "success"
    e = F.col(elapsed_col)
    return attempts.groupBy(task_col).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.coalesce(F.sum(e), F.lit(0)).alias("pipeline_elapsed_seconds"),
        F.coalesce(F.sum(F.when(ok, e)), F.lit(0)).alias("successful_attempt_elapsed_seconds"),
        F.coalesce(F.sum(F.when(~ok, e)), F.lit(0)).alias("failed_attempt_elapsed_seconds"))


def first_success(attempts: DataFrame, task_col: str = "task", order_col: str = "attempt",
                  status_col: str = "status") -> DataFrame:
    """L3: walk the attempts in order; the first success wins, an ``oom`` moves on, any
    other failure stops the ladder.

    Per task: ``outcome`` (success / stopped / exhausted), ``successful_attempt``
    (its ordinal, counted from 1) and ``stop_attempt``.  First success and first
    hard failure are found with one aggregate; the ordinal of the winner is a
    ``count_if`` in a second aggregate after joining those per-task marks back.
    """
    s = F.col(status_col)
    hard = ~s.isin("success", "oom")
    marks = attempts.groupBy(task_col).agg(
        F.min(F.when(s == "success", F.col(order_col))).alias("_first_ok"),
        F.min(F.when(hard, F.col(order_col))).alias("_first_hard"))
    j = attempts.join(marks, task_col)
    counted = j.groupBy(task_col).agg(
        F.first("_first_ok", ignorenulls=True).alias("_first_ok"),
        F.first("_first_hard", ignorenulls=True).alias("_first_hard"),
        F.count_if(F.col(order_col) <= F.col("_first_ok")).alias("_ok_pos"),
        F.count_if(F.col(order_col) <= F.col("_first_hard")).alias("_hard_pos"))
    ok_first = F.col("_first_ok").isNotNull() & (F.col("_first_hard").isNull()
                                                 | (F.col("_first_ok") < F.col("_first_hard")))
    return counted.select(
        task_col,
        F.when(ok_first, F.lit("success")).when(F.col("_first_hard").isNotNull(), F.lit("stopped"))
         .otherwise(F.lit("exhausted")).alias("outcome"),
        F.when(ok_first, F.col("_ok_pos")).cast("bigint").alias("successful_attempt"),
        F.when(~ok_first & F.col("_first_hard").isNotNull(), F.col("_hard_pos")).cast("bigint").alias("stop_attempt"))


def winning_config(verdicts: DataFrame, ladder=FALLBACK_LADDER, task_col: str = "task") -> DataFrame:
    """L3: the configuration under which a task succeeded: its verdict (:func:`first_success`)
    with the ladder row of the winning attempt; NULL without a success, or where the recorded attempts
    go beyond the ladder."""
    rows = verdicts.sparkSession.createDataFrame(ladder, "fallback_level int, max_num_batched_tokens int, max_num_seqs int, "
                                                         "gpu_memory_utilization double, enable_prefix_caching boolean")
    return verdicts.join(rows, F.col("successful_attempt") == F.col("fallback_level"), "left").select(
        task_col, "outcome", *rows.columns)


def parse_telemetry(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """SC7: comma-separated samples -> ``mem_used`` as an integer (``int(float(x))``);
    rows with fewer than two fields or a non-numeric second field are dropped."""
    parts = F.split(F.col(text_col), ",", -1)
    raw = F.try_element_at(parts, F.lit(2))
    val = py_strip(raw).try_cast("double")
    return (lines.withColumn("_n", F.size(parts)).withColumn("mem_used_f", val)
                 .where((F.col("_n") >= 2) & F.col("mem_used_f").isNotNull()
                        & ~F.isnan("mem_used_f") & (F.abs("mem_used_f") != float("inf")))
                 .withColumn("mem_used", F.col("mem_used_f").cast("bigint"))
                 .drop("_n", "mem_used_f"))


def peak(df: DataFrame, value_col: str = "mem_used", group_cols=()) -> DataFrame:
    """The maximum integer part, 0 when there are no rows (peak starts at 0)."""
    agg = df.groupBy(*group_cols).agg(F.max(value_col).alias("_m"))
    return agg.select(*group_cols, F.greatest(F.coalesce(F.col("_m"), F.lit(0)), F.lit(0)).cast("bigint")
                      .alias("peak"))
