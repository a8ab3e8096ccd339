"""Run-level rollups and completion judgement."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_rollup(tasks: DataFrame, run_col: str = "run_id", task_col: str = "task", order_col: str | None = None) -> DataFrame:
    """Per run -- sums of the task timings, per-task maps, the errors of all tasks in task
    order, the first results file in task order, and the status.

    ``tasks`` has one row per (run, task) that the run should have, with ``pipeline_elapsed_seconds``,
    ``successful_attempt_elapsed_seconds``, ``failed_attempt_elapsed_seconds``,
    ``expected``, ``actual``, ``errors ARRAY<STRING>`` and ``results_file``; and, where the task manifests
    are at hand (see :func:`task_errors`), ``sample_file``, ``exported_file`` and ``all_succeeded``.
    ``order_col`` is the position of a task in its run (by default its name).  A run is complete if no task has
    an error and every task succeeded.  Maps and lists hold one entry per task of the run, which its manifest
    names; they do not grow with the data.
    """
    at = order_col or task_col
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(task_col), F.col(c))))))
    maps = [entries(c).alias(f"{c}s") for c in ("sample_file", "exported_file") if c in tasks.columns]
    succeeded = F.bool_and("all_succeeded") if "all_succeeded" in tasks.columns else F.lit(True)
    out = tasks.groupBy(run_col).agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.sum("pipeline_elapsed_seconds").alias("pipeline_elapsed_seconds"),
        F.sum("successful_attempt_elapsed_seconds").alias("successful_attempt_elapsed_seconds"),
        F.sum("failed_attempt_elapsed_seconds").alias("failed_attempt_elapsed_seconds"),
        entries("expected").alias("expected_sample_counts"),
        entries("actual").alias("actual_sample_counts"), *maps,
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("_at"), F.col("errors")))), lambda s: s["errors"])).alias("completion_errors"),
        F.min(F.when(F.col("results_file").isNotNull(), F.struct(F.col(at).alias("_at"), F.col("results_file"))))["results_file"].alias("results_file"),
        succeeded.alias("_ok"))
    return out.withColumn("status", F.when(F.col("_ok") & (F.size("completion_errors") == 0), "complete").otherwise("incomplete")).drop("_ok")


def task_errors(manifest: Column, listing_size: Column, task_col: str = "task") -> Column:
    """The errors a task adds to its run -- no or unreadable manifest (NULL), a status other than
    ``complete``, an export file that is not named, not there (``listing_size`` NULL) or empty, and an
    unfinished export.  All that hold, in this order."""
    get = lambda name: F.try_variant_get(manifest, f"$['{name}']", "string")
    say = lambda cond, text: F.when(F.coalesce(cond, F.lit(True)), F.concat(F.lit("task "), F.col(task_col), F.lit(text)))
    there = manifest.isNotNull()
    named = F.coalesce(F.length(get("exported_generation_file")), F.lit(0)) > 0
    return F.when(~there, F.array(F.concat(F.lit("task "), F.col(task_col), F.lit(": no manifest")))).otherwise(F.array_compact(F.array(
        say(get("status") != "complete", ": not complete"), say(~named, ": no export file named"),
        F.when(named, say(listing_size.isNull(), ": export file not found")), F.when(named & (listing_size == 0), say(F.lit(True), ": export file is empty")),
        say(get("export_status") != "complete", ": export not complete"))))


def catalog_consistency(catalog: DataFrame) -> DataFrame:
    """One row -- task names unique, and every task shares the stop strings and the
    generation parameters."""
    return catalog.agg(
        (F.count(F.lit(1)) == F.count_distinct("task")).alias("names_unique"),
        (F.count_distinct(F.array_sort("until")) == 1).alias("same_stop_strings"),
        (F.count_distinct(F.struct("do_sample", "temperature", "max_gen_toks", "repeats", "num_fewshot")) == 1)
        .alias("same_generation"))


def prefer_exported(rows: DataFrame, exported_tasks: DataFrame, task_col: str = "task",
                    exported_tokens: str = "exported_tokens", raw_tokens: str = "raw_tokens") -> DataFrame:
    """Per task, token counts from the exported file when the task has one, else the
    raw-sample estimate; ``token_source`` / ``token_count_method`` record the choice.

    ``exported_tasks`` (one row per task with an export) is joined (a
    broadcast while it is under the planner's threshold); the choice is made per row, so stats run in one pass.
    """
    flag = exported_tasks.select(F.col(task_col), F.lit(True).alias("_has_export")).distinct()
    j = rows.join(flag, [task_col], "left")
    has = F.coalesce(F.col("_has_export"), F.lit(False))
    return (j.withColumn("tokens", F.when(has, F.col(exported_tokens)).otherwise(F.col(raw_tokens)))
             .withColumn("token_source", F.when(has, F.lit("exported_generation_file"))
                         .otherwise(F.lit("lm_eval_sample_file")))
             .withColumn("token_count_method", F.when(has, F.lit("exported_output_token_count"))
                         .otherwise(F.lit("split_estimate")))
             .drop("_has_export"))


def judge_completion(tasks: DataFrame, sample_errors: DataFrame, results: DataFrame,
                     export_failures: DataFrame | None = None, task_col: str = "task", required_gen_toks: int = 32768) -> DataFrame:
    """V6: a task is ``complete`` iff it has no error of these, in order: a results file was found
    and parses; a sample file was found; its samples validate (V1, the expected count among its rules);
    ``max_gen_toks`` is the required one; ``max_model_len`` is no smaller; its export did not fail.

    ``sample_errors`` is V1 output; ``results`` is :func:`discover_first` output (``task, path``, and
    ``parses`` where the files were read); ``tasks`` may have ``sample_file``, ``max_gen_toks`` and
    ``max_model_len`` (columns that are not there are not checked); ``export_failures`` has ``task, error``.
    """
    errs = sample_errors.groupBy(task_col).agg(F.count(F.lit(1)).alias("_n_err"),
                                               F.sort_array(F.collect_set("code")).alias("_codes"))
    parses = F.col("parses") if "parses" in results.columns else F.lit(True)
    found = results.select(task_col, F.col("path").alias("_results"), parses.alias("_parses"))
    j = tasks.join(errs, task_col, "left").join(found, task_col, "left")
    if export_failures is not None:
        j = j.join(export_failures.withColumnRenamed("error", "_export_error"), task_col, "left")
    else:
        j = j.withColumn("_export_error", F.lit(None).cast("string"))
    has = set(tasks.columns)
    checks = [
        F.when(F.col("_results").isNull(), F.lit("results file not found")),
        F.when(F.col("_results").isNotNull() & ~F.coalesce("_parses", F.lit(False)), F.lit("results file does not parse")),
        F.when(F.col("sample_file").isNull(), F.lit("sample file not found")) if "sample_file" in has else None,
        F.when(F.coalesce(F.col("_n_err"), F.lit(0)) > 0, F.concat(F.lit("sample validation: "), F.array_join("_codes", ","))),
        F.when(~F.col("max_gen_toks").eqNullSafe(F.lit(required_gen_toks)), F.lit("max_gen_toks is not the required one")) if "max_gen_toks" in has else None,
        F.when(~F.coalesce(F.col("max_model_len") >= F.col("max_gen_toks"), F.lit(False)), F.lit("max_model_len is below max_gen_toks"))
        if {"max_gen_toks", "max_model_len"} <= has else None,
        F.when(F.col("_export_error").isNotNull(), F.concat(F.lit("export failed: "), F.col("_export_error"))),
    ]
    errors = F.array_compact(F.array(*[c for c in checks if c is not None]))
    return j.select(task_col, F.when(F.size(errors) == 0, "complete").otherwise("incomplete").alias("status"), errors.alias("completion_errors"))
