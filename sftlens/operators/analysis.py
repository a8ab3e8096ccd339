"""Run analysis end to end (A1-A6, C4, J5, SC3): from run manifests and sample files to one record per run.

Everything is a join of tables: the runs (one row each), their task manifests, the
chosen file of each task, and the parsed rows of those files.  Rows are read once, in
one aggregate per level; a hot task is pre-aggregated before the shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, py_strip, whitespace_token_count
from ..functions.variant import extract_doc_id, extract_output, field, is_none, py_str, typed_key
from .compare import generation_complete, tokens_per_s
from .stats import token_stats

# Manifest fields that a record carries, with their type and default.
RECORD_FIELDS = {
    "model_path": ("string", ""), "max_gen_toks": ("int", 32768), "max_model_len": ("int", 0),
    "max_num_batched_tokens": ("int", 0), "max_num_seqs": ("int", 0), "gpu_memory_utilization": ("double", 0.0),
    "enable_prefix_caching": ("boolean", False), "enable_chunked_prefill": ("boolean", False), "dtype": ("string", "bfloat16"),
    "vllm_version": ("string", "unknown"), "lm_eval_version": ("string", "unknown"), "gpu_peak_memory_mib": ("bigint", 0),
    "fallback_level": ("int", 0), "pipeline_elapsed_seconds": ("bigint", 0),
}


def _get(m: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(m, f"$['{name}']", kind)


def python_int(v: Column) -> Column:
    """``int(x or 0)`` of a JSON value, 0 where Python raises: numbers are cut, texts must be whole numbers."""
    kind, text = F.schema_of_variant(v), py_strip(F.try_variant_get(v, "$", "string"))
    return F.coalesce(F.when(kind == "STRING", F.when(text.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(text, F.lit("_"), F.lit("")).try_cast("bigint")))
                      .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint"))
                      .when(~kind.rlike("^(ARRAY|OBJECT)"), F.try_variant_get(v, "$", "double").cast("bigint")), F.lit(0))


def duplicate_key(v: Column, line: Column) -> Column:
    """A4: what makes a row a repeat within its file -- ``sample_id``, else the typed doc id,
    else the line number, all in one set."""
    sid = field(v, "sample_id")
    return F.when(~is_none(sid), typed_key(sid)).otherwise(typed_key(extract_doc_id(v, line)))


def chosen_files(runs: DataFrame, task_manifests: DataFrame, listing: DataFrame) -> DataFrame:
    """J5 on files: one row per run and task with ``path`` and ``token_source``.

    The exported file is taken if it is listed, else the raw sample file (which may be missing:
    then no rows follow).  The run manifest's maps come before the task manifest's
    field for exports, and after it for samples.
    """
    ok = runs.where("error is null")
    m = F.col("m")
    tasks = ok.select("root", "run_id", "m", F.explode(_get(m, "tasks", "array<string>")).alias("task"))
    tm = task_manifests.select("root", "run_id", "task", F.col("m").alias("_tm"))
    j = tasks.join(tm, ["root", "run_id", "task"], "left")
    in_map = lambda name: F.try_element_at(_get(m, name, "map<string,string>"), F.col("task"))
    j = j.select(
        "root", "run_id", "task",
        F.coalesce(F.try_element_at(_get(m, "expected_sample_counts", "map<string,bigint>"), F.col("task")), F.lit(0)).alias("expected_samples"),
        F.coalesce(F.nullif(in_map("exported_generation_files"), F.lit("")), _get(F.col("_tm"), "exported_generation_file")).alias("exported_file"),
        F.coalesce(F.nullif(_get(F.col("_tm"), "lm_eval_sample_file"), F.lit("")), in_map("lm_eval_sample_files")).alias("sample_file"))
    there = listing.select(F.col("path").alias("_p"), F.lit(True).alias("_there")).distinct()
    j = j.join(there, F.col("exported_file") == F.col("_p"), "left").drop("_p")
    exported = F.coalesce(F.col("_there"), F.lit(False))
    return j.select("*", F.when(exported, F.col("exported_file")).otherwise(F.col("sample_file")).alias("path"),
                    F.when(exported, "exported_generation_file").otherwise("lm_eval_sample_file").alias("token_source")).drop("_there")


def analyze_runs(runs: DataFrame, task_manifests: DataFrame, listing: DataFrame, rows: DataFrame) -> DataFrame:
    """One record per run of ``runs`` (``root, run_id, m, error``, see
    :func:`sftlens.sources.manifests.active_runs`).

    ``rows``: ``file, line, v`` of all sample and export files, malformed lines dropped.
    Exported rows count ``output_token_count`` (see :func:`python_int`) and ``raw_output``; raw
    sample rows count the white-space words of the extracted output.  ``task_stats`` holds one entry per
    task of the run (as many as its manifest names).  A run with ``error`` gives a record with the
    error, not complete, and no statistics.
    """
    files = chosen_files(runs, task_manifests, listing)
    v = F.col("v")
    named = rows.join(files.select("root", "task", "token_source", F.col("path").alias("file")), "file")
    exported = F.col("token_source") == "exported_generation_file"
    output = F.when(exported, F.coalesce(py_str(field(v, "raw_output")), F.lit(""))).otherwise(extract_output(v))
    count = python_int(field(v, "output_token_count"))
    facts = named.select("root", "task", output.alias("_out"), F.when(exported, count).alias("_count"), duplicate_key(v, F.col("line")).alias("key")) \
        .select("root", "task", "key", F.when(is_blank("_out"), "").otherwise("x").alias("output"),
                F.coalesce("_count", whitespace_token_count("_out")).alias("tokens"))
    caps = runs.where("error is null").select("root", F.coalesce(_get(F.col("m"), "max_gen_toks", "bigint"), F.lit(32768)).alias("cap"))
    stats = token_stats(facts.join(caps, "root"), model_col="root", max_gen_toks="cap")
    per_task = files.select("root", "task", "expected_samples", "sample_file", "exported_file", "token_source").join(
        stats.where("level = 'task'").drop("level"), ["root", "task"], "left")
    zero = ("actual_samples", "total_output_tokens", "p50", "p90", "p95", "max_output_tokens", "possibly_truncated_count",
            "empty_output_count", "duplicate_count")
    per_task = per_task.select(
        "root", "task", "expected_samples", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in zero],
        F.coalesce("avg_output_tokens", F.lit(0.0)).alias("avg_output_tokens"), "sample_file", "exported_file", "token_source",
        F.when(F.col("token_source") == "exported_generation_file", "exported_output_token_count").otherwise("split_estimate").alias("token_count_method"))
    task_stats = per_task.groupBy("root").agg(
        F.sum("expected_samples").alias("total_expected_samples"),
        F.array_sort(F.collect_set("token_count_method")).alias("output_token_count_methods"),
        F.array_sort(F.collect_list(F.struct(*[c for c in per_task.columns if c != "root"]))).alias("task_stats"))
    pooled = stats.where("level = 'overall'").drop("level", "task").withColumnRenamed("actual_samples", "total_actual_samples")
    m = F.col("m")
    j = runs.join(task_stats, "root", "left").join(pooled, "root", "left")
    fields = [F.coalesce(_get(m, name, kind), F.lit(default).cast(kind)).alias(name) for name, (kind, default) in RECORD_FIELDS.items()]
    j = j.select(
        "root", "error", F.coalesce(_get(m, "model_name"), F.col("root")).alias("model_name"), F.coalesce("run_id", F.lit("")).alias("run_id"),
        F.coalesce(_get(m, "status"), F.lit("unknown")).alias("manifest_status"),
        F.coalesce("total_expected_samples", F.lit(0)).cast("bigint").alias("total_expected_samples"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total_actual_samples", *zero[1:])],
        F.coalesce("avg_output_tokens", F.lit(0.0)).alias("avg_output_tokens"), "output_token_count_methods", "task_stats",
        F.coalesce(_get(m, "successful_attempt_elapsed_seconds", "bigint"), F.lit(0)).alias("successful_attempt_wall_time"), *fields)
    good = F.col("error").isNull()
    return j.withColumn("tokens_per_s", tokens_per_s(F.col("total_output_tokens"), F.col("successful_attempt_wall_time"))).withColumn(
        "generation_complete", good & generation_complete(F.col("manifest_status"), F.col("total_actual_samples"),
                                                          F.col("total_expected_samples"), F.col("empty_output_count")))


def run_warnings(runs: DataFrame, task_manifests: DataFrame, listing: DataFrame, rows: DataFrame,
                 expected_method: str = "llama_tokenizer") -> DataFrame:
    """A12 for the runs of :func:`analyze_runs`: ``root, position, task, line, warning`` -- a row per exported record that
    counted its tokens by another method.  Ordered by task position in the run and line, a run's
    rows are the list of its record; they stay rows because they grow with the data.  Equal texts of a task come once."""
    files = chosen_files(runs, task_manifests, listing).where("token_source = 'exported_generation_file'")
    tasks = runs.where("error is null").select("root", F.posexplode(_get(F.col("m"), "tasks", "array<string>")).alias("position", "task"))
    v = field("v", "output_token_count_method")
    odd = rows.withColumn("method", F.when(~is_none(v), py_str(v))).where((F.col("method") != "") & (F.col("method") != expected_method))
    named = odd.join(files.select("root", "task", F.col("path").alias("file")), "file").join(tasks, ["root", "task"])
    line = F.col("line").cast("bigint")
    warning = F.format_string("line %d: output_token_count_method='%s'", line, F.col("method"))
    return named.select("root", "position", "task", line.alias("line"), warning.alias("warning")).distinct()


def resume_reasons(manifests: DataFrame, sample_errors: DataFrame, export_errors: DataFrame, listing: DataFrame,
                   max_gen_toks: int = 32768) -> DataFrame:
    """``task, reason`` -- why a task must run again, NULL if it may be skipped.

    ``manifests``: ``task, m VARIANT`` (NULL if unreadable); ``sample_errors`` and ``export_errors``:
    output of V1 and V3 (any row of a task fails it); ``listing``: ``path, length``.  The first failing check
    names the reason, in the order of the checks below.
    """
    from .validate import _is_number

    m = F.col("m")
    bad = lambda df, name: df.groupBy("task").agg(F.count(F.lit(1)).alias(name))
    size = lambda name: listing.groupBy(F.col("path").alias(f"_{name}_path")).agg(F.max("length").alias(f"_{name}_size"))
    j = (manifests.withColumn("_sample", _get(m, "lm_eval_sample_file")).withColumn("_export", _get(m, "exported_generation_file"))
         .join(size("sample"), F.col("_sample") == F.col("_sample_path"), "left")
         .join(size("export"), F.col("_export") == F.col("_export_path"), "left")
         .join(bad(sample_errors, "_n_sample"), "task", "left").join(bad(export_errors, "_n_export"), "task", "left"))
    complete = lambda name: F.coalesce(_get(m, name) == "complete", F.lit(False))
    length_ok = F.floor(F.coalesce(_get(m, "max_model_len", "double"), F.lit(0.0))) >= max_gen_toks
    # The names of the reasons, in the order of the checks.
    checks = [
        ("manifest_parse_error", m.isNotNull()), ("not_complete", complete("status")),
        ("config_mismatch", _is_number(m, "max_gen_toks", max_gen_toks) & length_ok),
        ("sample_missing", F.col("_sample_size").isNotNull()), ("sample_validation_failed", F.col("_n_sample").isNull()),
        ("export_missing", F.coalesce(F.col("_export_size") > 0, F.lit(False))), ("export_validation_failed", F.col("_n_export").isNull()),
        ("export_not_complete", complete("export_status")),
    ]
    reason = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        reason = F.when(~ok, name).otherwise(reason)
    return j.select("task", reason.alias("reason"))
