"""Run-level queries.

``run_rollup``: the attempt stand-in's tasks (``events.user_id``) belong to
run ``user_id div 20``, so a run has 20 tasks however many users there are; a task that the
ladder stopped has a manifest with status ``failed``, one without success (id % 7 = 3) none, and
id % 5 = 1 an export file that is not there; its results file is ``results_<task>.json``, except for
even ids, which have none.  ``prefer_exported``: a
``documents`` task (source) has an exported file when any of its documents
carries a quality-1 label; exported counts are code points, raw ones the
whitespace estimate.  ``method_audit`` / ``export_counters`` run on the
export stand-in (with the validation faults for methods).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sql_ws_token_count, whitespace_token_count
from ..operators.attempts import attempt_rollup, first_success
from ..operators.export import export_counters
from ..operators.runs import prefer_exported, run_rollup, task_errors
from ..operators.stats import method_audit, token_stats_flat
from .attempt_queries import classified
from .common import table
from .export_queries import _TASK_SQL, export_lines_with_faults, exported
from .stats_queries import sql_percentile

TASKS_PER_RUN = 20


def q_run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classified(spark, sf_dir)
    roll = attempt_rollup(c).join(first_success(c), "task")
    t, ok = F.col("task"), F.col("outcome") == "success"
    manifest = F.try_parse_json(F.when(~(~ok & (t % 7 == 3)), F.to_json(F.struct(
        F.when(F.col("outcome") == "stopped", "failed").otherwise("complete").alias("status"), F.lit("complete").alias("export_status"),
        F.concat(F.lit("/exports/"), t.cast("string")).alias("exported_generation_file")))))
    roll = roll.withColumn("m", manifest).withColumn("_size", F.when(t % 5 != 1, F.lit(9).cast("bigint"))).withColumn("_id", t).withColumn(
        "task", t.cast("string"))
    tasks = roll.select(
        F.concat(F.lit("run_"), F.floor(F.col("_id") / TASKS_PER_RUN).cast("string")).alias("run_id"), "_id", "task", "pipeline_elapsed_seconds",
        "successful_attempt_elapsed_seconds", "failed_attempt_elapsed_seconds", F.col("attempts").alias("expected"),
        F.when(ok, F.col("successful_attempt")).otherwise(F.lit(0)).alias("actual"), task_errors(F.col("m"), F.col("_size")).alias("errors"),
        F.when(F.col("_id") % 2 == 1, F.concat(F.lit("results_"), "task", F.lit(".json"))).alias("results_file"),
        F.try_variant_get("m", "$.exported_generation_file", "string").alias("exported_file"), ok.alias("all_succeeded"))
    r = run_rollup(tasks, order_col="_id")
    return r.select("run_id", F.col("n_tasks").cast("bigint").alias("n_tasks"), "status",
                    *[F.col(c).cast("bigint").alias(c) for c in ("pipeline_elapsed_seconds",
                                                                 "successful_attempt_elapsed_seconds",
                                                                 "failed_attempt_elapsed_seconds")],
                    F.aggregate(F.map_values("expected_sample_counts"), F.lit(0).cast("bigint"),
                                lambda a, x: a + x).alias("total_expected"),
                    F.size("exported_files").cast("bigint").alias("n_exported"), F.array_join("completion_errors", "; ").alias("errors"), "results_file")


def q_prefer_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("task"), "text")
    lab = table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")
    exported_tasks = d.select("doc_id", "task").join(lab, "doc_id", "left_semi").select("task").distinct()
    rows = d.select("task", F.length("text").cast("bigint").alias("exported_tokens"),
                    whitespace_token_count("text").alias("raw_tokens"))
    chosen = prefer_exported(rows, exported_tasks)
    st = token_stats_flat(chosen, ["task", "token_source", "token_count_method"], "tokens")
    return st.select("task", "token_source", "token_count_method", "actual_samples", "total_output_tokens",
                     "p50", "p95", "max_output_tokens")


def q_method_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only one field is needed: read it with a one-field schema (the JSON parser skips
    # the rest of each record) instead of building the whole record as a VARIANT.
    lines = export_lines_with_faults(spark, sf_dir)
    recs = lines.select("task", "line", F.from_json("text", "output_token_count_method string")
                        ["output_token_count_method"].alias("m"))
    methods, warnings = method_audit(recs, ["task"], "m", "line", expected_method="codepoint")
    w = warnings.groupBy("task").agg(F.count(F.lit(1)).alias("n_warnings"))
    return methods.select("task", F.array_join("methods", ",").alias("methods")).join(w, "task", "left") \
                  .select("task", "methods", F.coalesce("n_warnings", F.lit(0)).cast("bigint").alias("n_warnings"))


def q_export_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = export_counters(exported(spark, sf_dir))
    return c.select("task", F.col("total_records").cast("bigint").alias("total_records"),
                    F.col("unique_sample_ids").cast("bigint").alias("unique_sample_ids"))


SQL_RUN_ROLLUP = """
WITH a AS (
  SELECT user_id AS task, event_id AS attempt, CAST(floor(value) AS BIGINT) AS el,
    CASE WHEN event_type = 'purchase' THEN 'success' WHEN event_type IN ('view', 'signup') THEN 'oom'
         ELSE 'error' END AS status
  FROM events),
m AS (SELECT task, min(attempt) FILTER (WHERE status = 'success') AS ok,
             min(attempt) FILTER (WHERE status NOT IN ('success', 'oom')) AS hard,
             count(*) AS attempts, sum(el) AS pipe,
             coalesce(sum(el) FILTER (WHERE status = 'success'), 0) AS succ,
             coalesce(sum(el) FILTER (WHERE status <> 'success'), 0) AS fail
      FROM a GROUP BY 1),
t AS (SELECT m.*, NOT (ok IS NOT NULL AND (hard IS NULL OR ok < hard)) AND hard IS NOT NULL AS stopped FROM m),
e AS (SELECT *, task % 7 = 3 AND (stopped OR ok IS NULL) AS gone FROM t),
x AS (SELECT *, CASE WHEN gone THEN ['task ' || CAST(task AS VARCHAR) || ': no manifest']
                ELSE list_filter([CASE WHEN stopped THEN 'task ' || CAST(task AS VARCHAR) || ': not complete' END,
                                  CASE WHEN task % 5 = 1 THEN 'task ' || CAST(task AS VARCHAR) || ': export file not found' END],
                                 lambda s: s IS NOT NULL) END AS errs,
        NOT stopped AND ok IS NOT NULL AS fine FROM e)
SELECT 'run_' || CAST(task // 20 AS VARCHAR) AS run_id, CAST(count(*) AS BIGINT) AS n_tasks,
  CASE WHEN bool_and(fine) AND sum(len(errs)) = 0 THEN 'complete' ELSE 'incomplete' END AS status,
  CAST(sum(pipe) AS BIGINT) AS pipeline_elapsed_seconds, CAST(sum(succ) AS BIGINT) AS successful_attempt_elapsed_seconds,
  CAST(sum(fail) AS BIGINT) AS failed_attempt_elapsed_seconds, CAST(sum(attempts) AS BIGINT) AS total_expected,
  CAST(count(*) FILTER (WHERE NOT gone) AS BIGINT) AS n_exported,
  coalesce(array_to_string(flatten(list(errs ORDER BY task)), '; '), '') AS errors,
  'results_' || CAST(min(task) FILTER (WHERE task % 2 = 1) AS VARCHAR) || '.json' AS results_file
FROM x GROUP BY 1, task // 20
"""

SQL_PREFER_EXPORTED = f"""
WITH ex AS (SELECT DISTINCT d.source AS task FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1),
r AS (SELECT d.source AS task, ex.task IS NOT NULL AS has,
        CASE WHEN ex.task IS NOT NULL THEN CAST(length(d.text) AS BIGINT) ELSE {sql_ws_token_count('d.text')} END AS tokens
      FROM documents d LEFT JOIN ex ON d.source = ex.task),
s AS (SELECT task, has, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tot, list_sort(list(tokens)) AS sl,
        max(tokens) AS mx FROM r GROUP BY 1, 2)
SELECT task, CASE WHEN has THEN 'exported_generation_file' ELSE 'lm_eval_sample_file' END AS token_source,
  CASE WHEN has THEN 'exported_output_token_count' ELSE 'split_estimate' END AS token_count_method,
  CAST(n AS BIGINT) AS actual_samples, tot AS total_output_tokens,
  {sql_percentile('sl', 'n', 50)} AS p50, {sql_percentile('sl', 'n', 95)} AS p95, CAST(mx AS BIGINT) AS max_output_tokens
FROM s
"""

SQL_METHOD_AUDIT = "WITH" + _TASK_SQL + """,
m AS (SELECT task, CASE WHEN doc_id % 8 = 5 THEN 'split_estimate' ELSE 'codepoint' END AS method FROM d)
SELECT task, array_to_string(list_sort(list_distinct(list(method))), ',') AS methods,
  CAST(count(*) FILTER (WHERE method <> 'codepoint') AS BIGINT) AS n_warnings
FROM m GROUP BY 1
"""

SQL_EXPORT_COUNTERS = "WITH" + _TASK_SQL + """
SELECT task, CAST(count(*) AS BIGINT) AS total_records, CAST(count(DISTINCT doc_id) AS BIGINT) AS unique_sample_ids
FROM d GROUP BY 1
"""

QUERIES = {"run_rollup": q_run_rollup, "prefer_exported": q_prefer_exported, "method_audit": q_method_audit,
           "export_counters": q_export_counters}
ORACLES = {"run_rollup": SQL_RUN_ROLLUP, "prefer_exported": SQL_PREFER_EXPORTED, "method_audit": SQL_METHOD_AUDIT,
           "export_counters": SQL_EXPORT_COUNTERS}
