"""Manifest validation queries (V4, V5) with SK1 exports on disk.

Stand-in: every (model = ``lang``, task = ``source``) group of ``documents``
is one task of run ``run_<lang>``.  Its exported samples are written with the
JSONL sink, partitioned by model and task, into a fresh folder under the
shared checkpoint folder; the task manifests and the per-model run manifests
are built by Spark from the data (counts, file maps) and name those outputs.

Faults by construction (``k`` = the number in ``src<k>``):
task manifests -- ``k % 5 = 0`` status ``running``; ``k % 7 = 3`` names a
file that does not exist; model ``es`` has ``max_model_len`` 16384;
``k % 6 = 1`` on model ``de`` reports one sample short.
Run manifests -- ``es`` status ``failed``; ``fr`` has ``predict_only`` as the
string ``"true"``; ``de`` has peak memory 0; the per-task rules see the missing
files and short counts above.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import validate_run_manifests, validate_task_manifests
from ..session import scratch_dir
from ..sinks.writers import write_jsonl
from ..sources.filestatus import path_status
from .common import table


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    base = scratch_dir(spark, "manifests")
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("model"), F.col("source").alias("task"),
                                                  "doc_id", F.concat_ws(":", "source", F.col("doc_id").cast("string"))
                                                  .alias("sample_id"))
    # SK1 per (model, task): one output folder per group
    write_jsonl(d.select("model", "task", "sample_id", "doc_id"), f"{base}/by_group", partition_by=("model", "task"))
    g = d.groupBy("model", "task").agg(F.count(F.lit(1)).alias("n"))
    k = F.regexp_extract("task", r"(\d+)$", 1).cast("int")
    g = g.withColumn("k", k).withColumn(
        "file", F.when(F.col("k") % 7 == 3, F.concat(F.lit(f"{base}/missing/"), F.col("task")))
                 .otherwise(F.concat(F.lit(f"{base}/by_group/model="), F.col("model"), F.lit("/task="), F.col("task"))))
    g = g.withColumn("actual", F.when((F.col("k") % 6 == 1) & (F.col("model") == "de"), F.col("n") - 1)
                     .otherwise(F.col("n")))
    return g, base


def q_validate_task_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _ = _groups(spark, sf_dir)
    m = F.to_json(F.struct(
        F.when(F.col("k") % 5 == 0, F.lit("running")).otherwise(F.lit("complete")).alias("status"),
        F.lit(32768).alias("max_gen_toks"),
        F.when(F.col("model") == "es", F.lit(16384)).otherwise(F.lit(40960)).alias("max_model_len"),
        F.lit("complete").alias("export_status"), F.col("file").alias("exported_generation_file"),
        F.col("n").alias("expected_sample_count"), F.col("actual").alias("actual_sample_count"),
        F.col("n").alias("exported_sample_count")))
    manifests = g.select(F.concat_ws("/", "model", "task").alias("task"), F.parse_json(m).alias("m"))
    listing = path_status(manifests.select(F.try_variant_get("m", "$.exported_generation_file", "string").alias("path")))
    errs = validate_task_manifests(manifests, listing)
    return errs.select("task", "code", F.when(~F.col("code").startswith("export_file"), F.col("detail")).alias("detail"))


def q_validate_run_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _ = _groups(spark, sf_dir)
    runs = g.groupBy("model").agg(
        F.sort_array(F.collect_list("task")).alias("tasks"),
        F.map_from_entries(F.collect_list(F.struct("task", "file"))).alias("exported_generation_files"),
        F.map_from_entries(F.collect_list(F.struct("task", "n"))).alias("expected_sample_counts"),
        F.map_from_entries(F.collect_list(F.struct("task", "actual"))).alias("actual_sample_counts"))
    mdl = F.col("model")
    m = F.to_json(F.struct(
        F.when(mdl == "es", F.lit("failed")).otherwise(F.lit("complete")).alias("status"),
        F.lit("generation_only").alias("evaluation_mode"),
        F.lit(True).alias("predict_only"), F.lit("pending_local").alias("judging_status"),
        F.lit(32768).alias("max_gen_toks"),
        F.when(mdl == "de", F.lit(0)).otherwise(F.lit(42120)).alias("gpu_peak_memory_mib"),
        F.lit(True).alias("enable_chunked_prefill"), "tasks", "exported_generation_files",
        "expected_sample_counts", "actual_sample_counts"))
    # fr records predict_only as a string, which the rule must reject
    m = F.when(mdl == "fr", F.regexp_replace(m, '"predict_only":true', '"predict_only":"true"')).otherwise(m)
    manifests = runs.select(F.concat(F.lit("run_"), mdl).alias("run_id"), F.parse_json(m).alias("m"))
    errs = validate_run_manifests(manifests, path_status(g, "file"))
    return errs.select("task", "code", F.when(~F.col("code").startswith("export_file"), F.col("detail")).alias("detail"))


_G_SQL = """
WITH g AS (
  SELECT lang AS model, source AS task, count(*) AS n, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS k
  FROM documents GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN k % 6 = 1 AND model = 'de' THEN n - 1 ELSE n END AS actual FROM g)
"""

SQL_VALIDATE_TASK_MANIFESTS = _G_SQL + """
SELECT model || '/' || task AS task, 'status' AS code, 'running' AS detail FROM f WHERE k % 5 = 0
UNION ALL SELECT model || '/' || task, 'short_max_model_len', NULL FROM f WHERE model = 'es'
UNION ALL SELECT model || '/' || task, 'actual_count', NULL FROM f WHERE actual <> n
UNION ALL SELECT model || '/' || task, 'export_file_not_found', NULL FROM f WHERE k % 7 = 3
"""

SQL_VALIDATE_RUN_MANIFESTS = _G_SQL + """
SELECT 'run_' || model AS task, 'status' AS code, 'failed' AS detail FROM (SELECT DISTINCT model FROM f) WHERE model = 'es'
UNION ALL SELECT 'run_fr', 'predict_only', NULL FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM f WHERE model = 'fr')
UNION ALL SELECT 'run_de', 'gpu_peak_memory', NULL FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM f WHERE model = 'de')
UNION ALL SELECT 'run_' || model || '/' || task, 'task_count',
  'actual=' || CAST(actual AS VARCHAR) || ', expected=' || CAST(n AS VARCHAR) FROM f WHERE actual <> n
UNION ALL SELECT 'run_' || model || '/' || task, 'export_file_not_found', NULL FROM f WHERE k % 7 = 3
"""

QUERIES = {"validate_task_manifests": q_validate_task_manifests, "validate_run_manifests": q_validate_run_manifests}
ORACLES = {"validate_task_manifests": SQL_VALIDATE_TASK_MANIFESTS,
           "validate_run_manifests": SQL_VALIDATE_RUN_MANIFESTS}


def q_judge_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6 + SC8 on the export stand-in's sample files.

    Samples of ``local_aime24_32k`` carry the validation faults; every other
    task's samples are clean.  A results file is written (one Spark output
    folder per task) for the tasks whose name has no ``5``; ``src3``'s export
    is reported as failed.  Output: ``task, status, n_errors``.
    """
    from ..operators.runs import judge_completion
    from ..operators.validate import validate_samples
    from ..sources.jsonl import parse_jsonl
    from ..sources.manifests import discover_first, list_files
    from .export_queries import sample_lines

    base = scratch_dir(spark, "completion")
    bad_task = "local_aime24_32k"
    lines = (sample_lines(spark, sf_dir, faults=True).where(F.col("task") == bad_task)
             .unionByName(sample_lines(spark, sf_dir).where(F.col("task") != bad_task)))
    errors = validate_samples(parse_jsonl(lines, on_error="collect"))
    tasks = lines.select("task").distinct()
    (lines.where(~F.col("task").contains("5")).groupBy("task").agg(F.count(F.lit(1)).alias("n"))
          .write.partitionBy("task").json(f"{base}/results"))
    results = discover_first(list_files(spark, [f"{base}/results"]), tasks,
                             ["task={task}/*.json", "results_{task}_*.json"])
    export_failures = tasks.where(F.col("task").endswith("3")).select(
        "task", F.lit("row count mismatch").alias("error"))
    judged = judge_completion(tasks, errors, results, export_failures)
    return judged.select("task", "status", F.size("completion_errors").cast("bigint").alias("n_errors"))


SQL_JUDGE_COMPLETION = """
WITH t AS (
  SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN 'local_math500_32k' WHEN 1 THEN 'local_aime24_32k'
                                  WHEN 2 THEN 'local_aime25_32k' ELSE source END AS task
  FROM documents),
e AS (
  SELECT task, (CASE WHEN task = 'local_aime24_32k' THEN 1 ELSE 0 END)
             + (CASE WHEN contains(task, '5') THEN 1 ELSE 0 END)
             + (CASE WHEN suffix(task, '3') THEN 1 ELSE 0 END) AS n_errors
  FROM t)
SELECT task, CASE WHEN n_errors = 0 THEN 'complete' ELSE 'incomplete' END AS status, CAST(n_errors AS BIGINT) AS n_errors
FROM e
"""

QUERIES["judge_completion"] = q_judge_completion
ORACLES["judge_completion"] = SQL_JUDGE_COMPLETION


def q_active_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC3 + SC4 over a result tree written by Spark.

    Per model (``lang``): run manifests ``r1`` and ``r2``, task manifests for
    each of its sources in both runs, and a pointer to ``r2`` -- except ``es``
    (no pointer) and ``de`` (pointer to ``r3``, which has no manifest).  Output:
    per model the active run, whether it is an error, and how many task
    manifests the active run contributes (other runs' are never read).
    """
    from ..sources.manifests import active_runs, scan_partitioned_tree, task_manifests_of

    base = scratch_dir(spark, "result-tree")
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("root"), F.col("source").alias("task"))
    pairs = d.distinct()
    runs = F.array(F.lit("r1"), F.lit("r2"))
    tm = pairs.select("root", F.explode(runs).alias("run_id"), "task").select(
        F.lit("task_manifest").alias("kind"),
        F.to_json(F.struct(F.col("task"), F.lit("complete").alias("status"))).alias("doc"), "root", "run_id", "task")
    rm = pairs.select("root").distinct().select("root", F.explode(runs).alias("run_id")).select(
        F.lit("run_manifest").alias("kind"), F.to_json(F.struct(F.col("run_id"))).alias("doc"), "root", "run_id",
        F.lit(None).cast("string").alias("task"))
    ptr = pairs.select("root").distinct().where(F.col("root") != "es").select(
        F.lit("pointer").alias("kind"),
        F.to_json(F.struct(F.when(F.col("root") == "de", F.lit("r3")).otherwise(F.lit("r2")).alias("active_run_id"),
                           F.lit("complete").alias("status"))).alias("doc"),
        "root", F.lit(None).cast("string").alias("run_id"), F.lit(None).cast("string").alias("task"))
    tm.unionByName(rm).unionByName(ptr).write.partitionBy("root", "run_id", "task").json(f"{base}/tree")
    tree = scan_partitioned_tree(spark, f"{base}/tree")
    roots = pairs.select("root").distinct()
    active = active_runs(tree, roots)
    n = task_manifests_of(tree, active).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return active.join(n, "root", "left").select(
        F.col("root").alias("model"), "run_id", F.col("error").isNotNull().alias("is_error"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_task_manifests"))


SQL_ACTIVE_RUNS = """
WITH m AS (SELECT lang AS model, count(DISTINCT source) AS n FROM documents GROUP BY 1)
SELECT model, CASE model WHEN 'es' THEN NULL WHEN 'de' THEN 'r3' ELSE 'r2' END AS run_id,
  model IN ('es', 'de') AS is_error,
  CAST(CASE WHEN model IN ('es', 'de') THEN 0 ELSE n END AS BIGINT) AS n_task_manifests
FROM m
"""

QUERIES["active_runs"] = q_active_runs
ORACLES["active_runs"] = SQL_ACTIVE_RUNS
