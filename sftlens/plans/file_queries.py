"""Queries over trees of one file per document (SC3, SC4, SC8, V1, V4, V6).

Stand-in: every document is one sample file ``<model>/<task>/<doc_id>.jsonl`` (``lang`` and ``source``), written by the tasks
of one Spark job.  By ``doc_id % 10``: 3 was never written, 7 has no bytes, 5 is not named by its manifest; all
others hold one sample, whose output is ``>`` and the document's text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import judge_completion
from ..operators.validate import validate_samples
from ..session import scratch_dir
from ..sinks.writers import write_files
from ..sources.filestatus import list_tree, named_lengths, path_status
from ..sources.jsonl import parse_jsonl, read_json_documents, read_named_lines
from ..sources.manifests import active_runs, discover_first, scan_json_tree, task_manifests_of
from .common import table

_BUILT: dict[tuple, str] = {}


def sample_tree(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """(root, manifests ``sample, path``); the tree is written once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "lang", "source", "doc_id").alias("sample"))
    if key not in _BUILT:
        root = scratch_dir(spark, "sample-tree")
        line = F.to_json(F.struct("doc_id", F.lit("p").alias("prompt"), F.array(F.concat(F.lit(">"), F.coalesce("text", F.lit("")))).alias("resps")))
        write_files(d.where("doc_id % 10 <> 3").select(
            F.concat(F.lit(f"{root}/"), "sample", F.lit(".jsonl")).alias("path"),
            F.when(F.col("doc_id") % 10 != 7, F.concat(line, F.lit("\n"))).alias("content")))
        _BUILT[key] = root
    root = _BUILT[key]
    named = F.when(F.col("doc_id") % 10 != 5, F.concat(F.lit(f"{root}/"), "sample", F.lit(".jsonl")))
    return root, d.select("sample", named.alias("path"))


def q_file_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 with its file rule: every named file is asked for by the tasks, then its lines are validated."""
    root, manifests = sample_tree(spark, sf_dir)
    sample = F.substring("file", len(root) + 2, 10_000)
    named = manifests.where(F.substring("path", len(root) + 2, 10_000).rlike(r"^[^/]+/[^/]+/[^/]+\.jsonl$"))  # <model>/<task>/<sample>.jsonl; unnamed files are not read
    parsed = parse_jsonl(read_named_lines(named), on_error="collect").withColumn("sample", F.regexp_replace(sample, r"\.jsonl$", ""))
    expected = manifests.withColumn("expected", F.lit(1))
    errors = validate_samples(parsed, expected.drop("path"), scope=("sample",), files=manifests)
    return errors.select("sample", "code")


def q_tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing itself, by model and task: files, files without bytes, bytes, and what the folder stands for."""
    root, _ = sample_tree(spark, sf_dir)
    tree = list_tree(spark, root, depth=2)
    rel = F.split(F.substring("folder", len(root) + 2, 10_000), "/")
    per = (tree.where("is_file").select(F.element_at(rel, 1).alias("model"), F.element_at(rel, 2).alias("task"), "folder", "length")
           .groupBy("model", "task", "folder").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("length") == 0).alias("empty_files"), F.sum("length").alias("bytes")))
    whole = named_lengths(tree).select(F.col("path").alias("folder"), F.col("length").alias("folder_bytes"))
    return per.join(whole, "folder").select("model", "task", "files", "empty_files", "bytes", "folder_bytes")


def q_first_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC8 with several patterns over files per (model, task), files without bytes included.

    By the task's number ``k``: ``results_<task>_b.json`` in folder ``z`` always, ``results_<task>_a.json`` in folder ``m``
    if ``k % 2 = 0`` (no bytes), ``<task>/summary.json`` in folder ``a`` if ``k % 3 = 0``; nothing if ``k % 5 = 4``.
    """
    root = scratch_dir(spark, "results-tree")
    tasks = table(spark, sf_dir, "documents").select(F.concat_ws("-", "lang", "source").alias("task"), F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("k")).distinct()
    forms = F.array(F.concat(F.lit("z/results_"), "task", F.lit("_b.json")),
                    F.when(F.col("k") % 2 == 0, F.concat(F.lit("m/results_"), "task", F.lit("_a.json"))),
                    F.when(F.col("k") % 3 == 0, F.concat(F.lit("a/"), "task", F.lit("/summary.json"))))
    files = tasks.where("k % 5 <> 4").select("task", F.explode(F.array_compact(forms)).alias("name"))
    write_files(files.select(F.concat(F.lit(f"{root}/"), "name").alias("path"),
                             F.when(~F.col("name").startswith("m/"), F.concat(F.lit('{"task": "'), "task", F.lit('"}'))).alias("content")))
    tree = list_tree(spark, root).where("is_file")
    first = discover_first(tree, tasks, ["results_{task}_*.json", "{task}/summary.json"])
    sizes = path_status(first)
    return first.join(sizes, "path", "left").select("task", F.substring("path", len(root) + 2, 10_000).alias("path"), "length")


def q_active_runs_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC3 + SC4 over one JSON file per manifest, as the layout of ``sources.manifests`` has it.

    Per model, runs ``r1`` and ``r2`` with a manifest per task, and a pointer to ``r2``: none for ``es``, to the
    missing ``r3`` for ``de``, and without an id for ``fr``; a task manifest whose number is divisible by 4 does not parse.
    """
    root = scratch_dir(spark, "run-tree")
    pairs = table(spark, sf_dir, "documents").select(F.col("lang").alias("model"), F.col("source").alias("task")).distinct()
    pairs = pairs.withColumn("run", F.explode(F.array(F.lit("r1"), F.lit("r2"))))
    k = F.regexp_extract("task", r"(\d+)$", 1).cast("int")
    base = F.concat(F.lit(f"{root}/"), F.col("model"))
    run = F.concat(base, F.lit("/runs/"), "run")
    tm = pairs.select(F.concat(run, F.lit("/tasks/"), "task", F.lit("/task_manifest.json")).alias("path"),
                      F.when(k % 4 == 0, F.lit('{"status": ')).otherwise(F.to_json(F.struct("task", F.lit("complete").alias("status")))).alias("content"))
    rm = pairs.select(F.concat(run, F.lit("/run_manifest.json")).alias("path"), F.to_json(F.struct("run")).alias("content")).distinct()
    active = F.when(F.col("model") == "de", "r3").when(F.col("model") != "fr", "r2")
    ptr = pairs.select("model").distinct().where("model <> 'es'").select(
        F.concat(base, F.lit("/active_run.json")).alias("path"), F.to_json(F.struct(active.alias("active_run_id"))).alias("content"))
    write_files(tm.unionByName(rm).unionByName(ptr).repartition("path"))
    tree = scan_json_tree(spark, [root]).withColumn("model", F.regexp_extract("root", r"([^/]+)$", 1)).drop("root").withColumnRenamed("model", "root")
    runs = active_runs(tree, pairs.select(F.col("model").alias("root")).distinct())
    n = task_manifests_of(tree, runs).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return runs.join(n, "root", "left").select(F.col("root").alias("model"), "run_id", F.col("error").isNotNull().alias("is_error"),
                                               F.coalesce("n", F.lit(0)).alias("n_task_manifests"))


def q_completion_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6 with a faulty task for every rule, over files that tasks list and read (SC8).

    A task is a (model, source) pair; its number plus the code of the model's first letter, modulo 8, is its fault: 0 no results
    file, 1 results that do not parse, 2 no sample file, 3 blank outputs, 4 another ``max_gen_toks``, 5 a shorter ``max_model_len``,
    6 a failed export, 7 none.
    """
    root = scratch_dir(spark, "completion-tree")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.concat_ws("-", "lang", "source").alias("task"),
                                                 ((F.regexp_extract("source", r"(\d+)$", 1).cast("int") + F.ascii("lang")) % 8).alias("f"))
    tasks, f = d.select("task", "f").distinct(), F.col("f")
    results = tasks.where("f <> 0").select(F.concat(F.lit(f"{root}/out/results_"), "task", F.lit("_1.json")).alias("path"), F.when(f == 1, "{ cut").otherwise("{}").alias("content"))
    samples = tasks.where("f <> 2").select(F.concat(F.lit(f"{root}/out/"), "task", F.lit("/samples.jsonl")).alias("path"), F.lit("listed only").alias("content"))
    write_files(results.unionByName(samples))
    tree = list_tree(spark, root).where("is_file")
    first = discover_first(tree, tasks, ["results_{task}_*.json"])
    parsed = read_json_documents(spark, f"{root}/out/results_*.json").select(
        F.regexp_extract("file", r"([^/]+)$", 1).alias("name"), F.col("v").isNotNull().alias("parses"))
    results = first.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).join(parsed, "name", "left").select("task", "path", "parses")
    found = discover_first(tree, tasks, ["{task}/samples.jsonl"]).withColumnRenamed("path", "sample_file")
    line = F.to_json(F.struct("doc_id", F.lit("p").alias("prompt"), F.array(F.when(f == 3, " ").otherwise(F.col("n_chars").cast("string"))).alias("resps")))
    lines = parse_jsonl(d.select("task", F.col("doc_id").alias("line"), line.alias("text")), on_error="collect")
    expected = d.groupBy("task").agg(F.count(F.lit(1)).alias("expected"))
    judged = judge_completion(
        tasks.join(found, "task", "left").withColumns({"max_gen_toks": F.when(f == 4, 4096).otherwise(32768), "max_model_len": F.when(f == 5, 16384).otherwise(40960)}),
        validate_samples(lines, expected), results, tasks.where(f == 6).select("task", F.lit("no rows").alias("error")))
    return judged.select("task", "status", F.array_join("completion_errors", "; ").alias("errors"))


SQL_FILE_AUDIT = """
WITH d AS (SELECT lang || '/' || source || '/' || doc_id AS sample, doc_id % 10 AS k FROM documents)
SELECT sample, CASE k WHEN 3 THEN 'file_not_found' WHEN 5 THEN 'file_missing' ELSE 'file_empty' END AS code FROM d WHERE k IN (3, 5, 7)
UNION ALL SELECT sample, 'count_mismatch' FROM d WHERE k IN (3, 5, 7)
"""

SQL_TREE_LISTING = """
WITH d AS (SELECT lang AS model, source AS task, CASE WHEN doc_id % 10 = 7 THEN 0 ELSE
             octet_length(encode(to_json({'doc_id': doc_id, 'prompt': 'p', 'resps': ['>' || coalesce(text, '')]}))) + 1 END AS bytes
           FROM documents WHERE doc_id % 10 <> 3)
SELECT model, task, count(*) AS files, count(*) FILTER (WHERE bytes = 0) AS empty_files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(bytes) AS BIGINT) AS folder_bytes
FROM d GROUP BY 1, 2
"""

SQL_FIRST_RESULTS = """
WITH t AS (SELECT DISTINCT lang || '-' || source AS task, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS k FROM documents),
f AS (SELECT task, CASE WHEN k % 5 = 4 THEN NULL WHEN k % 3 = 0 THEN 'a/' || task || '/summary.json'
                        WHEN k % 2 = 0 THEN 'm/results_' || task || '_a.json' ELSE 'z/results_' || task || '_b.json' END AS path FROM t)
SELECT task, path, CASE WHEN path LIKE 'm/%' THEN 0 WHEN path IS NOT NULL THEN strlen(task) + 12 END AS length FROM f
"""

SQL_ACTIVE_RUNS_FILES = """
SELECT lang AS model, CASE lang WHEN 'es' THEN NULL WHEN 'fr' THEN NULL WHEN 'de' THEN 'r3' ELSE 'r2' END AS run_id, lang IN ('es', 'fr', 'de') AS is_error,
  CASE WHEN lang IN ('es', 'fr', 'de') THEN 0 ELSE count(DISTINCT source) FILTER (WHERE CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 4 <> 0) END AS n_task_manifests
FROM documents GROUP BY lang
"""

SQL_COMPLETION_RULES = """
SELECT lang || '-' || source AS task, CASE f WHEN 7 THEN 'complete' ELSE 'incomplete' END AS status,
  CASE f WHEN 0 THEN 'results file not found' WHEN 1 THEN 'results file does not parse' WHEN 2 THEN 'sample file not found' WHEN 3 THEN 'sample validation: empty_output'
         WHEN 4 THEN 'max_gen_toks is not the required one' WHEN 5 THEN 'max_model_len is below max_gen_toks' WHEN 6 THEN 'export failed: no rows' ELSE '' END AS errors
FROM (SELECT DISTINCT lang, source, (CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) + ascii(lang)) % 8 AS f FROM documents)
"""

QUERIES = {"completion_rules": q_completion_rules, "file_audit": q_file_audit, "tree_listing": q_tree_listing, "first_results": q_first_results, "active_runs_files": q_active_runs_files}
ORACLES = {"completion_rules": SQL_COMPLETION_RULES, "file_audit": SQL_FILE_AUDIT, "tree_listing": SQL_TREE_LISTING, "first_results": SQL_FIRST_RESULTS, "active_runs_files": SQL_ACTIVE_RUNS_FILES}
