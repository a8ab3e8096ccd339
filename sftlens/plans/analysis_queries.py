"""Run analysis and resume decisions over result trees derived from ``documents`` (A1, A4, C4, J4, J5, SC3).

``analyze_runs``: every ``lang`` is a result root with one run ``r1`` whose tasks are its
sources.  The tree (pointer, run manifest, task manifests) and the files are written by Spark: a folder of raw
samples per task, and a folder of exported records for the tasks whose number is no multiple of 3.  Faults:
``es`` has no pointer, ``de`` an unreadable run manifest, ``fr`` status ``incomplete`` and blank outputs where
id % 41 = 7; id % 11 = 5 writes a corrupt line; id % 13 = 4 repeats a key (one sample id, one doc id); id % 17 = 3
exports a token count that is no number, id % 17 = 5 one that is a text with a fraction, id % 17 = 6 one as a text; id % 19 = 2 counts its
tokens by another method.  ``en`` has a generation cap of 600 tokens.

``resume_reasons``: every (lang, source) pair is a task; ``(number of the source + rank of the lang) % 9``
picks the fault, one for each reason and none for 8.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sql_ws_token_count
from ..operators.analysis import analyze_runs, resume_reasons, run_warnings
from ..operators.validate import validate_export_file, validate_samples
from ..session import scratch_dir
from ..sources.jsonl import parse_jsonl, read_lines
from ..sources.manifests import active_runs, list_files, scan_partitioned_tree, task_manifests_of
from .common import json_string_literal, table
from .stats_queries import sql_percentile

ELAPSED = 1800
CAP = 600


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", F.col("lang").alias("root"), F.col("source").alias("task"))
    return d.withColumn("k", F.regexp_extract("task", r"(\d+)$", 1).cast("int"))


def _write_files(d: DataFrame, base: str) -> None:
    i = F.col("doc_id")
    blank = (F.col("root") == "fr") & (i % 41 == 7)
    text = F.when(blank, F.lit('""')).otherwise(json_string_literal(F.col("text")))
    again = i % 13 == 4
    sample = F.concat(F.lit('{"doc_id":'), F.when(again, F.lit("1")).otherwise(i.cast("string")), F.lit(',"resps":[['), text, F.lit("]]}"))
    chars = (F.col("n_chars") % 1000).cast("string")
    count = (F.when(i % 17 == 3, F.lit('"n/a"')).when(i % 17 == 5, F.concat(F.lit('"'), chars, F.lit('.7"')))
             .when(i % 17 == 6, F.concat(F.lit('" '), chars, F.lit('"'))).otherwise(chars))
    method = F.when(i % 19 == 2, F.lit('"split_estimate"')).when(i % 19 == 5, "null").when(i % 19 == 7, F.lit('""')).otherwise(F.lit('"llama_tokenizer"'))
    sid = F.when(again, F.lit('"again"')).when(i % 13 == 6, F.lit("null")).otherwise(F.concat(F.lit('"s'), i.cast("string"), F.lit('"')))
    export = F.concat(F.lit('{"sample_id":'), sid, F.lit(',"doc_id":'), i.cast("string"), F.lit(',"raw_output":'), text,
                      F.lit(',"output_token_count":'), count, F.lit(',"output_token_count_method":'), method, F.lit("}"))
    lines = d.select("root", "task", F.explode(F.array(
        F.struct(F.lit("samples").alias("kind"), sample.alias("value")),
        F.struct(F.when(F.col("k") % 3 != 0, "export").alias("kind"), export.alias("value")))).alias("x"), "doc_id") \
        .where("x.kind is not null").select("root", "task", "x.kind", F.when(i % 11 == 5, "{ corrupt").otherwise(F.col("x.value")).alias("value"))
    lines.repartition("root", "task", "kind").write.partitionBy("root", "task", "kind").text(f"{base}/files")


def _write_tree(d: DataFrame, base: str) -> None:
    folder = lambda kind: F.concat(F.lit(f"{base}/files/root="), F.col("root"), F.lit("/task="), F.col("task"), F.lit(f"/kind={kind}"))
    groups = d.groupBy("root", "task").agg(F.count_if(F.col("doc_id") % 11 != 5).alias("n"))
    runs = groups.groupBy("root").agg(  # one entry per task of a run
        F.sort_array(F.collect_list("task")).alias("tasks"), F.map_from_entries(F.collect_list(F.struct("task", "n"))).alias("expected_sample_counts"),
        F.map_from_entries(F.collect_list(F.struct("task", folder("export")))).alias("exported_generation_files"))
    manifest = F.to_json(F.struct(
        F.concat(F.lit("model-"), F.col("root")).alias("model_name"), F.when(F.col("root") == "fr", "incomplete").otherwise("complete").alias("status"),
        F.when(F.col("root") == "en", CAP).otherwise(32768).alias("max_gen_toks"), F.lit(40960).alias("max_model_len"),
        F.when(F.col("root") == "fr", 0).otherwise(ELAPSED).alias("successful_attempt_elapsed_seconds"), "tasks", "expected_sample_counts",
        "exported_generation_files"))
    none = F.lit(None).cast("string")
    rm = runs.select(F.lit("run_manifest").alias("kind"), F.when(F.col("root") == "de", "{ not json").otherwise(manifest).alias("doc"),
                     "root", F.lit("r1").alias("run_id"), none.alias("task"))
    tm = groups.select(F.lit("task_manifest").alias("kind"), F.to_json(F.struct("task", folder("samples").alias("lm_eval_sample_file"))).alias("doc"),
                       "root", F.lit("r1").alias("run_id"), "task")
    pointer = runs.where("root <> 'es'").select(F.lit("pointer").alias("kind"), F.lit('{"active_run_id":"r1"}').alias("doc"), "root",
                                                none.alias("run_id"), none.alias("task"))
    rm.unionByName(tm).unionByName(pointer).write.partitionBy("root", "run_id", "task").json(f"{base}/tree")


def _run_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Active runs, their task manifests, the listed files and the parsed rows of all files."""
    base = scratch_dir(spark, "analysis")
    d = _docs(spark, sf_dir)
    _write_files(d, base)
    _write_tree(d, base)
    tree = scan_partitioned_tree(spark, f"{base}/tree")
    runs = active_runs(tree, d.select("root").distinct())
    # a folder stands for the one file that a run writes; manifests name it as written
    folder = F.concat(F.lit(f"{base}/files"), F.regexp_extract("path", r"/files(/root=[^/]+/task=[^/]+/kind=[^/]+)/[^/]*$", 1))
    listing = list_files(spark, [f"{base}/files"], "*.txt").select(folder.alias("path")).distinct()
    rows = parse_jsonl(read_lines(spark, [f"{base}/files/*/*/*/*.txt"]), on_error="drop")
    return runs, task_manifests_of(tree, runs), listing, rows.withColumnRenamed("file", "path").select(folder.alias("file"), "line", "v")


def q_analyze_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analyze_runs(*_run_inputs(spark, sf_dir))
    exports = F.size(F.filter("task_stats", lambda t: t["token_source"] == "exported_generation_file"))
    return out.select("root", "model_name", F.col("error").isNotNull().alias("is_error"), "manifest_status", "total_expected_samples", "total_actual_samples",
                      "empty_output_count", "duplicate_count", "total_output_tokens", "p50", "p95", "max_output_tokens", "possibly_truncated_count",
                      "tokens_per_s", "generation_complete", F.coalesce(F.when(F.col("task_stats").isNotNull(), exports), F.lit(0)).cast("bigint").alias("n_exports"))


def q_run_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warnings of each task (files number their own lines), with the task's position in its run."""
    w = run_warnings(*_run_inputs(spark, sf_dir))
    plain = F.regexp_replace("warning", "^line [0-9]+: ", "")
    return w.groupBy("root", "position", "task", plain.alias("warning")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("line").alias("n_lines"))


SQL_RUN_WARNINGS = """
WITH t AS (SELECT lang AS root, source AS task, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS position FROM documents GROUP BY 1, 2)
SELECT root, CAST(position AS INTEGER) AS position, task, 'output_token_count_method=' || chr(39) || 'split_estimate' || chr(39) AS warning, count(*) AS n, count(*) AS n_lines
FROM documents d JOIN t ON d.lang = t.root AND d.source = t.task
WHERE doc_id % 19 = 2 AND doc_id % 11 <> 5 AND root NOT IN ('es', 'de') AND CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 3 <> 0
GROUP BY root, position, task
"""

SQL_ANALYZE_RUNS = f"""
WITH d AS (SELECT doc_id, n_chars, lang AS root, source AS task, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 3 <> 0 AS exported,
             CASE WHEN lang = 'fr' AND doc_id % 41 = 7 THEN '' ELSE text END AS text,
             CASE WHEN doc_id % 13 = 4 THEN CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 3 <> 0 THEN 'again' ELSE '1' END
                  ELSE CAST(doc_id AS VARCHAR) END AS k
           FROM documents),
r AS (SELECT * FROM d WHERE doc_id % 11 <> 5 AND root NOT IN ('es', 'de')),
t AS (SELECT *, CASE WHEN exported THEN CASE WHEN doc_id % 17 IN (3, 5) THEN 0 ELSE n_chars % 1000 END
                     WHEN text = '' THEN 0 ELSE {sql_ws_token_count('text')} END AS tokens FROM r),
du AS (SELECT root, sum(c - 1) AS dups FROM (SELECT root, task, k, count(*) AS c FROM r GROUP BY 1, 2, 3) GROUP BY 1),
st AS (SELECT root, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tot, count(*) FILTER (WHERE trim(text) = '') AS empty, list_sort(list(tokens)) AS sl,
         max(tokens) AS mx, count(*) FILTER (WHERE tokens >= CASE root WHEN 'en' THEN {CAP} ELSE 32768 END - 8) AS trunc,
         count(DISTINCT task) FILTER (WHERE exported) AS ex FROM t GROUP BY 1),
roots AS (SELECT DISTINCT root FROM d)
SELECT roots.root, CASE WHEN st.root IS NULL THEN roots.root ELSE 'model-' || roots.root END AS model_name, st.root IS NULL AS is_error,
  CASE WHEN st.root IS NULL THEN 'unknown' WHEN roots.root = 'fr' THEN 'incomplete' ELSE 'complete' END AS manifest_status,
  CAST(coalesce(n, 0) AS BIGINT) AS total_expected_samples, CAST(coalesce(n, 0) AS BIGINT) AS total_actual_samples,
  CAST(coalesce(empty, 0) AS BIGINT) AS empty_output_count, CAST(coalesce(dups, 0) AS BIGINT) AS duplicate_count,
  coalesce(tot, 0) AS total_output_tokens, coalesce({sql_percentile('sl', 'n', 50)}, 0) AS p50, coalesce({sql_percentile('sl', 'n', 95)}, 0) AS p95,
  CAST(coalesce(mx, 0) AS BIGINT) AS max_output_tokens, CAST(coalesce(trunc, 0) AS BIGINT) AS possibly_truncated_count,
  CASE WHEN st.root IS NULL OR roots.root = 'fr' THEN 0.0 ELSE round_even(CAST(tot AS DOUBLE) / {ELAPSED}, 1) END AS tokens_per_s,
  st.root IS NOT NULL AND roots.root <> 'fr' AND empty = 0 AS generation_complete, CAST(coalesce(ex, 0) AS BIGINT) AS n_exports
FROM roots LEFT JOIN st ON roots.root = st.root LEFT JOIN du ON roots.root = du.root
"""

LANG_RANK = {"en": 0, "fr": 1, "de": 2, "es": 3}
REASONS = ("manifest_parse_error", "not_complete", "config_mismatch", "sample_missing", "sample_validation_failed", "export_missing",
           "export_validation_failed", "export_not_complete")


def q_resume_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rank = F.lit(4)
    for lang, r in LANG_RANK.items():
        rank = F.when(F.col("lang") == lang, r).otherwise(rank)
    d = d.select("doc_id", "n_chars", F.concat_ws("/", "lang", "source").alias("task"),
                 ((F.regexp_extract("source", r"(\d+)$", 1).cast("int") + rank) % 9).alias("f"))
    f, i = F.col("f"), F.col("doc_id").cast("string")
    tasks = d.groupBy("task").agg(F.first("f").alias("f"), F.count(F.lit(1)).alias("n"))
    m = F.to_json(F.struct(
        F.when(f == 1, "running").otherwise("complete").alias("status"), F.lit(32768).alias("max_gen_toks"),
        F.when(f == 2, 16384).otherwise(40960).alias("max_model_len"), F.concat(F.lit("/samples/"), "task").alias("lm_eval_sample_file"),
        F.concat(F.lit("/exports/"), "task").alias("exported_generation_file"), F.when(f == 7, "failed").otherwise("complete").alias("export_status")))
    manifests = tasks.select("task", F.try_parse_json(F.when(f == 0, "{").otherwise(m)).alias("m"))
    listing = tasks.where("f <> 3").select(F.concat(F.lit("/samples/"), "task").alias("path"), F.lit(9).cast("bigint").alias("length")).union(
        tasks.select(F.concat(F.lit("/exports/"), "task"), F.when(f == 5, 0).otherwise(9).cast("bigint")))
    expected = tasks.select("task", F.col("n").alias("expected"))
    sample = F.concat(F.lit('{"doc_id":'), i, F.lit(',"prompt":"p","resps":[["'), F.when(f == 4, " ").otherwise(F.col("n_chars").cast("string")), F.lit('"]]}'))
    record = F.to_json(F.struct(
        *[F.lit("x").alias(c) for c in ("benchmark", "question", "prompt", "raw_output", "prompt_hash", "output_hash")], F.col("task"),
        F.concat_ws(":", "task", i).alias("sample_id"), F.when(f == 6, "").otherwise("r").alias("run_id"), F.col("doc_id"), F.lit("g").alias("gold_answer"),
        F.lit(32768).alias("max_gen_toks"), F.lit(40960).alias("max_model_len"), F.lit(5).alias("output_token_count"),
        F.lit("llama_tokenizer").alias("output_token_count_method")))
    parse = lambda text: parse_jsonl(d.select("task", (F.col("doc_id") + 1).alias("line"), text.alias("text")), on_error="collect")
    return resume_reasons(manifests, validate_samples(parse(sample), expected), validate_export_file(parse(record), expected), listing)


SQL_RESUME_REASONS = """
WITH t AS (SELECT lang || '/' || source AS task, (CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER)
             + CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 ELSE 4 END) % 9 AS f
           FROM documents GROUP BY lang, source)
SELECT task, CASE f """ + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REASONS)) + " END AS reason FROM t"

QUERIES = {"analyze_runs": q_analyze_runs, "run_warnings": q_run_warnings, "resume_reasons": q_resume_reasons}
ORACLES = {"analyze_runs": SQL_ANALYZE_RUNS, "run_warnings": SQL_RUN_WARNINGS, "resume_reasons": SQL_RESUME_REASONS}
