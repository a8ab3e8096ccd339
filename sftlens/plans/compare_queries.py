"""Comparison queries (A6, C1-C6) over ``documents``.

Stand-in: every ``lang`` value is a model; its pooled token statistics come from
:func:`token_stats` on ``documents`` (whitespace counts), and its run
configuration is a row of ``RUN_CONFIGS`` (left-joined: a model without one has
no configuration and is not complete).  Expected samples are all documents; the
runs have faults: ``de`` lacks the documents with id % 29 = 3, ``fr`` has blank
outputs where id % 31 = 4, and ``es`` reuses one sample id where id % 37 = 5.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sql_ws_token_count, whitespace_token_count
from ..operators.compare import MATRIX_METRICS, comparison_matrix, generation_complete, pair_runs, tokens_per_s
from ..operators.stats import token_stats
from ..session import materialize
from ..sources.catalog import TASK_CATALOG
from .common import generations, table
from .stats_queries import sql_percentile

# The comparisons requested (model_a, model_b).
PAIRS = [("en", "fr"), ("en", "de"), ("en", "es"), ("de", "fr"), ("es", "fr"), ("de", "es")]
# Per-model run configuration: model, status, fallback level, batched tokens, max seqs,
# memory fraction, prefix caching, chunked prefill, dtype, vllm / lm-eval versions,
# successful-attempt seconds, peak memory MiB, max_gen_toks, max_model_len.
RUN_CONFIGS = [
    ("en", "complete", 1, 8192, 32, 0.90, True, True, "bfloat16", "0.6.6.post1", "0.4.5", 1800, 42120, 32768, 40960),
    ("fr", "complete", 1, 8192, 32, 0.9000000001, True, True, "bfloat16", "0.6.6.post1", "0.4.5", 300, 41000,
     32768, 40960),
    ("de", "complete", 2, 4096, 16, 0.90, True, True, "bfloat16", "0.6.6.post1", "0.4.5", 0, 39000, 32768, 40960),
    ("es", "failed", 3, 2048, 8, 0.88, True, True, "bfloat16", "0.6.6.post1", "0.4.5", 900, 30000, 32768, 40960),
]
CONFIG_SCHEMA = ("model_name string, status string, fallback_level int, max_num_batched_tokens int, "
                 "max_num_seqs int, gpu_memory_utilization double, enable_prefix_caching boolean, "
                 "enable_chunked_prefill boolean, dtype string, vllm_version string, lm_eval_version string, "
                 "successful_attempt_wall_time bigint, gpu_peak_memory_mib bigint, max_gen_toks int, "
                 "max_model_len int")


def run_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = generations(spark, sf_dir)
    m, i = F.col("model"), F.col("doc_id")
    g = g.where(~((m == "de") & (i % 29 == 3)))
    g = g.withColumn("output", F.when((m == "fr") & (i % 31 == 4), "").otherwise(F.col("output")))
    return g.withColumn("tokens", whitespace_token_count("output")).withColumn(
        "sample_id", F.when((m == "es") & (i % 37 == 5), "again").otherwise(F.col("sample_id")))


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = run_generations(spark, sf_dir)
    st = token_stats(g, "model", "task", "tokens", "output", "sample_id").where(F.col("level") == "overall")
    expected = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("model")).agg(F.count(F.lit(1)).alias("total_expected_samples"))
    cfg = spark.createDataFrame(RUN_CONFIGS, CONFIG_SCHEMA)
    s = (st.join(expected, "model").withColumnRenamed("model", "model_name").join(cfg, "model_name", "left")
           .withColumnRenamed("actual_samples", "total_actual_samples"))
    s = s.withColumn("tokens_per_s", tokens_per_s(F.col("total_output_tokens"), F.col("successful_attempt_wall_time")))
    return s.withColumn("generation_complete", generation_complete(
        F.col("status"), F.col("total_actual_samples"), F.col("total_expected_samples"), F.col("empty_output_count")))


def q_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stats(spark, sf_dir).select("model_name", "total_output_tokens", "successful_attempt_wall_time",
                                           "tokens_per_s", "generation_complete")


def q_config_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame(PAIRS, "model_a string, model_b string")
    # one row per model: written once, read by both sides
    return pair_runs(materialize(run_stats(spark, sf_dir), "run-stats"), pairs)


def q_compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one row per model: written once, read by the matrix and by the pair verdicts
    return _matrix(spark, materialize(run_stats(spark, sf_dir), "run-stats"))


def _matrix(spark: SparkSession, s: DataFrame) -> DataFrame:
    # The two comparability rows describe the first requested pair (en, fr).
    pair = pair_runs(s, spark.createDataFrame(PAIRS[:1], "model_a string, model_b string"))
    return comparison_matrix(s, run_names(s), pair=pair)


def run_names(stats: DataFrame) -> list[str]:
    """The compared runs, which become columns of the matrix (one row each)."""
    return sorted(r.model_name for r in stats.select("model_name").distinct().collect())


_CFG_VALUES = ", ".join(
    "('%s', '%s', %d, %d, %d, %r, %s, %s, '%s', '%s', '%s', %d, %d, %d, %d)" % (
        c[0], c[1], c[2], c[3], c[4], c[5], str(c[6]).lower(), str(c[7]).lower(), c[8], c[9], c[10], c[11],
        c[12], c[13], c[14]) for c in RUN_CONFIGS)

_STATS_SQL = f"""
WITH cfg(model_name, status, fallback_level, max_num_batched_tokens, max_num_seqs, gpu_memory_utilization,
         enable_prefix_caching, enable_chunked_prefill, dtype, vllm_version, lm_eval_version,
         successful_attempt_wall_time, gpu_peak_memory_mib, max_gen_toks, max_model_len) AS (VALUES {_CFG_VALUES}),
ex AS (SELECT lang AS model_name, count(*) AS total_expected_samples FROM documents GROUP BY 1),
o AS (SELECT lang AS model, source, doc_id, CASE WHEN lang = 'fr' AND doc_id % 31 = 4 THEN '' ELSE text END AS text,
        CASE WHEN lang = 'es' AND doc_id % 37 = 5 THEN 'again' ELSE CAST(doc_id AS VARCHAR) END AS k
      FROM documents WHERE NOT (lang = 'de' AND doc_id % 29 = 3)),
g AS (SELECT model, {sql_ws_token_count('text')} AS tokens, text FROM o),
du AS (SELECT model AS model_name, CAST(sum(c - 1) AS BIGINT) AS duplicate_count
       FROM (SELECT model, source, k, count(*) AS c FROM o GROUP BY 1, 2, 3) GROUP BY 1),
st AS (SELECT model AS model_name, count(*) AS total_actual_samples,
         count(*) FILTER (WHERE trim(text) = '') AS empty_output_count,
         CAST(sum(tokens) AS BIGINT) AS total_output_tokens, list_sort(list(tokens)) AS sl, max(tokens) AS max_output_tokens,
         count(*) FILTER (WHERE tokens >= 32760) AS possibly_truncated_count
       FROM g GROUP BY 1),
s AS (
  SELECT st.*, ex.total_expected_samples, du.duplicate_count, cfg.*  EXCLUDE (model_name),
    CASE WHEN successful_attempt_wall_time > 0
         THEN round_even(CAST(total_output_tokens AS DOUBLE) / successful_attempt_wall_time, 1) ELSE 0.0 END AS tokens_per_s,
    coalesce(status = 'complete' AND total_actual_samples = total_expected_samples AND empty_output_count = 0, false)
      AS generation_complete
  FROM st JOIN ex USING (model_name) JOIN du USING (model_name) LEFT JOIN cfg USING (model_name))
"""

SQL_THROUGHPUT = _STATS_SQL + """
SELECT model_name, total_output_tokens, CAST(successful_attempt_wall_time AS BIGINT) AS successful_attempt_wall_time,
  tokens_per_s, generation_complete FROM s
"""

_C1 = ("a.max_gen_toks IS NOT DISTINCT FROM b.max_gen_toks AND a.max_model_len IS NOT DISTINCT FROM b.max_model_len "
       "AND a.max_num_batched_tokens IS NOT DISTINCT FROM b.max_num_batched_tokens "
       "AND a.max_num_seqs IS NOT DISTINCT FROM b.max_num_seqs "
       "AND abs(coalesce(a.gpu_memory_utilization, 0) - coalesce(b.gpu_memory_utilization, 0)) <= 1e-6 "
       "AND a.enable_prefix_caching IS NOT DISTINCT FROM b.enable_prefix_caching "
       "AND a.enable_chunked_prefill IS NOT DISTINCT FROM b.enable_chunked_prefill "
       "AND a.dtype IS NOT DISTINCT FROM b.dtype AND a.vllm_version IS NOT DISTINCT FROM b.vllm_version "
       "AND a.lm_eval_version IS NOT DISTINCT FROM b.lm_eval_version")

SQL_CONFIG_COMPARABLE = _STATS_SQL + f"""
SELECT a.model_name AS model_a, b.model_name AS model_b, {_C1} AS config_comparable,
  coalesce(a.max_num_batched_tokens = b.max_num_batched_tokens AND a.max_num_seqs = b.max_num_seqs
           AND abs(a.gpu_memory_utilization - b.gpu_memory_utilization) < 1e-6
           AND a.enable_prefix_caching = b.enable_prefix_caching AND a.fallback_level = b.fallback_level, false)
    AS configs_equal,
  CAST(sign(a.fallback_level - b.fallback_level) AS INTEGER) AS conservativeness,
  ({_C1}) AND a.generation_complete AND b.generation_complete AS throughput_comparable
FROM (VALUES ('en', 'fr'), ('en', 'de'), ('en', 'es'), ('de', 'fr'), ('es', 'fr'), ('de', 'es')) p(x, y)
  JOIN s a ON a.model_name = p.x JOIN s b ON b.model_name = p.y
"""

_METRIC_EXPR = {
    "generation_complete": "CAST(generation_complete AS DOUBLE)",
    "total_expected_samples": "total_expected_samples", "total_actual_samples": "total_actual_samples",
    "empty_output_count": "empty_output_count", "duplicate_count": "duplicate_count", "total_output_tokens": "total_output_tokens",
    "avg_output_tokens": "round_even(CAST(total_output_tokens AS DOUBLE) / total_actual_samples, 1)",
    "p50": sql_percentile("sl", "total_actual_samples", 50), "p90": sql_percentile("sl", "total_actual_samples", 90),
    "p95": sql_percentile("sl", "total_actual_samples", 95), "max_output_tokens": "max_output_tokens",
    "possibly_truncated_count": "possibly_truncated_count",
    "successful_attempt_wall_time": "successful_attempt_wall_time", "tokens_per_s": "tokens_per_s",
    "gpu_peak_memory_mib": "gpu_peak_memory_mib", "fallback_level": "fallback_level",
    "enable_prefix_caching": "CAST(enable_prefix_caching AS DOUBLE)",
    "enable_chunked_prefill": "CAST(enable_chunked_prefill AS DOUBLE)",
    "config_comparable": "(SELECT CAST(" + _C1 + " AS DOUBLE) FROM s a, s b WHERE a.model_name = 'en' AND b.model_name = 'fr')",
    "throughput_comparable": "(SELECT CAST((" + _C1 + ") AND a.generation_complete AND b.generation_complete AS DOUBLE) "
                             "FROM s a, s b WHERE a.model_name = 'en' AND b.model_name = 'fr')",
}

SQL_COMPARE_MODELS = _STATS_SQL + ",\nlong AS (\n" + "\n  UNION ALL ".join(
    f"SELECT '{m}' AS metric, model_name, CAST({_METRIC_EXPR[m]} AS DOUBLE) AS value FROM s" for m in MATRIX_METRICS) + """)
SELECT metric,
  max(value) FILTER (WHERE model_name = 'en') AS en, max(value) FILTER (WHERE model_name = 'fr') AS fr,
  max(value) FILTER (WHERE model_name = 'de') AS de, max(value) FILTER (WHERE model_name = 'es') AS es
FROM long GROUP BY metric
"""

QUERIES = {"throughput": q_throughput, "config_comparable": q_config_comparable, "compare_models": q_compare_models}
ORACLES = {"throughput": SQL_THROUGHPUT, "config_comparable": SQL_CONFIG_COMPARABLE,
           "compare_models": SQL_COMPARE_MODELS}


def q_comparison_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK3: write the matrix as JSON, CSV and Markdown, then read the CSV back."""
    from ..session import scratch_dir
    from ..sinks.writers import write_comparison

    out = scratch_dir(spark, "comparison")
    s = materialize(run_stats(spark, sf_dir), "run-stats")
    matrix = _matrix(spark, s)
    models = [c for c in matrix.columns if c != "metric"]
    write_comparison(matrix, out, models, s)
    schema = "metric string, " + ", ".join(f"{m} double" for m in models)
    return spark.read.schema(schema).option("header", "true").csv(f"{out}/csv")


def q_output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK4: the export name of every (model, task) group of ``documents`` and its size, with
    and without a limit.  Models take names of every kind from ``lang``; three of four tasks
    are catalog tasks."""
    from ..sinks.writers import output_name

    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    model = F.col("lang")
    for lang, name in OUTPUT_MODELS:
        model = F.when(F.col("lang") == lang, name).otherwise(model)
    task = F.col("source")
    for k, (name, *_) in enumerate(TASK_CATALOG):
        task = F.when(F.col("doc_id") % 4 == k, name).otherwise(task)
    g = d.groupBy(model.alias("model"), task.alias("task")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("model", "task", output_name(F.col("model"), F.col("task")).alias("name"),
                    output_name(F.col("model"), F.col("task"), limit=20).alias("smoke_name"), F.col("n").cast("bigint").alias("n"))


# lang -> model name: a path with LIMO, one with OpenR1, lower-case limo, and a plain name.
OUTPUT_MODELS = [("en", "GAIR/LIMO-7B"), ("fr", "open-r1/OpenR1-Qwen"), ("de", "my_limo_v2"), ("es", "Meta Llama 3.1-8B")]


SQL_OUTPUT_NAMES = """
WITH d AS (
  SELECT CASE lang WHEN 'en' THEN 'GAIR/LIMO-7B' WHEN 'fr' THEN 'open-r1/OpenR1-Qwen' WHEN 'de' THEN 'my_limo_v2'
                   WHEN 'es' THEN 'Meta Llama 3.1-8B' ELSE lang END AS lang,
    CASE doc_id % 4 WHEN 0 THEN 'local_math500_32k' WHEN 1 THEN 'local_aime24_32k' WHEN 2 THEN 'local_aime25_32k'
                    ELSE source END AS source
  FROM documents),
n AS (
SELECT lang AS model, source AS task,
  CASE WHEN contains(lang, 'LIMO') OR contains(lang, 'limo') THEN 'limo'
       WHEN contains(lang, 'OpenR1') OR contains(lang, 'openr1') THEN 'openr1'
       ELSE regexp_replace(lower(lang), '[^a-z0-9]', '', 'g') END || '_' ||
  CASE WHEN contains(source, 'math500') THEN 'math500' WHEN contains(source, 'aime24') THEN 'aime24'
       WHEN contains(source, 'aime25') THEN 'aime25' ELSE source END AS name,
  CAST(count(*) AS BIGINT) AS n
FROM d GROUP BY 1, 2)
SELECT model, task, name, name || '_smoke20' AS smoke_name, n FROM n
"""

QUERIES["comparison_files"] = q_comparison_files
QUERIES["output_names"] = q_output_names
ORACLES["comparison_files"] = SQL_COMPARE_MODELS
ORACLES["output_names"] = SQL_OUTPUT_NAMES
