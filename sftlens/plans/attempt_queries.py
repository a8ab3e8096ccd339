"""Attempt and telemetry queries (P16, A7, L3, SC7, A11) over ``events``.

Stand-in: each event is a recorded inference attempt of task ``user_id``,
ordered by ``event_id``; ``exit_code`` is 0 for ``purchase`` and 1 otherwise;
``elapsed_seconds = floor(value)``.  Its log line depends on the event type:
``view`` -> a CUDA OOM message, ``signup`` -> the max-seq-len message (also
OOM), ``error`` -> a generic CUDA error (must *not* count as OOM), ``click`` ->
``Killed``, ``purchase`` -> ``done``.

Telemetry: each event is one sampler line ``ts, mem_used, 46068, user_id``
with ``mem_used = value``; ``error`` events write ``N/A`` (skipped).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.attempts import attempt_rollup, classify_attempts, first_success, parse_telemetry, peak, winning_config
from .common import table

# Stand-in log lines per event type.
LOG_LINES = {
    "view": "torch.cuda.OutOfMemoryError: CUDA out of memory. Tried to allocate 2.00 GiB",
    "signup": "ValueError: The model's max seq len (40960) is larger than the maximum number of tokens "
              "that can be stored in KV cache (30000)",
    "error": "RuntimeError: CUDA error: device-side assert triggered",
    "click": "Killed",
    "purchase": "done",
}
WINDOW = "1 hour"


def recorded_attempts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    attempts = e.select(F.col("user_id").alias("task"), F.col("event_id").alias("attempt"),
                        F.when(F.col("event_type") == "purchase", 0).otherwise(1).alias("exit_code"),
                        F.floor("value").cast("bigint").alias("elapsed_seconds"))
    line = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in LOG_LINES.items()], F.lit(""))
    logs = e.select(F.col("user_id").alias("task"), F.col("event_id").alias("attempt"), line.alias("log_line"))
    return attempts, logs


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts, logs = recorded_attempts(spark, sf_dir)
    return classify_attempts(attempts, logs)


def q_attempt_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classified(spark, sf_dir)
    return c.groupBy("task", "status").agg(F.count(F.lit(1)).alias("n"))


def q_attempt_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = attempt_rollup(classified(spark, sf_dir))
    return r.select("task", *[F.col(c).cast("bigint").alias(c) for c in r.columns if c != "task"])


def q_first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_success(classified(spark, sf_dir))


def q_ladder_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winning_config(first_success(classified(spark, sf_dir)))


def telemetry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    mem = F.when(F.col("event_type") == "error", F.lit("N/A")).otherwise(F.col("value").cast("string"))
    value = F.concat_ws(", ", F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), mem, F.lit("46068"),
                        F.col("user_id").cast("string"))
    return e.select("ts", F.col("user_id").alias("gpu"), value.alias("value"))


def q_telemetry_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peak(parse_telemetry(telemetry_lines(spark, sf_dir)), "mem_used", ["gpu"])


def q_telemetry_peak_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = parse_telemetry(telemetry_lines(spark, sf_dir))
    w = t.groupBy(F.window("ts", WINDOW).alias("w")).agg(F.max("mem_used").alias("peak"))
    return w.select(F.col("w.start").alias("window_start"), F.col("peak").cast("bigint").alias("peak"))


_ATT_SQL = """
WITH a AS (
  SELECT user_id AS task, event_id AS attempt, CAST(floor(value) AS BIGINT) AS elapsed_seconds,
    CASE WHEN event_type = 'purchase' THEN 'success' WHEN event_type IN ('view', 'signup') THEN 'oom'
         ELSE 'error' END AS status
  FROM events)
"""

SQL_ATTEMPT_STATUS = _ATT_SQL + "SELECT task, status, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY 1, 2"

SQL_ATTEMPT_ROLLUP = _ATT_SQL + """
SELECT task, CAST(count(*) AS BIGINT) AS attempts, CAST(sum(elapsed_seconds) AS BIGINT) AS pipeline_elapsed_seconds,
  CAST(coalesce(sum(elapsed_seconds) FILTER (WHERE status = 'success'), 0) AS BIGINT) AS successful_attempt_elapsed_seconds,
  CAST(coalesce(sum(elapsed_seconds) FILTER (WHERE status <> 'success'), 0) AS BIGINT) AS failed_attempt_elapsed_seconds
FROM a GROUP BY 1
"""

SQL_FIRST_SUCCESS = _ATT_SQL + """,
m AS (SELECT task, min(attempt) FILTER (WHERE status = 'success') AS ok,
             min(attempt) FILTER (WHERE status NOT IN ('success', 'oom')) AS hard FROM a GROUP BY 1),
c AS (SELECT m.task, ok, hard, count(*) FILTER (WHERE a.attempt <= ok) AS ok_pos,
             count(*) FILTER (WHERE a.attempt <= hard) AS hard_pos
      FROM a JOIN m ON a.task = m.task GROUP BY 1, 2, 3)
SELECT task,
  CASE WHEN ok IS NOT NULL AND (hard IS NULL OR ok < hard) THEN 'success'
       WHEN hard IS NOT NULL THEN 'stopped' ELSE 'exhausted' END AS outcome,
  CAST(CASE WHEN ok IS NOT NULL AND (hard IS NULL OR ok < hard) THEN ok_pos END AS BIGINT) AS successful_attempt,
  CAST(CASE WHEN NOT (ok IS NOT NULL AND (hard IS NULL OR ok < hard)) AND hard IS NOT NULL THEN hard_pos END AS BIGINT)
    AS stop_attempt
FROM c
"""

SQL_LADDER_CONFIG = f"""
SELECT v.task, v.outcome, l.* FROM ({SQL_FIRST_SUCCESS}) v
LEFT JOIN (VALUES (1, 8192, 32, CAST(0.90 AS DOUBLE), true), (2, 4096, 16, 0.90, true), (3, 2048, 8, 0.88, true), (4, 2048, 4, 0.88, false))
  l(fallback_level, max_num_batched_tokens, max_num_seqs, gpu_memory_utilization, enable_prefix_caching)
  ON v.successful_attempt = l.fallback_level
"""

SQL_TELEMETRY_PEAK = """
SELECT user_id AS gpu, CAST(greatest(coalesce(max(trunc(value)), 0), 0) AS BIGINT) AS peak
FROM events WHERE event_type <> 'error' GROUP BY 1
UNION ALL
SELECT user_id, CAST(0 AS BIGINT) FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type <> 'error') = 0
"""

SQL_TELEMETRY_PEAK_WINDOW = """
SELECT date_trunc('hour', ts) AS window_start, CAST(max(trunc(value)) AS BIGINT) AS peak
FROM events WHERE event_type <> 'error' GROUP BY 1
"""

QUERIES = {"attempt_status": q_attempt_status, "attempt_rollup": q_attempt_rollup,
           "first_success": q_first_success, "ladder_config": q_ladder_config, "telemetry_peak": q_telemetry_peak,
           "telemetry_peak_window": q_telemetry_peak_window}
ORACLES = {"attempt_status": SQL_ATTEMPT_STATUS, "attempt_rollup": SQL_ATTEMPT_ROLLUP,
           "first_success": SQL_FIRST_SUCCESS, "ladder_config": SQL_LADDER_CONFIG, "telemetry_peak": SQL_TELEMETRY_PEAK,
           "telemetry_peak_window": SQL_TELEMETRY_PEAK_WINDOW}
