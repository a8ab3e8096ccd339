"""Token statistics queries (P14, P15, A1-A3, A5) and their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import sql_py_strip, sql_ws_token_count
from ..operators.stats import token_stats
from .common import DEFAULT_MAX_GEN_TOKS, generations


def q_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = generations(spark, sf_dir)
    return token_stats(g, "model", "task", "tokens", "output", "sample_id",
                       max_gen_toks=DEFAULT_MAX_GEN_TOKS)


def sql_percentile(list_expr: str, n_expr: str, p: int) -> str:
    """DuckDB: the reference's linear-interpolation percentile over a sorted list, truncated."""
    k = f"(({p} / 100) * ({n_expr} - 1))"
    f = f"CAST(floor({k}) AS BIGINT)"
    lo = f"{list_expr}[{f} + 1]"
    hi = f"{list_expr}[{f} + 2]"
    return (f"CAST(trunc(CASE WHEN {n_expr} = 1 THEN CAST({list_expr}[1] AS DOUBLE) "
            f"WHEN {f} + 1 >= {n_expr} THEN CAST({list_expr}[{n_expr}] AS DOUBLE) "
            f"ELSE {lo} + ({hi} - {lo}) * ({k} - {f}) END) AS BIGINT)")


SQL_TOKEN_STATS = f"""
WITH g AS (
  SELECT lang AS model, source AS task, source || ':' || CAST(doc_id AS VARCHAR) AS sample_id,
         text AS output, {sql_ws_token_count('text')} AS tokens
  FROM documents),
s AS (
  SELECT model, task,
    CASE WHEN grouping(task) = 1 THEN 'overall' ELSE 'task' END AS level,
    CAST(count(*) AS BIGINT) AS actual_samples,
    CAST(sum(tokens) AS BIGINT) AS total_output_tokens,
    list_sort(list(tokens)) AS sl,
    CAST(max(tokens) AS BIGINT) AS max_output_tokens,
    CAST(count(*) FILTER (WHERE tokens >= {DEFAULT_MAX_GEN_TOKS} - 8) AS BIGINT) AS possibly_truncated_count,
    CAST(count(*) FILTER (WHERE coalesce(length({sql_py_strip('output')}) = 0, true)) AS BIGINT) AS empty_output_count,
    CAST(count(*) - count(DISTINCT (task, sample_id)) AS BIGINT) AS duplicate_count
  FROM g
  GROUP BY GROUPING SETS ((model, task), (model)))
SELECT model, task, level, actual_samples, total_output_tokens,
  round_even(CAST(total_output_tokens AS DOUBLE) / actual_samples, 1) AS avg_output_tokens,
  {sql_percentile('sl', 'actual_samples', 50)} AS p50,
  {sql_percentile('sl', 'actual_samples', 90)} AS p90,
  {sql_percentile('sl', 'actual_samples', 95)} AS p95,
  max_output_tokens, possibly_truncated_count, empty_output_count, duplicate_count
FROM s
"""

QUERIES = {"token_stats": q_token_stats}
ORACLES = {"token_stats": SQL_TOKEN_STATS}
