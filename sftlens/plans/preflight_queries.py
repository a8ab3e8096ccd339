"""Pre-flight queries (P4, A9, A10, L2) over ``benchmark``.

Stand-in: benchmark item ``i`` belongs to the catalog task ``i % 3`` (in
catalog order) and its text is the question; prompts are counted with the
code-point tokenizer plus BOS (the pre-flight adds special tokens).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokenize import CodePointTokenizer
from ..operators.preflight import benchmark_prompts, head_per_task, length_budget, prompt_length_stats
from ..sources.catalog import TASK_CATALOG, task_catalog
from .common import DEFAULT_MAX_GEN_TOKS, DEFAULT_MAX_MODEL_LEN, table

HEAD_N = 10
TOKENIZER = CodePointTokenizer()


def bench_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    tasks = F.array(*[F.lit(t[0]) for t in TASK_CATALOG])
    return b.select("item_id", F.element_at(tasks, (F.col("item_id") % 3 + 1).cast("int")).alias("task"),
                    F.col("text").alias("question"))


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_prompts(bench_docs(spark, sf_dir), task_catalog(spark), TOKENIZER)


def q_prompt_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt_length_stats(_prompts(spark, sf_dir))


def q_length_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_budget(prompt_length_stats(_prompts(spark, sf_dir)), DEFAULT_MAX_GEN_TOKS, DEFAULT_MAX_MODEL_LEN)


def q_benchmark_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = head_per_task(_prompts(spark, sf_dir), HEAD_N, "task", "item_id")
    return h.select("task", "item_id", F.col("prompt_tokens").cast("bigint").alias("prompt_tokens"))


_P_SQL = """
WITH d AS (
  SELECT item_id, text,
    CASE item_id % 3 WHEN 0 THEN 'local_math500_32k' WHEN 1 THEN 'local_aime24_32k' ELSE 'local_aime25_32k' END AS task
  FROM benchmark),
p AS (
  SELECT item_id, task,
    CAST(length(CASE WHEN task = 'local_math500_32k' THEN 'Problem: ' ELSE 'Question: ' END
                || text || chr(10) || 'Answer:') + 1 AS BIGINT) AS prompt_tokens
  FROM d)
"""

SQL_PROMPT_LENGTH_STATS = _P_SQL + """
SELECT task, CASE WHEN grouping(task) = 1 THEN 'all' ELSE 'task' END AS level,
  CAST(count(*) AS BIGINT) AS n_samples, CAST(max(prompt_tokens) AS BIGINT) AS max_prompt_tokens,
  avg(prompt_tokens) AS mean_prompt_tokens
FROM p GROUP BY ROLLUP (task)
"""

SQL_LENGTH_BUDGET = _P_SQL + f"""
SELECT CAST(max(prompt_tokens) AS BIGINT) AS max_prompt_tokens, CAST({DEFAULT_MAX_GEN_TOKS} AS BIGINT) AS max_gen_toks,
  CAST(max(prompt_tokens) + {DEFAULT_MAX_GEN_TOKS} AS BIGINT) AS required_max_model_len,
  CAST({DEFAULT_MAX_MODEL_LEN} AS BIGINT) AS max_model_len,
  max(prompt_tokens) + {DEFAULT_MAX_GEN_TOKS} <= {DEFAULT_MAX_MODEL_LEN} AS check_passed
FROM p
"""

SQL_BENCHMARK_HEAD = _P_SQL + f"""
SELECT task, item_id, prompt_tokens FROM (
  SELECT *, row_number() OVER (PARTITION BY task ORDER BY item_id) AS rn FROM p) WHERE rn <= {HEAD_N}
"""

QUERIES = {"prompt_length_stats": q_prompt_length_stats, "length_budget": q_length_budget,
           "benchmark_head": q_benchmark_head}
ORACLES = {"prompt_length_stats": SQL_PROMPT_LENGTH_STATS, "length_budget": SQL_LENGTH_BUDGET,
           "benchmark_head": SQL_BENCHMARK_HEAD}
