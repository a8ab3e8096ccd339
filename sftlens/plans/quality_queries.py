"""Duplicate audit, repeats, reconciliation and resume.

Stand-ins: ``documents`` rows are samples of task ``source`` (the "file"),
``doc_id`` their line; the content hash is the key (the table has exact
copies).  ``labels`` is the set of samples already judged: expected count per
task = documents, actual = labelled documents.  A task is done when every
sample is labelled, none is toxic and none has quality 0.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators.quality import duplicate_counts, reconcile_counts, repeat_rows, resume_pending
from .common import table


def _keyed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("task"), "doc_id", content_hash("text").alias("text_hash"))


def q_duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    dc = duplicate_counts(_keyed_docs(spark, sf_dir), ["task"], "text_hash")
    return dc.select("task", F.col("rows").cast("bigint").alias("rows"),
                     F.col("distinct_keys").cast("bigint").alias("distinct_keys"),
                     F.col("duplicate_count").cast("bigint").alias("duplicate_count"))


def q_repeat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = repeat_rows(_keyed_docs(spark, sf_dir), ["task", "text_hash"], "doc_id")
    return r.select("task", "doc_id", F.col("first_line").alias("first_doc_id"), "text_hash")


def _per_task_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("task"))
    lab = table(spark, sf_dir, "labels")
    joined = d.join(lab, "doc_id")
    expected = d.groupBy("task").agg(F.count(F.lit(1)).alias("expected"))
    actual = joined.groupBy("task").agg(F.count(F.lit(1)).alias("actual"),
                                        F.count_if(F.col("toxic") == 1).alias("n_toxic"),
                                        F.count_if(F.col("quality") == 0).alias("n_low"))
    return expected, actual, joined


def q_reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, actual, _ = _per_task_counts(spark, sf_dir)
    return reconcile_counts(expected, actual.select("task", "actual"), "task")


def q_resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, actual, _ = _per_task_counts(spark, sf_dir)
    tasks = expected.join(actual, "task", "left")
    checks = [("incomplete", F.col("actual") == F.col("expected")),
              ("invalid_samples", F.col("n_toxic") == 0),
              ("invalid_export", F.col("n_low") == 0)]
    return resume_pending(tasks, checks).select("task", "reason")


SQL_DUPLICATE_AUDIT = """
WITH k AS (SELECT source AS task, substr(sha256(text), 1, 16) AS h FROM documents),
per AS (SELECT task, h, count(*) AS n FROM k GROUP BY task, h)
SELECT task, CAST(sum(n) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS distinct_keys,
  CAST(sum(n - 1) AS BIGINT) AS duplicate_count
FROM per GROUP BY task
"""

SQL_REPEAT_ROWS = """
WITH k AS (SELECT source AS task, doc_id, substr(sha256(text), 1, 16) AS text_hash FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY task, text_hash ORDER BY doc_id) AS rn,
             min(doc_id) OVER (PARTITION BY task, text_hash) AS first_doc_id FROM k)
SELECT task, doc_id, first_doc_id, text_hash FROM r WHERE rn > 1
"""

_COUNTS_SQL = """
WITH e AS (SELECT source AS task, count(*) AS expected FROM documents GROUP BY 1),
a AS (SELECT d.source AS task, count(*) AS actual, count(*) FILTER (WHERE l.toxic = 1) AS n_toxic,
             count(*) FILTER (WHERE l.quality = 0) AS n_low
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1)
"""

SQL_RECONCILE_COUNTS = _COUNTS_SQL + """
SELECT coalesce(e.task, a.task) AS task, CAST(coalesce(expected, 0) AS BIGINT) AS expected,
  CAST(coalesce(actual, 0) AS BIGINT) AS actual
FROM e FULL OUTER JOIN a ON e.task = a.task
WHERE coalesce(expected, 0) > 0 AND coalesce(expected, 0) <> coalesce(actual, 0)
"""

SQL_RESUME_PENDING = _COUNTS_SQL + """
SELECT task, reason FROM (
  SELECT e.task, CASE WHEN coalesce(a.actual = e.expected, false) = false THEN 'incomplete'
                      WHEN coalesce(a.n_toxic = 0, false) = false THEN 'invalid_samples'
                      WHEN coalesce(a.n_low = 0, false) = false THEN 'invalid_export' END AS reason
  FROM e LEFT JOIN a ON e.task = a.task) WHERE reason IS NOT NULL
"""

QUERIES = {"duplicate_audit": q_duplicate_audit, "repeat_rows": q_repeat_rows,
           "reconcile_counts": q_reconcile_counts, "resume_pending": q_resume_pending}
ORACLES = {"duplicate_audit": SQL_DUPLICATE_AUDIT, "repeat_rows": SQL_REPEAT_ROWS,
           "reconcile_counts": SQL_RECONCILE_COUNTS, "resume_pending": SQL_RESUME_PENDING}
