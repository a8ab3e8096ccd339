"""Entries whose data reaches the failing branch of a rule (SC1, SC2, A4, A5, A13, P14, V1 on files).

* ``file_lines``: the documents' ids are written as text files (64 folders, one file each, in id
  order, a blank line after every id divisible by 7) and read back with line numbers.
* ``token_stats_faults``: token statistics with blank outputs (id % 41 = 7), a key that
  repeats within a task (id % 37 = 5) and a generation cap low enough to truncate.
* ``ingest_errors``: the faulty samples are staged as files, one per model and task, and go
  through the ingest stream; the error sink is counted by model, task and code.
* ``catalog_check``: the catalog rules on a catalog made of the (source, lang) pairs of
  ``documents``, where the parameters differ in one language.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sql_ws_token_count, whitespace_token_count
from ..operators.runs import catalog_consistency
from ..operators.stats import token_stats
from ..session import scratch_dir
from ..sources.jsonl import read_lines
from ..streaming.ingest import REPEAT, ingest_samples, short_counts
from .common import generations, table
from .export_queries import _TASK_SQL, sample_lines
from .stats_queries import sql_percentile

FOLDERS = 64
CAP = 400  # generation cap of token_stats_faults


def q_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark, "file-lines")
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % FOLDERS).alias("folder"))
    text = F.concat(F.lit("id "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, "\n").otherwise(""))
    (d.repartition(FOLDERS, "folder").sortWithinPartitions("folder", "doc_id").select("folder", text.alias("value"))
      .write.partitionBy("folder").text(f"{base}/files"))
    lines = read_lines(spark, [f"{base}/files/*/*.txt"], base=1)
    return lines.where(F.col("text") != "").select(
        F.regexp_extract("file", r"/folder=(\d+)/", 1).cast("bigint").alias("folder"),
        F.regexp_extract("text", r"(\d+)$", 1).cast("bigint").alias("doc_id"), F.col("line").cast("bigint").alias("line"))


SQL_FILE_LINES = f"""
SELECT doc_id % {FOLDERS} AS folder, doc_id,
  CAST(row_number() OVER w + coalesce(sum(CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END)
       OVER (PARTITION BY doc_id % {FOLDERS} ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line
FROM documents WINDOW w AS (PARTITION BY doc_id % {FOLDERS} ORDER BY doc_id)
"""


def q_token_stats_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, i = generations(spark, sf_dir), F.col("doc_id")
    g = g.withColumn("output", F.when(i % 41 == 7, " \n").otherwise(F.col("output"))) \
         .withColumn("tokens", whitespace_token_count("output")) \
         .withColumn("key", F.when(i % 37 == 5, "again").otherwise(i.cast("string")))
    s = token_stats(g, max_gen_toks=CAP)
    return s.select("model", "task", "level", "actual_samples", "total_output_tokens", "p95", "possibly_truncated_count",
                    "empty_output_count", "duplicate_count")


SQL_TOKEN_STATS_FAULTS = f"""
WITH o AS (
  SELECT lang AS model, source AS task, CASE WHEN doc_id % 41 = 7 THEN '' ELSE text END AS text,
    CASE WHEN doc_id % 37 = 5 THEN 'again' ELSE CAST(doc_id AS VARCHAR) END AS k FROM documents),
g AS (SELECT model, task, k, text = '' AS blank, CASE WHEN text = '' THEN 0 ELSE {sql_ws_token_count('text')} END AS tokens FROM o),
r AS (SELECT model, task, 'task' AS level, tokens, blank FROM g UNION ALL SELECT model, NULL, 'overall', tokens, blank FROM g),
st AS (
  SELECT model, task, level, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tot, list_sort(list(tokens)) AS sl,
    count(*) FILTER (WHERE tokens >= {CAP - 8}) AS trunc, count(*) FILTER (WHERE blank) AS empty
  FROM r GROUP BY 1, 2, 3),
kd AS (SELECT model, task, sum(c - 1) AS d FROM (SELECT model, task, k, count(*) AS c FROM g GROUP BY 1, 2, 3) GROUP BY 1, 2),
du AS (SELECT model, task, 'task' AS level, d FROM kd UNION ALL SELECT model, NULL, 'overall', sum(d) FROM kd GROUP BY 1)
SELECT st.model, st.task, st.level, CAST(n AS BIGINT) AS actual_samples, tot AS total_output_tokens,
  {sql_percentile('sl', 'n', 95)} AS p95, CAST(trunc AS BIGINT) AS possibly_truncated_count,
  CAST(empty AS BIGINT) AS empty_output_count, CAST(d AS BIGINT) AS duplicate_count
FROM st JOIN du ON st.model = du.model AND st.level = du.level AND st.task IS NOT DISTINCT FROM du.task
"""


def q_ingest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark, "ingest-errors")
    lines = sample_lines(spark, sf_dir, faults=True).select("model", "task", "text")
    # one file per model and task, as a run writes them
    lines.repartition("model", "task").write.partitionBy("model", "task").text(f"{base}/landing/stage1")
    ingest_samples(spark, f"{base}/landing/*/*/*", f"{base}/sink", f"{base}/checkpoint", lambda good: good.select("model", "task", "line"))
    errors = spark.read.parquet(f"{base}/sink/errors")
    return errors.groupBy("model", "task", "code").agg(F.count(F.lit(1)).alias("n"))


SQL_INGEST_ERRORS = "WITH" + _TASK_SQL + """,
s AS (
  SELECT *, lang AS model, doc_id % 11 = 5 AS corrupt,
    CASE WHEN doc_id % 13 = 7 THEN 'n' || CAST(doc_id - 4 AS VARCHAR) WHEN doc_id % 29 = 3 THEN 's' || CAST(doc_id AS VARCHAR)
         ELSE 'n' || CAST(doc_id AS VARCHAR) END AS k,
    doc_id % 17 = 9 AS empty_out, doc_id % 19 = 11 AS no_out, doc_id % 23 = 13 AS no_prompt
  FROM d),
e AS (
  SELECT model, task, 'parse_error' AS code, 1 AS n FROM s WHERE corrupt
  UNION ALL SELECT model, task, 'empty_output', 1 FROM s WHERE NOT corrupt AND (empty_out OR no_out)
  UNION ALL SELECT model, task, 'missing_resps', 1 FROM s WHERE NOT corrupt AND NOT empty_out AND no_out
  UNION ALL SELECT model, task, 'missing_prompt', 1 FROM s WHERE NOT corrupt AND no_prompt
  UNION ALL SELECT model, task, 'duplicate_doc_id', count(*) - 1 FROM s WHERE NOT corrupt GROUP BY model, task, k HAVING count(*) > 1)
SELECT model, task, code, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY 1, 2, 3
"""


def q_ingest_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 with state over two runs: even documents land first, odd ones next, in files of their own.  With the faults of the
    samples (``id % 13 = 7`` reuses the id four before; every seventh sample of the first run lands again in the second)
    the repeats are those over all files of a (model, task), and the counts exceed the expected ones by the
    samples that landed twice."""
    base = scratch_dir(spark, "ingest-repeats")
    lines = sample_lines(spark, sf_dir, faults=True)
    parts = (lines.where("line % 2 = 1"), lines.where("line % 2 = 0").unionByName(lines.where("line % 14 = 1")))
    for stage, part in zip(("stage1", "stage2"), parts):
        part.select("model", "task", "text").repartition("model", "task").write.partitionBy("model", "task").text(f"{base}/landing/{stage}")
        ingest_samples(spark, f"{base}/landing/*/*/*", f"{base}/sink", f"{base}/checkpoint", lambda good: good.select("model", "task", "line"), state=f"{base}/state")
    expected = lines.groupBy("model", "task").agg(F.count(F.lit(1)).alias("expected"))
    repeats = spark.read.schema(REPEAT).parquet(f"{base}/sink/repeats").groupBy("model", "task").agg(F.count(F.lit(1)).alias("repeats"))
    off = short_counts(spark, f"{base}/state", expected).withColumn("surplus", F.col("actual") - F.col("expected"))
    return repeats.join(off.select("model", "task", "surplus"), ["model", "task"], "full_outer").select(
        "model", "task", F.coalesce("repeats", F.lit(0)).alias("repeats"), F.coalesce("surplus", F.lit(0)).alias("surplus"))


SQL_INGEST_REPEATS = "WITH" + _TASK_SQL + """,
s AS (
  SELECT lang AS model, task, doc_id % 11 = 5 AS corrupt,
    CASE WHEN doc_id % 13 = 7 THEN 'n' || CAST(doc_id - 4 AS VARCHAR) WHEN doc_id % 29 = 3 THEN 's' || CAST(doc_id AS VARCHAR)
         ELSE 'n' || CAST(doc_id AS VARCHAR) END AS k, doc_id + 1 AS line
  FROM d),
landed AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE line % 14 = 1),
r AS (SELECT model, task, sum(n - 1) AS repeats FROM (SELECT model, task, k, count(*) AS n FROM landed WHERE NOT corrupt GROUP BY 1, 2, 3) GROUP BY 1, 2),
c AS (SELECT model, task, count(*) FILTER (WHERE line % 14 = 1) AS surplus FROM s GROUP BY 1, 2)
SELECT c.model, c.task, CAST(coalesce(repeats, 0) AS BIGINT) AS repeats, surplus FROM c LEFT JOIN r ON c.model = r.model AND c.task = r.task
WHERE coalesce(repeats, 0) > 0 OR surplus > 0
"""


def q_catalog_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    odd = F.col("lang") == "de"
    catalog = d.select(
        "lang", F.col("source").alias("task"), F.array(F.lit("</s>"), F.when(odd, "<end>").otherwise("<|eot_id|>")).alias("until"),
        F.lit(False).alias("do_sample"), F.when(F.col("lang") == "fr", 0.5).otherwise(0.0).alias("temperature"),
        F.lit(32768).alias("max_gen_toks"), F.lit(1).alias("repeats"), F.lit(0).alias("num_fewshot"))
    parts = [(name, catalog.where(cond)) for name, cond in (
        ("en", F.col("lang") == "en"), ("en+de", F.col("lang").isin("en", "de")), ("en+fr", F.col("lang").isin("en", "fr")))]
    out = None
    for name, part in parts:
        row = catalog_consistency(part).select(F.lit(name).alias("catalog"), "names_unique", "same_stop_strings", "same_generation")
        out = row if out is None else out.unionByName(row)
    return out


SQL_CATALOG_CHECK = """
WITH d AS (SELECT DISTINCT lang, source FROM documents),
c AS (SELECT 'en' AS catalog, * FROM d WHERE lang = 'en' UNION ALL SELECT 'en+de', * FROM d WHERE lang IN ('en', 'de')
      UNION ALL SELECT 'en+fr', * FROM d WHERE lang IN ('en', 'fr'))
SELECT catalog, count(*) = count(DISTINCT source) AS names_unique, count(DISTINCT lang = 'de') = 1 AS same_stop_strings,
  count(DISTINCT lang = 'fr') = 1 AS same_generation
FROM c GROUP BY 1
"""

QUERIES = {"file_lines": q_file_lines, "token_stats_faults": q_token_stats_faults, "ingest_errors": q_ingest_errors, "ingest_repeats": q_ingest_repeats,
           "catalog_check": q_catalog_check}
ORACLES = {"file_lines": SQL_FILE_LINES, "token_stats_faults": SQL_TOKEN_STATS_FAULTS, "ingest_errors": SQL_INGEST_ERRORS, "ingest_repeats": SQL_INGEST_REPEATS,
           "catalog_check": SQL_CATALOG_CHECK}
