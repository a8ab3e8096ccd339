"""Rule sets and graders called from SQL text only (V1, V2, M10, X1); see ``functions.sqlcatalog``.

The inputs are the stand-in files of the validation and grading queries, so the outcome is that of their oracles.
``GRADER_OF`` names the grader of each catalog task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqlcatalog import register
from ..operators.grading import grade, mean_exact_match
from ..sources.catalog import TASK_CATALOG
from .encode_queries import TOKENIZER
from .export_queries import SQL_VALIDATE_EXPORT, SQL_VALIDATE_SAMPLES, _expected_counts, export_lines_with_faults, sample_lines
from .grading_queries import _TASK_SQL, _VERDICT_SQL, _grading_inputs

GRADER_OF = dict(zip([t[0] for t in TASK_CATALOG], ("reference", "fixed", "fixed")))

SAMPLE_ERRORS = """
WITH ids AS (SELECT task, line, typed_key(id) AS k, json_text(id) AS shown
             FROM (SELECT task, line, sample_doc_id(v, line) AS id FROM (SELECT task, line, try_parse_json(py_strip(text)) AS v FROM {lines}) WHERE v IS NOT NULL)),
firsts AS (SELECT task, k, min(line) AS line FROM ids GROUP BY task, k HAVING count(*) > 1),
counts AS (SELECT task, count(*) AS actual FROM {lines} WHERE NOT is_blank(text) GROUP BY task)
SELECT task, line, inline(errors) FROM (SELECT task, line, sample_errors(text) AS errors FROM {lines} WHERE NOT is_blank(text))
UNION ALL SELECT i.task, i.line, 'duplicate_doc_id', concat('doc_id=', i.shown) FROM ids i JOIN firsts f ON i.task = f.task AND i.k = f.k WHERE i.line > f.line
UNION ALL SELECT x.task, NULL, 'count_mismatch', concat('actual=', coalesce(c.actual, 0), ', expected=', x.expected)
          FROM {expected} x LEFT JOIN counts c ON x.task = c.task WHERE x.expected > 0 AND x.expected <> coalesce(c.actual, 0)
"""

EXPORT_ERRORS = """
WITH ids AS (SELECT task, line, typed_key(id) AS k, json_text(id) AS shown
             FROM (SELECT task, line, try_variant_get(try_parse_json(py_strip(text)), '$.sample_id', 'variant') AS id FROM {lines}) WHERE NOT json_is_none(id)),
firsts AS (SELECT task, k, min(line) AS line FROM ids GROUP BY task, k HAVING count(*) > 1)
SELECT task, line, inline(errors) FROM (SELECT task, line, export_errors(text, {method}) AS errors FROM {lines} WHERE NOT is_blank(text))
UNION ALL SELECT i.task, i.line, 'duplicate_sample_id', concat('sample_id=', i.shown) FROM ids i JOIN firsts f ON i.task = f.task AND i.k = f.k WHERE i.line > f.line
"""

GRADES = """
SELECT model, task, count(*) AS n, avg(score) AS exact_match
FROM (SELECT g.model, g.task, grade(b.grader, g.output, b.doc, b.answer_field, b.solution_field) AS score
      FROM {generations} g JOIN {gold} b ON g.task = b.task AND g.doc_id = b.doc_id)
GROUP BY model, task
"""


def _with_grader(gold: DataFrame) -> DataFrame:
    grader = F.create_map(*[F.lit(x) for kv in GRADER_OF.items() for x in kv])
    return gold.withColumn("grader", grader[F.col("task")])


def q_sql_sample_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    return spark.sql(SAMPLE_ERRORS, lines=sample_lines(spark, sf_dir, faults=True), expected=_expected_counts(spark, sf_dir))


def q_sql_export_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    return spark.sql(EXPORT_ERRORS, lines=export_lines_with_faults(spark, sf_dir), method=TOKENIZER.name)


def q_sql_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    generations, gold = _grading_inputs(spark, sf_dir)
    return spark.sql(GRADES, generations=generations, gold=_with_grader(gold))


def q_grade_by_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 on DataFrames: the grader is a column of the catalog."""
    generations, gold = _grading_inputs(spark, sf_dir)
    return mean_exact_match(grade(generations, _with_grader(gold)))


SQL_GRADES = f"""
SELECT p_brand AS model, {_TASK_SQL} AS task, count(*) AS n,
  avg(CASE WHEN {_VERDICT_SQL} AND (p_size % 3 <> 0 OR p_partkey % 2 = 0) THEN 1 ELSE 0 END) AS exact_match
FROM part GROUP BY 1, 2
"""

QUERIES = {"sql_sample_errors": q_sql_sample_errors, "sql_export_errors": q_sql_export_errors, "sql_grade": q_sql_grade, "grade_by_catalog": q_grade_by_catalog}
ORACLES = {"sql_sample_errors": SQL_VALIDATE_SAMPLES, "sql_export_errors": SQL_VALIDATE_EXPORT, "sql_grade": SQL_GRADES, "grade_by_catalog": SQL_GRADES}
