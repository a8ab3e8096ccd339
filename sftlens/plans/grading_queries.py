"""Grading queries (M1-M11, J7) over ``part``.

Answer pairs are built from each part's integers so that the expected
verdict is known by construction (the oracle does not re-implement the
normaliser).  With ``m = p_size``, ``n = p_partkey % 9 + 1``,
``d = p_size % 9 + 1`` and case ``k = p_partkey % 12``:

====  ===================  =================  =======
k     answer               gold               verdict
====  ===================  =================  =======
0     m                    m                  true
1     \\frac nd (digits)   \\frac{n}{d}       true
2     n/d                  \\dfrac{n}{d}      true
3     0.5 or .5            \\frac{1}{2}       true
4     0n/d                 \\frac{n}{d}       false
5     x = m                m                  true
6     abc=m                m                  false
7     \\sqrt n             \\sqrt{n}          true
8     m^\\circ             m                  true
9     m\\text{ cm}         m                  true
10    m\\frac              m\\frac            true (raw fallback)
11    m                    m + 1              false
====  ===================  =================  =======

``grade_exact_match``: part ``p`` is a generation of model ``p_brand`` for
doc ``p_partkey`` of catalog task ``p_size % 3``.  Even ``k``: the output is
``Final: $<answer>$``; odd ``k``: ``So the answer is \\boxed{<answer>}.``.
The doc keeps the gold under the task's answer field, except ``k % 5 = 0``
where only the solution (``... $\\boxed{<gold>}$``) carries it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grading import grade, is_equiv, mean_exact_match
from ..sources.catalog import TASK_CATALOG, task_catalog
from .common import json_string_literal, table

# Expected verdict per case k (0..11), by construction.
EXPECTED = (True, True, True, True, False, True, False, True, True, True, True, False)


def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    m = F.col("p_size").cast("string")
    n = (F.col("p_partkey") % 9 + 1).cast("string")
    d = (F.col("p_size") % 9 + 1).cast("string")
    k = (F.col("p_partkey") % 12).cast("int")
    frac = F.concat(F.lit("\\frac{"), n, F.lit("}{"), d, F.lit("}"))
    a = (F.when(k == 0, m).when(k == 1, F.concat(F.lit("\\frac"), n, d)).when(k == 2, F.concat(n, F.lit("/"), d))
          .when(k == 3, F.when(F.col("p_size") % 2 == 0, F.lit("0.5")).otherwise(F.lit(".5")))
          .when(k == 4, F.concat(F.lit("0"), n, F.lit("/"), d)).when(k == 5, F.concat(F.lit("x = "), m))
          .when(k == 6, F.concat(F.lit("abc="), m)).when(k == 7, F.concat(F.lit("\\sqrt"), n))
          .when(k == 8, F.concat(m, F.lit("^\\circ"))).when(k == 9, F.concat(m, F.lit("\\text{ cm}")))
          .when(k == 10, F.concat(m, F.lit("\\frac"))).otherwise(m))
    b = (F.when(k.isin(0, 5, 6, 8, 9), m).when(k.isin(1, 4), frac)
          .when(k == 2, F.concat(F.lit("\\dfrac{"), n, F.lit("}{"), d, F.lit("}")))
          .when(k == 3, F.lit("\\frac{1}{2}")).when(k == 7, F.concat(F.lit("\\sqrt{"), n, F.lit("}")))
          .when(k == 10, F.concat(m, F.lit("\\frac"))).otherwise((F.col("p_size") + 1).cast("string")))
    return p.select("p_partkey", "p_size", "p_brand", k.alias("k"), a.alias("a"), b.alias("b"))


def q_normalize_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = is_equiv(answer_pairs(spark, sf_dir), "a", "b", "is_equiv")
    return e.select("p_partkey", F.col("k").cast("bigint").alias("k"), "is_equiv")


def _grading_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs = answer_pairs(spark, sf_dir)
    names = F.array(*[F.lit(t[0]) for t in TASK_CATALOG])
    ti = (F.col("p_size") % 3 + 1).cast("int")
    pairs = pairs.withColumn("task", F.element_at(names, ti)).withColumn("doc_id", F.col("p_partkey"))
    out = F.when(F.col("k") % 2 == 0, F.concat(F.lit("Final: $"), F.col("a"), F.lit("$"))) \
           .otherwise(F.concat(F.lit("So the answer is \\boxed{"), F.col("a"), F.lit("}.")))
    gens = pairs.select(F.col("p_brand").alias("model"), "task", "doc_id", out.alias("output"))
    cat = task_catalog(spark).select("task", "answer_field", "solution_field")
    g = pairs.join(F.broadcast(cat), "task")
    js = json_string_literal
    doc = F.when(F.col("k") % 5 == 0,
                 F.concat(F.lit('{"'), F.col("solution_field"), F.lit('":'),
                          js(F.concat(F.lit("We get $\\boxed{"), F.col("b"), F.lit("}$"))), F.lit("}"))) \
           .otherwise(F.concat(F.lit('{"'), F.col("answer_field"), F.lit('":'), js(F.col("b")), F.lit("}")))
    gold = g.select("task", "doc_id", F.parse_json(doc).alias("doc"), "answer_field", "solution_field")
    return gens, gold


def q_grade_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    gens, gold = _grading_inputs(spark, sf_dir)
    return mean_exact_match(grade(gens, gold, mode="fixed"))


def q_grade_reference_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    gens, gold = _grading_inputs(spark, sf_dir)
    return mean_exact_match(grade(gens, gold, mode="reference"))


_VERDICT_SQL = "CASE p_partkey % 12 " + " ".join(
    f"WHEN {i} THEN {'true' if v else 'false'}" for i, v in enumerate(EXPECTED)) + " END"

SQL_NORMALIZE_ANSWERS = f"""
SELECT p_partkey, CAST(p_partkey % 12 AS BIGINT) AS k, {_VERDICT_SQL} AS is_equiv FROM part
"""

_TASK_SQL = ("CASE p_size % 3 WHEN 0 THEN 'local_math500_32k' WHEN 1 THEN 'local_aime24_32k' "
             "ELSE 'local_aime25_32k' END")

SQL_GRADE_EXACT_MATCH = f"""
SELECT p_brand AS model, {_TASK_SQL} AS task, CAST(count(*) AS BIGINT) AS n,
  avg(CASE WHEN {_VERDICT_SQL} THEN 1 ELSE 0 END) AS exact_match
FROM part GROUP BY 1, 2
"""

# Reference mode: boxed outputs (odd k) never match; AIME24 (capitalised fields) never scores.
SQL_GRADE_REFERENCE_MODE = f"""
SELECT p_brand AS model, {_TASK_SQL} AS task, CAST(count(*) AS BIGINT) AS n,
  avg(CASE WHEN p_partkey % 2 = 0 AND p_size % 3 <> 1 AND {_VERDICT_SQL} THEN 1 ELSE 0 END) AS exact_match
FROM part GROUP BY 1, 2
"""

QUERIES = {"normalize_answers": q_normalize_answers, "grade_exact_match": q_grade_exact_match,
           "grade_reference_mode": q_grade_reference_mode}
ORACLES = {"normalize_answers": SQL_NORMALIZE_ANSWERS, "grade_exact_match": SQL_GRADE_EXACT_MATCH,
           "grade_reference_mode": SQL_GRADE_REFERENCE_MODE}
