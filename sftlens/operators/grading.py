"""Maths grading as a distributed job.

``generations JOIN gold ON (task, doc_id)`` -> extract the answer -> normalise
both sides -> ``exact_match`` -> mean per (model, task).  Everything is
built-in expressions; the join is an ordinary equi-join (AQE picks broadcast
when the gold side is small at runtime and splits skewed partitions).

Two modes:

* ``reference`` reproduces the original grader, defects included: gold is read
  from the literal keys ``answer`` / ``solution`` (a benchmark with capitalised
  field names never scores), the model output is only cut between ``$`` signs
  (a ``\\boxed{}`` answer without dollars never matches), and a non-string gold
  never equals.
* ``fixed`` reads gold through the catalog field names, prefers the last
  ``\\boxed{}`` of the output, and compares gold as text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mathnorm import add_boxed_answer, dollar_span, last_boxed, normalize, remove_boxed
from ..functions.variant import doc_field, is_none, key, py_str, truthy

MODES = ("reference", "fixed")


def is_equiv(df: DataFrame, a_col: str, b_col: str, out_col: str = "is_equiv") -> DataFrame:
    """M9: both NULL -> true; one NULL -> false; else normalised equality, falling back
    to raw equality when normalising either side fails."""
    df = normalize(df, a_col, "_na")
    df = normalize(df, b_col, "_nb")
    a, b, na, nb = F.col(a_col), F.col(b_col), F.col("_na"), F.col("_nb")
    verdict = (F.when(a.isNull() & b.isNull(), F.lit(True))
                .when(a.isNull() | b.isNull(), F.lit(False))
                .when(na.isNull() | nb.isNull(), a == b)
                .otherwise(na == nb))
    return df.withColumn(out_col, verdict).drop("_na", "_nb")


def doc_field_v(doc: Column, name) -> Column:
    """``doc.get(name)`` on a doc VARIANT with a dynamic key."""
    name_c = F.lit(name) if isinstance(name, str) else name
    return F.try_element_at(doc.try_cast("map<string,variant>"), name_c)


def grade(generations: DataFrame, gold: DataFrame, mode: str = "fixed",
          keys: tuple[str, ...] = ("task", "doc_id"), output_col: str = "output",
          doc_col: str = "doc") -> DataFrame:
    """J7 + M10: one row per generation with ``answer``, ``gold``, ``exact_match`` (0/1).

    ``gold`` carries ``doc VARIANT`` (and, for ``fixed``, ``answer_field`` /
    ``solution_field`` from the catalog; ``grader``, if it has that column, chooses the mode by
    task and overrides ``mode``).  Answers are extracted on each side before the join, so
    only short strings go through it: ``output_col`` and ``doc_col`` are not in the result.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if "grader" in gold.columns:
        parts = [grade(generations, gold.where(F.col("grader") == m).drop("grader"), m, keys, output_col, doc_col) for m in MODES]
        return parts[0].unionByName(parts[1])
    v = F.col(doc_col)
    left = generations
    if mode == "reference":
        ans = F.try_variant_get(v, "$" + key("answer"), "variant")
        sol_ok, sol = truthy(v, key("solution")), F.try_variant_get(v, "$" + key("solution"), "string")
        left = left.withColumn("answer", dollar_span(F.col(output_col)))
    else:
        ans = doc_field_v(v, F.col("answer_field"))
        sol_v = doc_field_v(v, F.col("solution_field"))
        sol_ok, sol = truthy(sol_v), py_str(sol_v)
        left = add_boxed_answer(left, output_col, "_boxed")
        left = left.withColumn("answer", F.coalesce(F.col("_boxed"), dollar_span(F.col(output_col)))).drop("_boxed")
    right = gold.withColumn("_gans", ans).withColumn("_gsol", F.when(sol_ok, sol))
    right = add_boxed_answer(right, "_gsol", "_gbox")
    has = ~is_none(F.col("_gans"))
    is_text = F.when(has, F.schema_of_variant(F.col("_gans")) == "STRING").otherwise(F.lit(True)) if mode == "reference" else F.lit(True)
    right = right.select(*keys, F.when(has, py_str(F.col("_gans"))).otherwise(F.col("_gbox")).alias("gold"), is_text.alias("_gold_str"))
    j = is_equiv(left.drop(output_col).join(right, list(keys), "inner"), "answer", "gold", "_eq")
    em = F.when(F.col("gold").isNotNull() & F.col("_gold_str") & F.col("_eq"), 1).otherwise(0)
    return j.withColumn("exact_match", em).drop("_eq", "_gold_str")


def mean_exact_match(graded: DataFrame, group_cols=("model", "task")) -> DataFrame:
    """Mean of exact_match per group (partial aggregation; skew-safe)."""
    return graded.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"),
                                           F.avg("exact_match").alias("exact_match"))


__all__ = ["is_equiv", "grade", "mean_exact_match", "MODES"]
