"""Duplicate and repeat detection (A4, W1), reconciliation (J3) and resume.

Repeats are found with an aggregate (first line per key) joined back, not a
window partitioned by the key: a key holding a third of all rows is
pre-aggregated map-side, and the join back is split by AQE skew handling.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def later_rows(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Every row of a key after its first in ``order_cols``: rows minus one per key.

    Rows that tie with the first (equal in all ``order_cols``) count too: the one that is least in its other
    columns is the first, all others are returned as they are, so no repeat is lost when positions repeat
    (lines of several files, say).  The added column ``_first`` holds the first position.  NULL keys are keys;
    rows need not be distinct; all columns must be orderable.
    """
    rest = [c for c in df.columns if c not in {*key_cols, *order_cols}]
    df = df.withColumn("_at", F.struct(*order_cols, *rest))
    head = df.groupBy(*key_cols).agg(F.min("_at").alias("_head"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    head = head.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key_cols)], "_head",
                       F.struct(*[F.col(f"_head.{c}").alias(c) for c in order_cols]).alias("_first"))
    same = None
    for i, k in enumerate(key_cols):
        c = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        same = c if same is None else same & c
    hit = df.join(head, same).drop(*[f"_k{i}" for i in range(len(key_cols))])
    later = hit.where(F.col("_at") > F.col("_head")).drop("_at", "_head")
    alike = hit.where(F.col("_at").eqNullSafe(F.col("_head"))).drop("_at", "_head")  # whole copies of the first row
    cols = [c for c in alike.columns if c not in key_cols]
    alike = (alike.groupBy(*key_cols).agg(*[F.min(c).alias(c) for c in cols], F.count(F.lit(1)).alias("_n"))
             .where("_n > 1").withColumn("_again", F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("_n")))))
    return later.unionByName(alike.select(*later.columns))


def repeat_rows(df: DataFrame, key_cols: Sequence[str], line_col: str) -> DataFrame:
    """Every occurrence of a key after its first (by ``line_col``) -- one row each,
    with ``first_line`` of that key.

    The narrow projection (keys, line) is written once and both the aggregate and
    the join back read it, so wide inputs (texts hashed into keys) are read once.
    """
    df = materialize(df.select(*key_cols, line_col), "repeat-keys")
    return later_rows(df, key_cols, [line_col]).select(*key_cols, line_col, F.col(f"_first.{line_col}").alias("first_line"))


def duplicate_counts(df: DataFrame, group_cols: Sequence[str], key_col: str) -> DataFrame:
    """A4: rows minus distinct keys per group (two-level aggregate, skew-safe)."""
    per_key = df.groupBy(*group_cols, key_col).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.groupBy(*group_cols).agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"),
        F.sum(F.col("_n") - 1).alias("duplicate_count"))


def reconcile_counts(expected: DataFrame, actual: DataFrame, key: str,
                     expected_col: str = "expected", actual_col: str = "actual") -> DataFrame:
    """Full outer join of expected vs actual counts per key; a mismatch is a row where
    expected > 0 and actual differs (expected 0 means unchecked; a missing side counts 0)."""
    j = expected.join(actual, key, "full_outer")
    e = F.coalesce(F.col(expected_col), F.lit(0)).cast("bigint")
    a = F.coalesce(F.col(actual_col), F.lit(0)).cast("bigint")
    return j.select(key, e.alias(expected_col), a.alias(actual_col)).where((F.col(expected_col) > 0)
                                                                          & (F.col(expected_col) != F.col(actual_col)))


def resume_pending(tasks: DataFrame, checks: Sequence[tuple[str, object]], task_col: str = "task") -> DataFrame:
    """The tasks still to run, each with the first failing check as ``reason``.

    ``checks`` is an ordered list of ``(reason, ok_column)``; a task is done
    only when every check holds (a NULL check counts as failed).
    """
    reason = None
    for name, ok in checks:
        cond = ~F.coalesce(ok, F.lit(False))
        reason = F.when(cond, F.lit(name)) if reason is None else reason.when(cond, F.lit(name))
    return tasks.withColumn("reason", reason).where(F.col("reason").isNotNull())
