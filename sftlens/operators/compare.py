"""Run comparison (A6, C1-C6) over a *table* of model runs.

The reference compares exactly two runs; here every pair of runs is formed by
a self-join on the (small) run table and C1-C5 become ordinary columns.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Configuration fields compared by C1 (then the two versions).
COMPARABLE_FIELDS = ("max_gen_toks", "max_model_len", "max_num_batched_tokens", "max_num_seqs",
                     "gpu_memory_utilization", "enable_prefix_caching", "enable_chunked_prefill", "dtype")
VERSION_FIELDS = ("vllm_version", "lm_eval_version")
FLOAT_FIELDS = ("gpu_memory_utilization",)
# The 5-tuple C2 compares.
EQUAL_FIELDS = ("max_num_batched_tokens", "max_num_seqs", "gpu_memory_utilization",
                "enable_prefix_caching", "fallback_level")
TOLERANCE = 1e-6
# The metrics of the comparison matrix, in order.
MATRIX_METRICS = (
    "generation_complete", "total_expected_samples", "total_actual_samples", "empty_output_count",
    "duplicate_count", "total_output_tokens", "avg_output_tokens", "p50", "p90", "p95",
    "max_output_tokens", "possibly_truncated_count", "successful_attempt_wall_time", "tokens_per_s",
    "gpu_peak_memory_mib", "fallback_level", "enable_prefix_caching", "enable_chunked_prefill",
    "config_comparable", "throughput_comparable",
)


def tokens_per_s(total_tokens: Column, elapsed: Column) -> Column:
    """Tokens / successful-attempt seconds, 1 dp; 0 when elapsed is 0."""
    return F.when(elapsed > 0, F.bround(total_tokens / elapsed, 1)).otherwise(F.lit(0.0))


def generation_complete(status: Column, actual: Column, expected: Column, empty: Column) -> Column:
    """C4: status complete, pooled actual == expected, no empty output (duplicates not tested)."""
    return F.coalesce((status == "complete") & (actual == expected) & (empty == 0), F.lit(False))


def configs_comparable(a: str = "a_", b: str = "b_") -> Column:
    """Float fields within 1e-6 (NULL -> 0); others null-safe equal; versions equal."""
    conds = []
    for f in COMPARABLE_FIELDS:
        x, y = F.col(f"{a}{f}"), F.col(f"{b}{f}")
        if f in FLOAT_FIELDS:
            conds.append(F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))) <= TOLERANCE)
        else:
            conds.append(x.eqNullSafe(y))
    for f in VERSION_FIELDS:
        conds.append(F.col(f"{a}{f}").eqNullSafe(F.col(f"{b}{f}")))
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def configs_equal(a: str = "a_", b: str = "b_") -> Column:
    """The 5-tuple including the fallback level; floats strictly within 1e-6; NULL -> different."""
    conds = []
    for f in EQUAL_FIELDS:
        x, y = F.col(f"{a}{f}"), F.col(f"{b}{f}")
        conds.append(F.abs(x - y) < TOLERANCE if f in FLOAT_FIELDS else x == y)
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


def conservativeness(a: str = "a_", b: str = "b_") -> Column:
    """Sign of the level difference (1 = a is more conservative); unparsable -> 0."""
    return F.coalesce(F.signum(F.col(f"{a}fallback_level") - F.col(f"{b}fallback_level")), F.lit(0.0)) \
            .cast("int")


def pair_runs(runs: DataFrame, pairs: DataFrame, model_col: str = "model_name") -> DataFrame:
    """J6 + C1-C5 for the requested pairs (``model_a, model_b``), as the reference compares
    two named runs.  Both sides are equi-joins on the run name -- no cross product."""
    a = runs.select([F.col(c).alias(f"a_{c}") for c in runs.columns])
    b = runs.select([F.col(c).alias(f"b_{c}") for c in runs.columns])
    j = (pairs.join(a, pairs["model_a"] == a[f"a_{model_col}"])
              .join(b, pairs["model_b"] == b[f"b_{model_col}"]))
    c1 = configs_comparable("a_", "b_")
    return j.select(
        "model_a", "model_b", c1.alias("config_comparable"), configs_equal("a_", "b_").alias("configs_equal"),
        conservativeness("a_", "b_").alias("conservativeness"),
        (c1 & F.col("a_generation_complete") & F.col("b_generation_complete")).alias("throughput_comparable"))


def comparison_matrix(stats: DataFrame, models: Sequence[str], model_col: str = "model_name",
                      metrics: Sequence[str] = MATRIX_METRICS[:-2], pair: DataFrame | None = None) -> DataFrame:
    """UNPIVOT the per-model metrics to (metric, value) and PIVOT on the model.

    Values are cast to DOUBLE (booleans to 0/1) so one column holds them all;
    ``models`` fixes the pivot columns (no extra job to discover them).
    """
    cols = [F.col(m).cast("double").alias(m) for m in metrics]
    long = stats.select(model_col, *cols).unpivot([model_col], list(metrics), "metric", "value")
    out = long.groupBy("metric").pivot(model_col, list(models)).agg(F.first("value"))
    if pair is not None:
        # The pair-level verdicts (C1, C5) fill their row for every model, as in the reference table.
        for m in ("config_comparable", "throughput_comparable"):
            out = out.unionByName(pair.select(F.lit(m).alias("metric"),
                                              *[F.col(m).cast("double").alias(x) for x in models]))
    return out
