"""Token-length statistics, duplicate/empty/truncation audits.

Plan shape: rows -> (group, token count) histogram with a partial+final hash
aggregate (a hot group is pre-aggregated on every executor before the
shuffle) -> window over the histogram for running ranks -> one aggregate per
group.  Percentiles are exact and use the reference's rule
``k = p/100*(n-1)``, ``s[f] + (s[f+1]-s[f])*(k-f)``; the window only ever
holds distinct values of a group, never its rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TRUNCATION_MARGIN, is_blank

PERCENTILES = (50, 90, 95)

STAT_COLUMNS = (
    "actual_samples", "total_output_tokens", "avg_output_tokens", "p50", "p90", "p95",
    "max_output_tokens", "possibly_truncated_count", "empty_output_count", "duplicate_count",
)


def _pct_name(p: float) -> str:
    return f"p{p:g}".replace(".", "_")


def exact_percentiles_from_hist(hist: DataFrame, group_cols: Sequence[str], value_col: str,
                                count_col: str, pcts: Sequence[float],
                                extra_aggs: Sequence = ()) -> DataFrame:
    """Exact percentiles with the reference's linear rule, from a value histogram.

    ``hist`` has one row per (group, value) with its multiplicity.  A window
    (partitioned by group, ordered by value) gives running counts; the order
    statistics ``s[f]`` and ``s[f+1]`` are then found by rank, and the value is
    ``s[f] + (s[f+1] - s[f]) * (k - f)`` with ``k = p/100 * (n - 1)`` -- the same
    floating-point operations, in the same order, as the reference, so that
    ``int()`` truncation agrees bit for bit.  ``n == 1`` gives ``s[0]``; a group
    with no rows never appears (callers fill zeros).

    The window partitions hold distinct values only (bounded by the value
    range), never raw rows, so a hot group does not land whole in one task.
    """
    g = [F.col(c) for c in group_cols]
    w_all = Window.partitionBy(*g)
    w_run = w_all.orderBy(F.col(value_col)).rowsBetween(Window.unboundedPreceding, 0)
    h = (hist.withColumn("_cum", F.sum(count_col).over(w_run))
             .withColumn("_n", F.sum(count_col).over(w_all)))
    v = F.col(value_col)
    lo_rank = h["_cum"] - F.col(count_col)  # rows strictly below this value
    aggs = [F.first("_n").alias("_n")]
    for p in pcts:
        k = F.lit(p / 100.0) * (F.col("_n") - 1)
        f = F.floor(k)
        aggs.append(F.max(F.when((lo_rank <= f) & (f < h["_cum"]), v)).alias(f"_lo{_pct_name(p)}"))
        aggs.append(F.max(F.when((lo_rank <= f + 1) & (f + 1 < h["_cum"]), v)).alias(f"_hi{_pct_name(p)}"))
    aggs.append(F.max(v).alias("_vmax"))
    out = h.groupBy(*g).agg(*aggs, *extra_aggs)
    cols = []
    for p in pcts:
        name = _pct_name(p)
        n = F.col("_n")
        k = F.lit(p / 100.0) * (n - 1)
        f = F.floor(k)
        lo, hi = F.col(f"_lo{name}"), F.col(f"_hi{name}")
        lo, hi = lo.cast("double"), hi.cast("double")
        val = (F.when(n == 1, lo)
                .when(f + 1 >= n, F.col("_vmax").cast("double"))
                .otherwise(lo + (hi - lo) * (k - f)))
        cols.append(val.alias(name))
    extra = [c for c in out.columns if c not in group_cols and not c.startswith("_")]
    return out.select(*g, *cols, *extra)


def _hist_aggs(max_gen_toks: int | str) -> list:
    """``max_gen_toks``: a number, or the name of a column of the histogram."""
    thr = (F.col(max_gen_toks) if isinstance(max_gen_toks, str) else F.lit(max_gen_toks)) - TRUNCATION_MARGIN
    return [
        F.sum("_cnt").alias("actual_samples"),
        F.sum(F.col("_tok") * F.col("_cnt")).cast("bigint").alias("total_output_tokens"),
        F.max("_tok").alias("max_output_tokens"),
        F.coalesce(F.sum(F.when(F.col("_tok") >= thr, F.col("_cnt"))), F.lit(0)).cast("bigint")
         .alias("possibly_truncated_count"),
        F.sum("_empty").cast("bigint").alias("empty_output_count"),
    ]


def token_stats(df: DataFrame, model_col: str = "model", task_col: str = "task",
                tokens_col: str = "tokens", output_col: str | None = "output",
                key_col: str | None = "key", max_gen_toks: int | str = 32768) -> DataFrame:
    """Per (model, task) stats plus the pooled per-model row (A1 + A2).

    The pooled row is computed from the pooled token counts (not averaged task
    stats).  ``level`` is ``task`` or ``overall``; on ``overall`` rows ``task``
    is NULL.  ``max_gen_toks`` is a number or a column that is constant within a model.  Plan: one partial+final aggregate to a (group, tokens) histogram
    for both levels at once (GROUPING SETS), everything else from that
    histogram; duplicates (rows minus distinct keys *within a task*, summed for
    the pooled row as in the reference) from a second aggregate that reads the
    key columns only.
    """
    blank = is_blank(output_col) if output_col else F.lit(False)
    base = df.select(F.col(model_col).alias("_m"), F.col(task_col).alias("_t"),
                     F.col(tokens_col).cast("bigint").alias("_tok"), blank.alias("_blank"),
                     (F.col(max_gen_toks) if isinstance(max_gen_toks, str) else F.lit(max_gen_toks)).alias("_cap"))
    hist = (base.groupingSets([("_m", "_t", "_tok"), ("_m", "_tok")], "_m", "_t", "_tok")
                .agg(F.grouping("_t").alias("_lvl"),
                     F.count(F.lit(1)).alias("_cnt"),
                     F.count_if("_blank").alias("_empty"), F.max("_cap").alias("_cap")))
    keys = ["_m", "_t", "_lvl"]
    out = exact_percentiles_from_hist(hist, keys, "_tok", "_cnt", PERCENTILES, _hist_aggs("_cap"))
    out = out.select(*keys, *[F.col(f"p{p}").cast("bigint").alias(f"p{p}") for p in PERCENTILES],
                     *[c for c in out.columns if c not in keys and c not in {f"p{p}" for p in PERCENTILES}])
    if key_col:
        per_key = (df.select(F.col(model_col).alias("_m"), F.col(task_col).alias("_t"),
                             F.col(key_col).alias("_k"))
                     .groupBy("_m", "_t", "_k").count())
        dups = (per_key.groupingSets([("_m", "_t"), ("_m",)], "_m", "_t")
                       .agg(F.grouping("_t").alias("_lvl"),
                            F.sum(F.col("count") - 1).cast("bigint").alias("duplicate_count")))
        out = out.join(dups, [out[k].eqNullSafe(dups[k]) for k in keys], "left").select(
            out["*"], F.coalesce(dups["duplicate_count"], F.lit(0)).cast("bigint").alias("duplicate_count"))
    return out.select(
        F.col("_m").alias(model_col), F.col("_t").alias(task_col),
        F.when(F.col("_lvl") == 1, F.lit("overall")).otherwise(F.lit("task")).alias("level"),
        "actual_samples", "total_output_tokens",
        F.bround(F.col("total_output_tokens") / F.col("actual_samples"), 1).alias("avg_output_tokens"),
        "p50", "p90", "p95", "max_output_tokens", "possibly_truncated_count",
        "empty_output_count", *(["duplicate_count"] if key_col else []),
    )


def token_stats_flat(df: DataFrame, group_cols: Sequence[str], tokens_col: str = "tokens",
                     output_col: str | None = None, max_gen_toks: int = 32768) -> DataFrame:
    """The same metrics (without duplicates) for an arbitrary single-level grouping."""
    blank = is_blank(output_col) if output_col else F.lit(False)
    gk = [f"_g{i}" for i in range(len(group_cols))]
    base = df.select(*[F.col(c).alias(a) for c, a in zip(group_cols, gk)],
                     F.col(tokens_col).cast("bigint").alias("_tok"), blank.alias("_blank"))
    hist = base.groupBy(*gk, "_tok").agg(F.count(F.lit(1)).alias("_cnt"),
                                          F.count_if("_blank").alias("_empty"))
    out = exact_percentiles_from_hist(hist, gk, "_tok", "_cnt", PERCENTILES, _hist_aggs(max_gen_toks))
    return out.select(
        *[F.col(a).alias(c) for c, a in zip(group_cols, gk)],
        "actual_samples", "total_output_tokens",
        F.bround(F.col("total_output_tokens") / F.col("actual_samples"), 1).alias("avg_output_tokens"),
        *[F.col(f"p{p}").cast("bigint").alias(f"p{p}") for p in PERCENTILES],
        "max_output_tokens", "possibly_truncated_count", "empty_output_count",
    )


def fill_missing(stats: DataFrame, expected: DataFrame, on: Sequence[str]) -> DataFrame:
    """Expected groups with no rows get zero stats (the reference's empty-stats record).

    ``expected`` is a dimension (tasks x models) and is small by construction.
    """
    joined = expected.join(stats, list(on), "left")
    for c in STAT_COLUMNS:
        if c in stats.columns:
            zero = F.lit(0.0) if c == "avg_output_tokens" else F.lit(0).cast("bigint")
            joined = joined.withColumn(c, F.coalesce(F.col(c), zero))
    return joined


def percentile_linear(df: DataFrame, value_col: str, pcts: Sequence[float],
                      group_cols: Sequence[str] = ()) -> DataFrame:
    """A3 on its own: exact linear-interpolation percentiles (``p`` in 0..100) per group.

    Columns are named ``p50``, ``p99_5`` ...; groups with no rows are absent
    (the reference returns 0 for an empty list -- see :func:`fill_missing`).
    """
    hist = df.groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_cnt"))
    if not group_cols:
        hist = hist.withColumn("_all", F.lit(1))
        out = exact_percentiles_from_hist(hist, ["_all"], value_col, "_cnt", pcts)
        return out.drop("_all")
    return exact_percentiles_from_hist(hist, group_cols, value_col, "_cnt", pcts)


def method_audit(df: DataFrame, group_cols: Sequence[str], method_col: str, line_col: str,
                 expected_method: str = "llama_tokenizer") -> tuple[DataFrame, DataFrame]:
    """Sorted distinct non-empty methods per group, and ordered-unique warnings.

    Returns ``(methods, warnings)``; ``warnings`` is a row per offending line
    (``line``, ``warning``), deduplicated on the warning text keeping the first line.
    """
    m = F.col(method_col)
    methods = (df.where(F.coalesce(m, F.lit("")) != "")
               .groupBy(*group_cols)
               .agg(F.sort_array(F.collect_set(m)).alias("methods")))
    warn = (df.where((F.coalesce(m, F.lit("")) != "") & (m != F.lit(expected_method)))
            .select(*group_cols, F.col(line_col).alias("line"),
                    F.format_string("line %d: output_token_count_method='%s'",
                                    F.col(line_col), m).alias("warning")))
    first = warn.groupBy(*group_cols, "warning").agg(F.min("line").alias("line"))
    return methods, first
