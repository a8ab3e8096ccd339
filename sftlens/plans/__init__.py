"""Registered queries over the driver tables, each with its DuckDB oracle where one exists."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analysis_queries, attempt_queries, compare_queries, encode_queries, export_queries, fault_queries, file_queries, grading_queries, increment_queries, manifest_queries, preflight_queries, publication_queries, quality_queries, run_queries, selection_queries, sft_queries, sql_queries, stats_queries, stream_queries

_MODULES = (stats_queries, sft_queries, encode_queries, preflight_queries, quality_queries,
            export_queries, grading_queries, attempt_queries,
            compare_queries, run_queries, manifest_queries, stream_queries, fault_queries,
            analysis_queries, file_queries, selection_queries, sql_queries,
            publication_queries, increment_queries)


def build_standins(spark: SparkSession, sf_dir: str) -> None:
    """Derive and write the stand-in files that several queries read, so that none of
    them pays for it (bench.py does this before it starts its clock)."""
    for faults in (False, True):
        export_queries.sample_lines(spark, sf_dir, faults)
    export_queries.export_lines_with_faults(spark, sf_dir)
    sft_queries.raw_sft_lines(spark, sf_dir)
    file_queries.sample_tree(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out.update(m.ORACLES)
    return out
