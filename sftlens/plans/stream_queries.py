"""Streaming queries (ST1, ST2).

``ingest_incremental``: the export stand-in's sample lines are staged as
files under ``<landing>/stage1`` (catalog tasks) and ``stage2`` (the rest),
partitioned by model and task; the ingest stream runs once after each stage,
so the second run must pick up only the new files.  The sink then holds the
flattened export of every document exactly once -- the same rows as
``export_flatten`` (without ``line``: a staged file numbers its own lines).

``telemetry_stream``: the sampler lines are staged in two time-ordered halves
and aggregated by the event-time stream; the result equals
``telemetry_peak_window``.

Staging and checkpoints live in a fresh folder under the session's
``spark.checkpoint.dir`` (the cluster's shared folder).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.variant import py_str
from ..operators.export import EXPORT_COLUMNS, flatten_samples, manifest_settings
from ..session import scratch_dir
from ..sources.catalog import TASK_CATALOG, task_catalog
from ..streaming.ingest import ingest_samples, read_ingested
from ..streaming.telemetry import read_peaks, telemetry_peaks
from .attempt_queries import SQL_TELEMETRY_PEAK_WINDOW, telemetry_lines
from .export_queries import CREATED_AT, GIT_COMMIT, SQL_EXPORT_FLATTEN, TOKENIZER, sample_lines, task_manifests


def q_ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark, "ingest")
    lines = sample_lines(spark, sf_dir)
    catalog_tasks = [t[0] for t in TASK_CATALOG]
    cat, settings = task_catalog(spark), manifest_settings(task_manifests(spark))

    def flatten(parsed: DataFrame) -> DataFrame:
        return flatten_samples(parsed, cat, settings, model_name=F.col("model"),
                               model_path=F.concat(F.lit("/models/"), F.col("model")),
                               git_commit=GIT_COMMIT, created_at=CREATED_AT, tokenizer=TOKENIZER)

    for stage, cond in (("stage1", F.col("task").isin(catalog_tasks)), ("stage2", ~F.col("task").isin(catalog_tasks))):
        (lines.where(cond).select("model", "task", "text").write.partitionBy("model", "task")
              .text(f"{base}/landing/{stage}"))
        ingest_samples(spark, f"{base}/landing/*/*/*", f"{base}/sink", f"{base}/checkpoint", flatten)
    return read_ingested(spark, f"{base}/sink").select(*EXPORT_COLUMNS).withColumn("doc_id", py_str(F.col("doc_id")))


def q_telemetry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark, "telemetry")
    t = telemetry_lines(spark, sf_dir)
    mid = F.lit("2024-01-16 00:00:00").cast("timestamp")
    for stage, cond in (("stage1", F.col("ts") < mid), ("stage2", F.col("ts") >= mid)):
        t.where(cond).select("value").write.text(f"{base}/landing/{stage}")
        telemetry_peaks(spark, f"{base}/landing/*", f"{base}/sink", f"{base}/checkpoint")
    return read_peaks(spark, f"{base}/sink")


SQL_INGEST_INCREMENTAL = "SELECT * EXCLUDE (line) FROM (" + SQL_EXPORT_FLATTEN + ")"

QUERIES = {"ingest_incremental": q_ingest_incremental, "telemetry_stream": q_telemetry_stream}
ORACLES = {"ingest_incremental": SQL_INGEST_INCREMENTAL, "telemetry_stream": SQL_TELEMETRY_PEAK_WINDOW}
